"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opslake.catalog import registry  # noqa: E402
from opslake.plans.session import local_session  # noqa: E402

HEADLINE = [
    "sanitise_corpus", "redaction_report", "collapse_repeats", "sanitise_lines", "last_n_lines",
    "errors_or_all", "boot_diff", "failure_context", "change_feed", "change_totals", "alert_batches",
    "stream_classified", "history_summaries", "reply_structural_errors", "reply_salvaged",
    "ports_inventory", "fw_unprotected_listeners", "mount_findings", "tcp_sockets", "top_processes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "opslake-bench")
    spark.sparkContext.setLogLevel("ERROR")
    known = registry.load()[0]
    names = list(known) if wanted == ["all"] else wanted
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        registry.in_utc(known[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
