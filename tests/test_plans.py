"""What the physical plans must look like."""

import re

import pytest
from pyspark.sql import functions as F

from opslake.catalog import registry
from opslake.catalog.base import table
from opslake.functions import redact
from opslake.operators import audit, redaction
from opslake.plans import session
from opslake.plans.partitioning import spread
from opslake.streaming import watch

QUERIES = registry.load()[0]
# these run jobs while they are built
EAGER = {"stream_classified", "stream_alert_batches", "alerts_tumbling", "alerts_sliding", "alerts_sessions",
         "repair_outcomes", "history_retention", "baseline_roundtrip", "alert_batches", "alert_batch_text",
         "failure_context", "change_feed_capped", "stream_seeded", "late_rows", "file_tail_of_logs"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_range_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["log_time_range"](spark, sf_dir))
    assert re.search(r"PushedFilters: \[IsNotNull\(ts\), GreaterThanOrEqual\(ts", text)
    assert re.search(r"ReadSchema: struct<[^>]*>", text).group().count(":") - 1 == 4


def test_scope_prefix_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "f")
    spark.createDataFrame([("h", "/etc/a")], "host string, path string").write.parquet(path)
    assert "StringStartsWith(path,/etc/)" in plan(audit.in_scope(spark.read.parquet(path), ["/etc"]))


def test_no_pair_joins_and_no_single_task_stages(spark, sf_dir):
    # spread() is a no-op on large scans; here it only adds round-robin exchanges
    bad = {}
    for name in sorted(set(QUERIES) - EAGER):
        text = plan(registry.in_utc(QUERIES[name])(spark, sf_dir))
        found = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "BatchEvalPython") if w in text]
        if found:
            bad[name] = found
    assert bad == {}


def test_redaction_needs_no_shuffle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    assert "Exchange" not in plan(redaction.sanitise_column(docs, "text", "clean"))


def test_spread_only_fills_idle_cores(spark):
    wide = spark.range(100).repartition(64).select(F.col("id"))
    assert spread(wide) is wide
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_cluster_needs_a_shared_folder():
    for master in ("local", "local[4]", "local[*]"):
        session.need_local_master(master)
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.need_local_master(master)


def test_redaction_is_evaluated_once(spark, sf_dir):
    lines = watch.classify_stream(spark.createDataFrame([("x",)], "raw string"))
    for df in (QUERIES["boot_diff"](spark, sf_dir), lines):
        assert df._jdf.queryExecution().optimizedPlan().toString().count(redact.PATTERNS["uuid"]) == 1


def test_rules_are_parsed_in_one_pass(spark, sf_dir):
    text = plan(registry.in_utc(QUERIES["fw_unprotected_listeners"])(spark, sf_dir))
    assert text.count("FileScan parquet") <= 3 and len(re.findall(r"\bExchange\b|BroadcastExchange", text)) <= 8


def test_the_change_feed_reads_each_table_once(spark, sf_dir):
    text = plan(registry.in_utc(QUERIES["change_feed"])(spark, sf_dir))
    assert text.count("FileScan parquet") <= 6 and len(re.findall(r"\bExchange\b", text)) <= 2
