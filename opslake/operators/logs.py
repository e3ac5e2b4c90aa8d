"""Log triage: scans, filters, limits, correlation and failure context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.functions.redact import sanitise_line, severity
from opslake.functions.text import lines, once, trim
from opslake.plans.partitioning import last_per_group, may_be_wanted, range_buckets, running_index
from opslake.plans.session import materialise

# Lines kept per source when no limit is asked for.
DEFAULT_LINES = {"service": 50, "boot": 80, "kernel": 60, "file": 100}

# Words that make a line an error line, and kernel-log words.
ERROR_WORDS = [
    "error", "err", "warn", "fatal", "crit", "fail", "panic", "exception", "denied",
    "refused", "timeout", "traceback", "segfault", "oom",
]
KERNEL_WORDS = ["error", "err", "warn", "fail", "panic", "oops", "segfault", "oom", "crit", "bug"]

# What an empty journal prints.
EMPTY_JOURNAL = ["-- No entries --", "-- no entries --", "No journal files were found."]

# Exit code range and labels.
EXIT_CODE_MIN, EXIT_CODE_MAX = 1, 255
EXIT_LABELS = {
    1: "generic error",
    2: "misuse of shell built-in or bad argument",
    126: "permission denied or command not executable",
    127: "command not found",
    128: "invalid exit argument",
    130: "terminated by SIGINT (Ctrl-C)",
    137: "killed by SIGKILL — likely OOM killer",
    139: "segmentation fault (SIGSEGV)",
    143: "terminated by SIGTERM",
}

SEVERITIES = ["ERROR", "WARN", "SCRIPTLET", "TRANSACTION", "DEBUG", "INFO"]
ORDER = ("ts", "seq")


def line_limit(asked: int | None, source: str) -> int:
    return asked if asked is not None and asked > 0 else DEFAULT_LINES[source]


def in_time_range(df: DataFrame, since=None, until=None, ts: str = "ts") -> DataFrame:
    """Rows from ``since`` to ``until``, both included; reaches the scan as a pushed filter."""
    if since is not None:
        df = df.filter(F.col(ts) >= since)
    if until is not None:
        df = df.filter(F.col(ts) <= until)
    return df


def is_error_line(line: Column, words: Sequence[str] = ERROR_WORDS) -> Column:
    return F.lower(line).rlike("|".join(words))


def journal_has_content(text: Column) -> Column:
    """False for blank output and for sentinels without any real log line."""
    t = trim(text)
    sentinel = F.lit(False)
    for s in EMPTY_JOURNAL:
        sentinel = sentinel | F.contains(t, F.lit(s))
    real = F.exists(lines(t), lambda x: trim(x).startswith("[") | F.contains(x, F.lit("]:")))
    return (t != "") & ~(sentinel & ~real)


def count_empty_journals(df: DataFrame, text: str, by: str) -> DataFrame:
    has = journal_has_content(F.col(text))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("journals"), F.count_if(~has).alias("empty_journals"))


def filtered_or_all(df: DataFrame, keys: Sequence[str], keep: Column) -> DataFrame:
    """Rows passing ``keep`` where a group has any, else the whole group.

    Rows that pass go straight out. Only the others are joined, against the distinct groups
    that have a row that passes, so no task has to hold a whole group.
    """
    passes = F.coalesce(keep, F.lit(False))
    kept = df.filter(passes)
    return kept.unionByName(df.filter(~passes).join(kept.select(*keys).distinct(), list(keys), "left_anti").select(*df.columns))


def best_tier_last(df: DataFrame, keys: Sequence[str], tier: Column, n: int,
                   order: Sequence[str] = ORDER) -> DataFrame:
    """Last ``n`` rows of the best (lowest) tier present in each group.

    Limiting per (group, tier) first leaves a bounded number of rows per group.
    """
    cut = last_per_group(df.withColumn("_tier", tier), [*keys, "_tier"], order, n)
    best = F.min("_tier").over(Window.partitionBy(*keys))
    return cut.withColumn("_best", best).filter("_tier = _best").drop("_tier", "_best")


def errors_else_last(df: DataFrame, keys: Sequence[str], n: int, max_priority: int = 3) -> DataFrame:
    """Service and boot logs: error-level rows if there are any, else all; last ``n`` of them."""
    return best_tier_last(df, keys, F.when(F.col("priority") <= max_priority, 0).otherwise(1), n)


def service_logs(df: DataFrame, service: str, lines_: int | None = None, since=None, until=None) -> DataFrame:
    scoped = in_time_range(df.filter(F.col("service") == service), since, until)
    return errors_else_last(scoped, ["host"], line_limit(lines_, "service"))


def boot_logs(df: DataFrame, boot: int, lines_: int | None = None, since=None, until=None) -> DataFrame:
    scoped = in_time_range(df.filter(F.col("boot") == boot), since, until)
    return errors_else_last(scoped, ["host"], line_limit(lines_, "boot"))


def kernel_logs(df: DataFrame, lines_: int | None = None) -> DataFrame:
    """Kernel messages per host: err/warn levels, else keyword lines, else everything."""
    tier = (F.when(F.col("priority").isin(3, 4), 0)
            .when(is_error_line(F.col("message"), KERNEL_WORDS), 1).otherwise(2))
    return best_tier_last(
        df.filter(F.col("service") == "kernel"), ["host"], tier, line_limit(lines_, "kernel"))


def file_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) of whole-file texts; a final newline starts no line."""
    body = F.regexp_replace(F.col(text), r"\n\z", "")
    return df.select(key, F.posexplode(lines(body)).alias("line_no", "line"))


def tail_filtered(df: DataFrame, keys: Sequence[str], order: str = "line_no", line: str = "line",
                  lines_: int | None = None) -> DataFrame:
    """Files: the last ``n`` lines first, then error lines if any, else those lines."""
    last = last_per_group(df, keys, [order], line_limit(lines_, "file"))
    hit = is_error_line(F.col(line))
    any_hit = F.bool_or(hit).over(Window.partitionBy(*keys))  # at most n rows per group here
    return last.withColumn("_any", any_hit).filter(hit | ~F.col("_any")).drop("_any")


def requested(spark, services: Sequence[str]) -> DataFrame:
    """The service list with its order; as small as the argument."""
    return spark.createDataFrame([(s, i) for i, s in enumerate(services)], "service string, position int")


def context_logs(df: DataFrame, services: Sequence[str], lines_: int | None = None,
                 since=None, until=None) -> DataFrame:
    if len(services) < 2:
        raise ValueError("correlation needs at least two services")
    scoped = in_time_range(df.filter(F.col("service").isin(*services)), since, until)
    return errors_else_last(scoped, ["host", "service"], line_limit(lines_, "service"))


def context_digest(df: DataFrame, services: Sequence[str], lines_: int | None = None,
                   since=None, until=None) -> DataFrame:
    """One text per host: a headed section per requested service, in request order.

    A section holds at most the line limit, so a digest is bounded by the request.
    """
    rows = context_logs(df, services, lines_, since, until)
    rows = rows.join(F.broadcast(requested(df.sparkSession, services)), "service")
    section = rows.groupBy("host", "service", "position").agg(
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("ts", "seq", "raw"))), lambda r: r["raw"]), "\n").alias("body"))
    part = F.concat(F.lit("--- "), F.col("service"), F.lit(" ---\n"), trim(F.col("body")))
    return section.groupBy("host").agg(
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("position", part.alias("part")))),
            lambda r: r["part"]), "\n").alias("digest"))


def context_missing(df: DataFrame, services: Sequence[str], since=None, until=None) -> DataFrame:
    """(host, service) pairs that were asked for and have no lines."""
    hosts = df.select("host").distinct()
    wanted = hosts.select("host", F.explode(F.array(*[F.lit(s) for s in services])).alias("service"))
    present = in_time_range(df, since, until).select("host", "service").distinct()
    return wanted.join(present, ["host", "service"], "left_anti")


def boot_diff(df: DataFrame, from_boot: int, to_boot: int) -> DataFrame:
    """ERROR/WARN templates whose count differs between two boots of a host.

    Both boots are counted in one aggregation instead of joining two of them. Hosts
    without lines in one of the boots have nothing to compare and are left out.
    """
    if from_boot == to_boot:
        raise ValueError("the two boots must be different")
    both = df.filter(F.col("boot").isin(from_boot, to_boot)).select("host", "boot", "raw")
    counted = once(both, "template", sanitise_line(F.col("raw"))).groupBy("host", "template").agg(
        F.count_if(F.col("boot") == from_boot).alias("from_n"),
        F.count_if(F.col("boot") == to_boot).alias("to_n"))
    hosts = (
        df.filter(F.col("boot").isin(from_boot, to_boot)).groupBy("host")
        .agg(F.bool_or(F.col("boot") == from_boot).alias("_f"), F.bool_or(F.col("boot") == to_boot).alias("_t"))
        .filter("_f and _t").select("host"))
    changed = counted.withColumn("severity", severity(F.col("template"))).filter(
        F.col("severity").isin("ERROR", "WARN") & (F.col("from_n") != F.col("to_n")))
    return changed.join(hosts, "host", "left_semi").select(
        "host", "severity", "template", "from_n", "to_n",
        F.when(F.col("from_n") == 0, "new").when(F.col("to_n") == 0, "gone")
        .otherwise("frequency").alias("difference"))


def failure_context(df: DataFrame, n: int | None = None, ts: str = "ts") -> DataFrame:
    """The last ``n`` lines of the service up to and including each failure line.

    Lines are numbered per (host, service); a failure at position p needs positions
    p-n+1..p, which lie in two adjacent blocks of n, so the join is an equi-join whose
    groups never hold more than n lines. ``seq`` is unique per service.
    """
    size = line_limit(n, "service")
    keys = ["host", "service"]
    # texts stay behind: only positions are sorted and joined, and the few lines wanted are fetched last
    slim = range_buckets(df.select(*keys, ts, "seq", "exit_code"), keys, [ts, "seq"])
    numbered = running_index(slim, keys, [ts, "seq"], F.col("_bucket"), "_at").withColumn(
        "_block", F.floor(F.col("_at") / size))
    fails = numbered.filter(F.col("exit_code").isNotNull()).select(
        *keys, F.col("seq").alias("failure_seq"), "exit_code", F.col("_at").alias("_end"),
        F.explode(F.array(F.col("_block"), F.col("_block") - 1)).alias("_block"))
    body = numbered.select(*keys, "_block", "_at", F.col("seq").alias("line_seq"))
    wanted = (
        fails.join(body, [*keys, "_block"])
        .filter((F.col("_at") <= F.col("_end")) & (F.col("_at") > F.col("_end") - size))
        .select(*keys, "failure_seq", "exit_code", "line_seq", (F.col("_end") - F.col("_at")).alias("lines_before")))
    wanted = materialise(wanted, "wanted")
    # only texts of wanted lines move
    texts = may_be_wanted(df.select(*keys, F.col("seq").alias("line_seq"), "raw"), wanted, [*keys, "line_seq"])
    return wanted.join(texts, [*keys, "line_seq"]).select(
        *keys, "failure_seq", "exit_code", "line_seq", "lines_before", "raw")


def exit_code_error(raw: Column) -> Column:
    """Why a given exit code text is refused, '' when it is accepted."""
    code = trim(raw).try_cast("bigint")
    bounds = f"{EXIT_CODE_MIN} and {EXIT_CODE_MAX}"
    valid_text = trim(raw).rlike(r"^[+-]?[0-9]+$")
    return (
        F.when(~valid_text | code.isNull(), F.concat(
            F.lit('invalid exit code "'), raw, F.lit(f'": must be an integer between {bounds}')))
        .when(code == 0, "exit code 0 means success — there is nothing to explain")
        .when(~code.between(EXIT_CODE_MIN, EXIT_CODE_MAX), F.concat(
            F.lit("exit code "), code.cast("string"),
            F.lit(f" is out of range: valid exit codes are {EXIT_CODE_MIN}–{EXIT_CODE_MAX}")))
        .otherwise(""))


def exit_code_label(code: Column) -> Column:
    out = F.when(code == list(EXIT_LABELS)[0], EXIT_LABELS[1])
    for value, label in list(EXIT_LABELS.items())[1:]:
        out = out.when(code == value, label)
    return out.when(code > 128, F.concat(F.lit("terminated by signal "), (code - 128).cast("string"))
                    ).otherwise("nonzero exit")


def severity_pivot(df: DataFrame, keys: Sequence[str], line: str = "raw") -> DataFrame:
    tagged = df.withColumn("severity", severity(sanitise_line(F.col(line))))
    counts = tagged.groupBy(*keys).pivot("severity", SEVERITIES).agg(F.count(F.lit(1)))
    return counts.select(*keys, *[
        F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(f"n_{s.lower()}") for s in SEVERITIES])


def healthy_groups(df: DataFrame, keys: Sequence[str], tagged: str) -> DataFrame:
    """Healthy = no ERROR, no WARN and no failed transaction or scriptlet line."""
    sev = severity(F.col(tagged))
    broken = sev.isin("ERROR", "WARN") | (
        sev.isin("TRANSACTION", "SCRIPTLET") & F.lower(tagged).rlike("fail|error"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_lines"), (~F.bool_or(broken)).alias("healthy"))
