"""Result history: append, retention, filters, summaries, recurrence."""

from __future__ import annotations

import re
import uuid
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opslake.functions.json_reply import strict_json
from opslake.functions.text import bind, trim
from opslake.plans.partitioning import last_per_group
from opslake.plans.session import materialise

# Entries kept, entries shown, bytes of a raw fallback summary.
MAX_ENTRIES = 1000
SHOWN = 10
RAW_BYTES = 80

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}


ENTRY = "host string, seq long, ts timestamp_ntz, command string, result string"


def append(df: DataFrame, path: str, batch: str) -> None:
    """Add entries (host, seq, ts, command, result) as a named batch; readers prune on ``command``.

    A batch that is appended again replaces itself, so a retried job changes nothing.
    """
    spark = df.sparkSession
    one = spark.range(1).select(F.lit(batch).alias("batch"))
    _write(df.withColumn("batch", F.lit(batch)), path, one.join(_generations(spark, path), "batch", "left"))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _generations(spark: SparkSession, path: str) -> DataFrame:
    """(batch, gen, form): the newest whole form of every batch, named by the write it comes from."""
    return _table(spark, f"{path}/written", "form string, batch string, gen int").groupBy("batch").agg(
        F.max("gen").alias("gen"), F.max_by("form", "gen").alias("form"))


def _write(entries: DataFrame, path: str, batches: DataFrame) -> None:
    """Write a new form of ``batches`` (batch, gen so far or null), which hold ``entries`` from now on.

    The entries come first and the mark that they are whole after them; until then readers take
    the form before. What an attempt that failed has left bears another name and is never read.
    """
    spark, form = entries.sparkSession, uuid.uuid4().hex
    # written first, as reading the marks and writing them would meet
    batches = materialise(batches.select("batch", (F.coalesce("gen", F.lit(-1)) + 1).alias("gen")), "batches")
    entries.withColumn("form", F.lit(form)).write.mode("append").partitionBy("batch", "form", "command").parquet(f"{path}/entries")
    (batches.withColumn("form", F.lit(form)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch", "gen").parquet(f"{path}/written"))
    spark.catalog.refreshByPath(path)


def _live(spark: SparkSession, path: str) -> DataFrame:
    rows = _table(spark, f"{path}/entries", f"{ENTRY}, batch string, form string")
    return rows.join(_generations(spark, path), ["batch", "form"], "left_semi")


def load(spark: SparkSession, path: str) -> DataFrame:
    return _live(spark, path).select("host", "seq", "ts", "command", "result")


def newest(df: DataFrame, n: int = MAX_ENTRIES) -> DataFrame:
    """The last ``n`` entries of every host in append order."""
    return last_per_group(df, ["host"], ["seq"], n)


def retain_newest(spark: SparkSession, path: str, n: int = MAX_ENTRIES) -> int:
    """Retention: only batches that hold entries beyond the newest ``n`` of their host are written anew.

    Returns how many they were. Entries of one host with the same ``seq`` stay or go together.
    """
    live = _live(spark, path)
    oldest = newest(live.select("host", "seq"), n).groupBy("host").agg(F.min("seq").alias("oldest"))
    dated = live.join(oldest, "host")
    touched = materialise(dated.filter(F.col("seq") < F.col("oldest")).select("batch").distinct(), "touched")
    count = touched.count()
    if count:
        kept = dated.join(touched, "batch", "left_semi").filter(F.col("seq") >= F.col("oldest")).drop("oldest", "form")
        _write(kept, path, _generations(spark, path).join(touched, "batch", "left_semi"))
    return count


def parse_since(text: str) -> timedelta:
    """``24h``, ``1h30m``, ``30m`` or whole days as ``7d``."""
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|μs|ms|s|m|h)", text)
    if parts and "".join(a + b for a, b in parts) == text.lstrip("+-"):
        seconds = sum(float(a) * _UNITS[b] for a, b in parts)
        return timedelta(seconds=-seconds if text.startswith("-") else seconds)
    if text == "0":
        return timedelta(0)
    if re.fullmatch(r"\+?\d+d", text):
        return timedelta(days=int(text[:-1]))
    raise ValueError(f'invalid duration "{text}" (try 24h, 7d, 30m)')


def entries(df: DataFrame, as_of, command: str = "", since: str = "", limit: int = SHOWN) -> DataFrame:
    """Filter by command, then strictly after ``as_of - since``, then the last ``limit`` of a host (0 = all)."""
    if command:
        df = df.filter(F.col("command") == command)
    if since:
        df = df.filter(F.col("ts") > F.lit(as_of - parse_since(since)).cast("timestamp_ntz"))
    if limit > 0:
        df = newest(df, limit)
    return df.orderBy("host", "seq")


def summary(command: Column, result: Column) -> Column:
    """One line that stands for a result; the result is parsed once."""
    def of(v: Column) -> Column:
        text = lambda path: F.try_variant_get(v, path, "string")
        filled = lambda path: bind(text(path), lambda t: F.when(t != "", trim(t)))
        issues = lambda: F.try_variant_get(v, "$.issues", "variant")
        none_found = F.lit("no issues detected")
        explain = F.when(F.schema_of_variant(v).startswith("OBJECT") & bind(
            issues(), lambda i: i.isNull() | F.schema_of_variant(i).rlike("^(ARRAY|VOID)")),
            F.coalesce(trim(text("$.issues[0].what")), none_found))
        doctor = F.when(issues().isNotNull(), F.coalesce(filled("$.issues[0].title"), none_found)).otherwise(filled("$.summary"))
        return (F.when(command == "explain", explain)
                .when(command.isin("why", "audit"), filled("$.summary"))
                .when(command == "status", F.coalesce(filled("$.overview"), filled("$.summary")))
                .when(command == "doctor", doctor))
    size = F.octet_length(result)
    head = F.make_valid_utf8(F.substring(F.encode(result, "utf-8"), 1, RAW_BYTES).cast("string"))
    cut = F.when(size > RAW_BYTES, F.concat(head, F.lit("..."))).otherwise(result)
    return F.coalesce(bind(strict_json(result), lambda v: F.when(v.isNotNull(), of(v))), cut)


def recurring(df: DataFrame) -> DataFrame:
    """Summaries a host has seen more than once per command."""
    return df.groupBy("host", "command", "summary").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    ).filter("n > 1")


def trend(df: DataFrame) -> DataFrame:
    """Entries per host, command and day with the change from the day before it in the table."""
    days = df.groupBy("host", "command", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("n").over(Window.partitionBy("host", "command").orderBy("day"))
    return days.withColumn("change", F.col("n") - F.coalesce(before, F.lit(0)))


def status_counts(df: DataFrame, by: str) -> DataFrame:
    """Anomalies: ``failed`` is critical, anything else a warning."""
    failed = F.col("severity") == "failed"
    return df.groupBy(by).agg(F.count_if(failed).alias("critical"), F.count_if(~failed).alias("warnings"))
