"""systemd timers from ``key=value`` lines (host, unit, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions.text import field, fields, trim

# Properties read per timer.
PROPERTIES = ["Id", "ActiveState", "Triggers", "NextElapseUSecRealtime", "NextElapseUSecMonotonic",
              "LastTriggerUSec", "Result"]


def key_values(df: DataFrame) -> DataFrame:
    """Add ``key`` and ``value``; lines without a key are dropped."""
    at = F.instr("line", "=")
    return df.filter(at > 1).withColumns({
        "key": trim(F.substring(F.col("line"), F.lit(1), at - 1)),
        "value": trim(F.substring(F.col("line"), at + 1, F.length("line")))}).filter("key <> ''")


def pick_keys(df: DataFrame, by: list[str], keys: list[str], order: str) -> DataFrame:
    """One row per ``by`` with a column per key, '' when absent; the last line of a key wins."""
    return df.filter(F.col("key").isin(keys)).groupBy(*by).agg(*[
        F.coalesce(F.max_by(F.when(F.col("key") == k, F.col("value")),
                            F.when(F.col("key") == k, F.col(order))), F.lit("")).alias(k) for k in keys])


def usec_time(text: Column) -> Column:
    """Microseconds since the epoch as a UTC time; null for 0, blank or other text."""
    t = trim(text)
    usec = F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint"))
    return F.when(usec > 0, F.timestamp_micros(usec).cast("timestamp_ntz"))


def inventory(lines: DataFrame, services: DataFrame) -> DataFrame:
    """Timers with their times; an empty result falls back to the activated service's."""
    units = lines.select("host", "unit").distinct()
    kv = pick_keys(key_values(lines), ["host", "unit"], PROPERTIES, "line_no")
    t = units.join(kv, ["host", "unit"], "left").fillna("", PROPERTIES)
    t = t.select(
        "host", F.when(F.col("Id") == "", F.col("unit")).otherwise(F.col("Id")).alias("unit"),
        field(fields(F.col("Triggers")), 0).alias("activates"),
        F.coalesce(usec_time(F.col("NextElapseUSecRealtime")), usec_time(F.col("NextElapseUSecMonotonic"))).alias("next_run"),
        usec_time(F.col("LastTriggerUSec")).alias("last_run"), F.col("Result").alias("result"),
        F.col("ActiveState").alias("active_state"))
    results = key_values(services).filter("key = 'Result'").groupBy(
        "host", F.col("unit").alias("activates")).agg(F.max("value").alias("service_result"))
    return t.join(results, ["host", "activates"], "left").select(
        "host", "unit", "activates", "next_run", "last_run",
        F.when((F.col("result") == "") & (F.col("activates") != ""), F.coalesce("service_result", F.lit("")))
        .otherwise(F.col("result")).alias("last_result"), "active_state")


def status(as_of, stale_days: int = 30) -> Column:
    """failed, warning (never ran though planned, or last run too old) or ok."""
    old = F.col("last_run") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval '{stale_days}' day")
    return (
        F.when(~F.col("last_result").isin("", "success"), "failed")
        .when(F.col("last_run").isNull() & F.col("next_run").isNotNull(), "warning")
        .when(old, "warning").otherwise("ok"))


def digest_line() -> Column:
    shown = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss 'UTC'"), F.lit("never"))
    result = F.when(F.col("last_result") != "", F.concat(F.lit("\nlast_result:  "), "last_result")).otherwise("")
    return F.concat(
        F.lit("unit:         "), "unit", F.lit("\nactivates:    "),
        F.when(F.col("activates") == "", "(unknown)").otherwise(F.col("activates")),
        F.lit("\nactive_state: "), "active_state", F.lit("\nlast_run:     "), shown("last_run"),
        F.lit("\nnext_run:     "), shown("next_run"), result, F.lit("\n"))
