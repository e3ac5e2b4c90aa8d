"""Listening ports from ``ss`` lines (host, proto, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions.text import field, fields, once, trim
from opslake.plans.partitioning import first_per_key

# Addresses, sensitive ports and the processes expected on standard ports.
WILDCARDS = ["0.0.0.0", "[::]", "*"]
LOOPBACK = r"^(127\.|\[::1\])"
SENSITIVE_PORTS = {3306: "MySQL", 5432: "PostgreSQL", 6379: "Redis", 27017: "MongoDB", 9090: "Cockpit"}
EXPECTED_PROCESS = {22: ["sshd"], 80: ["nginx", "apache2", "httpd"], 443: ["nginx", "apache2", "httpd"]}
EPHEMERAL_FROM = 32768


def process_label(raw: Column) -> Column:
    """``name (pid N)`` from an ``ss`` users field, '' when it names none."""
    name = F.regexp_extract(raw, r'\("([^"]+)",pid=(\d+)', 1)
    pid = F.regexp_extract(raw, r'\("([^"]+)",pid=(\d+)', 2)
    return F.when(name == "", "").otherwise(F.concat(name, F.lit(" (pid "), pid, F.lit(")")))


def parse(df: DataFrame) -> DataFrame:
    """One row per usable line; short lines and ``*`` addresses are skipped."""
    rows = once(df, "f", fields(F.col("line"))).filter(
        (F.size("f") >= 4) & (field(F.col("f"), 3) != "*"))
    return rows.select(
        "host", F.col("proto").alias("protocol"), "line_no", field(F.col("f"), 3).alias("local"),
        process_label(field(F.col("f"), 5)).alias("process"))


def inventory(df: DataFrame) -> DataFrame:
    """Distinct (protocol, local) per host; the first line wins."""
    return first_per_key(parse(df), ["host", "protocol", "local"], F.col("line_no")).drop("line_no")


def split_local(df: DataFrame) -> DataFrame:
    """Add ``address`` and ``port``, cut at the last colon."""
    return df.withColumns({
        "address": F.regexp_extract("local", r"^(.*):[^:]*$", 1),
        "port": F.regexp_extract("local", r":([0-9]+)$", 1).try_cast("int")})


def exposure(ports: DataFrame) -> DataFrame:
    """Listeners worth attention; loopback-only ones never are."""
    name = F.regexp_extract("process", r"^(.*) \(pid \d+\)$", 1)
    wild = F.col("address").isin(WILDCARDS)
    sensitive = F.col("port").isin(list(SENSITIVE_PORTS))
    odd = F.lit(False)
    for port, names in EXPECTED_PROCESS.items():
        odd = odd | ((F.col("port") == port) & (name != "") & ~name.isin(names))
    finding = (
        F.when(wild & sensitive, "sensitive port on all interfaces")
        .when(odd, "unexpected process on a standard port")
        .when(wild & (F.col("port") >= EPHEMERAL_FROM), "persistent listener on a high port"))
    rows = split_local(ports).filter(~F.col("address").rlike(LOOPBACK)).withColumn("finding", finding)
    return rows.filter("finding is not null").select(
        "host", "protocol", "local", "port", "process", "finding",
        F.when(F.col("finding").startswith("persistent"), "info").otherwise("warning").alias("severity"))


def finding_counts(findings: DataFrame) -> DataFrame:
    warning = F.col("severity") == "warning"
    return findings.groupBy("host").agg(
        F.count_if(warning).alias("warnings"), F.count_if(~warning).alias("info"))


def digest_line() -> Column:
    who = F.when(F.col("process") != "", F.col("process")).otherwise("(process unknown)")
    return trim(F.concat("protocol", F.lit("  "), "local", F.lit("  — "), who))
