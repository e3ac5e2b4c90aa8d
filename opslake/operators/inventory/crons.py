"""Cron jobs from crontab lines (host, source, system_format, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions.text import field, fields, once, tail, trim

# Skipped file suffixes and shells that cannot log in.
BACKUP_SUFFIXES = ["~", ".dpkg-old", ".dpkg-dist", ".rpmsave", ".rpmnew"]
NO_LOGIN = ["nologin", "false", "sync", "shutdown", "halt"]


def is_backup(source: Column) -> Column:
    out = F.lit(False)
    for s in BACKUP_SUFFIXES:
        out = out | source.endswith(s)
    return source.startswith("/etc/cron.d/") & out


def parse(df: DataFrame) -> DataFrame:
    """(host, source, line_no, schedule, user, command) of every job line."""
    rows = df.filter(~is_backup(F.col("source"))).withColumn("line", trim(F.col("line")))
    at = F.instr("line", "=")
    assignment = (at > 1) & ~F.substring(F.col("line"), F.lit(1), at - 1).rlike("[ \t]")
    rows = rows.filter((F.col("line") != "") & ~F.col("line").startswith("#") & ~assignment)
    rows = once(rows, "f", fields(F.col("line")))
    f, n, system = F.col("f"), F.size("f"), F.col("system_format")
    macro = F.col("line").startswith("@")
    macro_rest = trim(F.regexp_extract("line", "^[^ ]* ([\\s\\S]*)$", 1))
    schedule = F.array_join(F.slice(f, 1, 5), " ")
    job = (
        F.when(macro & system & (n >= 3), F.struct(
            field(f, 0).alias("schedule"), field(f, 1).alias("user"), tail(f, 2).alias("command")))
        .when(macro & ~system & (macro_rest != ""), F.struct(
            F.substring_index("line", " ", 1).alias("schedule"), F.lit("").alias("user"), macro_rest.alias("command")))
        .when(~macro & system & (n >= 7), F.struct(
            schedule.alias("schedule"), field(f, 5).alias("user"), tail(f, 6).alias("command")))
        .when(~macro & ~system & (n >= 6), F.struct(
            schedule.alias("schedule"), F.lit("").alias("user"), tail(f, 5).alias("command"))))
    return rows.select("host", "source", "line_no", F.inline(F.array_compact(F.array(job))))


def login_users(passwd: DataFrame) -> DataFrame:
    """(host, name) of accounts with a login shell."""
    rows = passwd.withColumn("line", trim(F.col("line"))).filter(
        (F.col("line") != "") & ~F.col("line").startswith("#"))
    p = F.split("line", ":")
    barred = F.lit(False)
    for s in NO_LOGIN:
        barred = barred | F.get(p, F.lit(6)).endswith(s)
    return rows.filter((F.size(p) >= 7) & ~barred & (F.get(p, F.lit(0)) != "")).select(
        "host", F.get(p, F.lit(0)).alias("name"))


def of_login_users(jobs: DataFrame, passwd: DataFrame) -> DataFrame:
    """User crontab jobs whose owner can log in."""
    users = login_users(passwd).select("host", F.concat(F.lit("user:"), "name").alias("source"))
    return jobs.join(users, ["host", "source"], "left_semi")


def status() -> Column:
    """failed for a schedule that is none, warning for risky or minutely jobs, else ok."""
    part = r"[0-9A-Za-z*/,-]+"
    valid = F.col("schedule").rlike(rf"^(@[a-z]+|{part}( {part}){{4}})$")
    risky = (
        F.col("command").rlike(r"(curl|wget)\b[^|]*\|\s*(ba|z|da)?sh\b")
        | (F.col("schedule") == "* * * * *")
        | F.col("command").rlike(r"(>|tee )\s*/(etc|boot|usr|bin|sbin)/"))
    return F.when(~valid, "failed").when(risky, "warning").otherwise("ok")


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", status()).groupBy("host", "status").agg(F.count(F.lit(1)).alias("n"))


def digest_line() -> Column:
    user = F.when(F.col("user") != "", F.concat(F.lit("\nuser:     "), "user")).otherwise("")
    return F.concat(F.lit("source:   "), "source", F.lit("\nschedule: "), "schedule", user,
                    F.lit("\ncommand:  "), "command", F.lit("\n"))
