"""Host facts: operating system, package manager, memory, disks, uptime, insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions.text import bind, field, fields, once, trim, WE
from opslake.operators.inventory.timers import pick_keys
from opslake.plans.partitioning import first_per_key

# Os-release keys and the package manager of each distribution id.
OS_KEYS = ["ID", "ID_LIKE", "VERSION_ID", "PRETTY_NAME"]
PACKAGE_MANAGERS = {
    "apt": ["debian", "ubuntu", "linuxmint", "pop", "elementary", "kali", "raspbian"],
    "dnf": ["fedora", "rhel", "centos", "rocky", "almalinux", "ol"],
    "pacman": ["arch", "manjaro", "endeavouros", "garuda", "cachyos"],
    "zypper": ["opensuse", "opensuse-leap", "opensuse-tumbleweed", "sles", "suse"],
    "apk": ["alpine"], "xbps": ["void"], "emerge": ["gentoo"], "nix": ["nixos"],
}


def _unquoted(v: Column) -> Column:
    quoted = v.rlike(r"""^"[\s\S]*"$|^'[\s\S]*'$""") & (F.length(v) >= 2)
    return F.when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)


def environment(df: DataFrame) -> DataFrame:
    """Distribution id, likes, version and name per host, from os-release lines."""
    rows = df.withColumn("line", trim(F.col("line"))).filter(~F.col("line").startswith("#"))
    at = F.instr("line", "=")
    kv = rows.filter(at > 1).withColumns({
        "key": F.substring(F.col("line"), F.lit(1), at - 1),
        "value": bind(trim(F.substring(F.col("line"), at + 1, F.length("line"))), _unquoted)})
    wide = pick_keys(kv, ["host"], OS_KEYS, "line_no")
    return wide.select("host", F.col("ID").alias("distro_id"), F.col("ID_LIKE").alias("distro_like"),
                       F.col("VERSION_ID").alias("distro_version"), F.col("PRETTY_NAME").alias("pretty_name"))


def package_manager(distro_id: Column, distro_like: Column) -> Column:
    """Manager of the id, else of the first known id_like word, else ''."""
    known = F.create_map(*[F.lit(x) for m, ids in PACKAGE_MANAGERS.items() for i in ids for x in (i, m)])
    words = F.concat(F.array(distro_id), fields(distro_like))
    found = F.filter(F.transform(words, lambda w: F.try_element_at(known, w)), lambda m: m.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def clean_unit(c: Column) -> Column:
    """``1.0Gi`` -> ``1G``."""
    for u in "GMK":
        c = F.regexp_replace(c, rf"(\d){u}i{WE}", rf"$1{u}")
    return F.regexp_replace(c, r"(\d+)\.0([GMK])", "$1$2")


def memory(df: DataFrame) -> DataFrame:
    """Memory and swap text per host from ``free -h`` lines (host, line_no, line)."""
    rows = once(df, "f", fields(F.col("line")))
    f, n = F.col("f"), F.size("f")
    unit = lambda i: clean_unit(field(f, i))
    mem = F.when((n >= 7) & (field(f, 0) == "Mem:"), F.concat(
        unit(2), F.lit(" / "), unit(1), F.lit("  ("), unit(6), F.lit(" free)")))
    swap = F.when((n >= 3) & (field(f, 0) == "Swap:"), F.when(
        field(f, 2).isin("0B", "0"), "inactive").otherwise(F.concat(unit(2), F.lit(" / "), unit(1))))
    return rows.groupBy("host").agg(
        F.coalesce(F.max_by(mem, F.when(mem.isNotNull(), F.col("line_no"))), F.lit("(none)")).alias("memory"),
        F.coalesce(F.max_by(swap, F.when(swap.isNotNull(), F.col("line_no"))), F.lit("")).alias("swap"))


def disks(df: DataFrame) -> DataFrame:
    """Used, size and share per device and host; the first line of a device wins."""
    rows = once(df, "f", fields(F.col("line"))).filter(
        (F.size("f") >= 6) & field(F.col("f"), 0).startswith("/dev/"))
    f = F.col("f")
    parsed = rows.select(
        "host", field(f, 0).alias("device"), "line_no", clean_unit(field(f, 1)).alias("size"),
        clean_unit(field(f, 2)).alias("used"), field(f, 4).alias("use_percent"), field(f, 5).alias("mountpoint"))
    return first_per_key(parsed, ["host", "device"], F.col("line_no")).drop("line_no")


def uptime(raw: Column) -> Column:
    """``up 3 days, 4 hours, 5 minutes`` -> ``3d 4h 5m``."""
    s = F.regexp_replace(trim(raw), "^up ", "")
    for word, letter in (("days?", "d"), ("hours?", "h"), ("minutes?", "m")):
        s = F.regexp_replace(s, rf"(\d+)[\t\n\f\r ]+{word}", f"$1{letter}")
    out = F.array_join(fields(F.replace(s, F.lit(","), F.lit(""))), " ")
    return F.when(trim(raw) == "", "(none)").otherwise(out)


def insights(hosts: DataFrame, failed: DataFrame, errors: DataFrame) -> DataFrame:
    """Failed services and whether the journal has recent errors, for every host."""
    bad = failed.filter(trim(F.col("line")) != "").groupBy("host").agg(F.count(F.lit(1)).alias("failed"))
    err = errors.filter(trim(F.col("line")) != "").select("host").distinct().withColumn("seen", F.lit(True))
    return hosts.join(bad, "host", "left").join(err, "host", "left").select(
        "host", F.coalesce("failed", F.lit(0)).alias("failed_services"),
        F.coalesce("seen", F.lit(False)).alias("recent_errors"))
