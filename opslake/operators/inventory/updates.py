"""Pending package updates (host, manager, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions.text import field, fields, once, tail, trim
from opslake.plans.partitioning import last_per_key

# Managers by listing form, and packages whose update needs a reboot.
MANAGERS = {"apt": "apt", "dnf": "dnf", "yum": "dnf", "pacman": "pacman", "zypper": "name",
            "apk": "name", "xbps": "name", "emerge": "name", "nix": "name"}
REBOOT_PREFIXES = ["linux-image", "linux-headers", "systemd", "nvidia-", "libnvidia", "firmware"]
REBOOT_PARTS = ["-modules-", "-firmware"]
REBOOT_NAMES = ["glibc", "libc6", "dbus", "udev"]


def needs_reboot(package: Column) -> Column:
    p = F.lower(package)
    out = p.isin(REBOOT_NAMES)
    for s in REBOOT_PREFIXES:
        out = out | p.startswith(s)
    for s in REBOOT_PARTS:
        out = out | F.contains(p, F.lit(s))
    return out


def parse(df: DataFrame) -> DataFrame:
    """(host, manager, line_no, package, installed, available, security, reboot)."""
    form = F.create_map(*[x for k, v in MANAGERS.items() for x in (F.lit(k), F.lit(v))])[F.col("manager")]
    rows = df.withColumn("line", trim(F.col("line"))).filter("line <> ''")
    rows = once(rows.withColumn("form", form), "f", fields(F.col("line")))
    f, n, line = F.col("f"), F.size("f"), F.col("line")
    has = lambda text: F.contains(line, F.lit(text))

    def update(package, installed, available, security, reboot) -> Column:
        return F.struct(package.alias("package"), installed.alias("installed"), available.alias("available"),
                        security.alias("security"), reboot.alias("reboot"))

    none, no = F.lit(""), F.lit(False)
    apt_name = F.substring_index(field(f, 0), "/", 1)
    apt_from = trim(F.regexp_extract(tail(f, 2), r"^.*?upgradable from:.([^\]]*)\]", 1))
    dnf_name = F.regexp_extract(field(f, 0), r"^(.*)\.[^.]*$", 1)
    newer = F.when((n >= 4) & (field(f, 2) == "->"), F.rtrim(field(f, 3), F.lit("-"))).otherwise("")
    parsed = (
        F.when((F.col("form") == "apt") & (n >= 2) & ~has("Listing..."), update(
            apt_name, apt_from, field(f, 1), has("security") | has("~deb") | has("+security"), needs_reboot(apt_name)))
        .when((F.col("form") == "dnf") & (n == 3) & F.contains(field(f, 0), F.lit(".")), update(
            dnf_name, none, field(f, 1), F.contains(F.lower(line), F.lit("security")), needs_reboot(dnf_name)))
        .when((F.col("form") == "pacman") & (n >= 3), update(
            field(f, 0), field(f, 1), newer, no, needs_reboot(field(f, 0))))
        .when(F.col("form") == "name", update(line, none, none, no, no)))
    return rows.select("host", "manager", "line_no", F.inline(F.array_compact(F.array(parsed))))


def installed_versions(rpm: DataFrame) -> DataFrame:
    """(host, package, version) from ``name version`` lines; the last line wins."""
    f = fields(F.col("line"))
    rows = once(rpm, "f", f).filter(F.size("f") == 2).select(
        "host", field(F.col("f"), 0).alias("package"), field(F.col("f"), 1).alias("version"), "line_no")
    return last_per_key(rows, ["host", "package"], F.col("line_no")).drop("line_no")


def with_installed(updates: DataFrame, rpm: DataFrame) -> DataFrame:
    """Fill the installed version of dnf updates from the package database."""
    joined = updates.join(installed_versions(rpm), ["host", "package"], "left")
    from_db = F.col("manager").isin("dnf", "yum")
    return joined.withColumn("installed", F.when(
        from_db, F.coalesce("version", F.lit(""))).otherwise(F.col("installed"))).select(*updates.columns)


def category() -> Column:
    """security, major (leading number grows), minor, or unknown without both versions."""
    lead = lambda c: F.regexp_extract(c, r"^(?:\d+:)?(\d+)", 1).try_cast("bigint")
    old, new = lead("installed"), lead("available")
    return (
        F.when(F.col("security"), "security").when(old.isNull() | new.isNull(), "unknown")
        .when(new > old, "major").otherwise("minor"))


def category_counts(updates: DataFrame) -> DataFrame:
    names = ["security", "major", "minor", "unknown"]
    return updates.withColumn("category", category()).groupBy("host").agg(
        *[F.count_if(F.col("category") == c).alias(c) for c in names], F.count_if("reboot").alias("reboot"))


def digest_line() -> Column:
    tag = F.concat(F.when(F.col("security"), " [SECURITY]").otherwise(""), F.when(F.col("reboot"), " [REBOOT]").otherwise(""))
    had = F.when(F.col("installed") == "", "(unknown)").otherwise(F.col("installed"))
    return F.concat(F.col("number").cast("string"), F.lit(". "), "package", tag, F.lit("  installed: "), had,
                    F.lit(" -> available: "), "available")
