"""Mount tables, disk usage and mount findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions.text import bind, field, fields, once, trim
from opslake.plans.partitioning import first_per_key, last_per_key

# File systems that hold no disk data, network file systems, thresholds.
PSEUDO_TYPES = [
    "proc", "sysfs", "devtmpfs", "devpts", "tmpfs", "cgroup", "cgroup2", "pstore", "bpf", "debugfs",
    "tracefs", "securityfs", "hugetlbfs", "mqueue", "fusectl", "configfs", "autofs", "efivarfs", "squashfs",
]
NFS_TYPES = ["nfs", "nfs3", "nfs4"]
WARN_PERCENT, CRITICAL_PERCENT = 85, 95


def is_pseudo(fstype: Column) -> Column:
    return fstype.isin(PSEUDO_TYPES)


def is_nfs(fstype: Column) -> Column:
    return fstype.isin(NFS_TYPES)


def unescape(c: Column) -> Column:
    """Replace ``\\040``-style octal escapes by their bytes."""
    def piece(p: Column, i: Column) -> Column:
        code = F.conv(F.substring(p, 1, 3), 8, 10).cast("int").bitwiseAND(255)
        return (
            F.when(i == 0, F.hex(p))
            .when(p.rlike("^[0-7]{3}"), F.concat(F.lpad(F.hex(code), 2, "0"), F.hex(F.substring(p, F.lit(4), F.length(p)))))
            .otherwise(F.concat(F.lit("5C"), F.hex(p))))
    joined = F.array_join(F.transform(F.split(c, r"\\"), piece), "")
    return F.when(F.contains(c, F.lit("\\")), F.unhex(joined).cast("string")).otherwise(c)


def mount_table(df: DataFrame, keep_line_no: bool = False) -> DataFrame:
    """(host, device, mountpoint, fstype, options); the first line of a mount point wins."""
    rows = df.withColumn("line", trim(F.col("line"))).filter(~F.col("line").startswith("#"))
    rows = once(rows, "f", fields(F.col("line"))).filter(F.size("f") >= 4)
    f = F.col("f")
    parsed = rows.select(
        "host", "line_no", unescape(field(f, 0)).alias("device"), unescape(field(f, 1)).alias("mountpoint"),
        field(f, 2).alias("fstype"), field(f, 3).alias("options"))
    table = first_per_key(parsed, ["host", "mountpoint"], F.struct("line_no"))
    return table if keep_line_no else table.drop("line_no")


def human_blocks(text: Column) -> Column:
    """KiB as ``1.5G``, ``3.0M`` or ``12K``, ties to even; text that is no count stays."""
    def scaled(kib: Column, unit: int, letter: str) -> Column:
        def tenths(t: Column) -> Column:
            return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(letter))
        q, r = F.floor(kib * 10 / unit), (kib * 10) % unit
        up = (r * 2 > unit) | ((r * 2 == unit) & (q % 2 == 1))
        return bind(q + F.when(up, 1).otherwise(0), tenths)
    n = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return (
        F.when(n.isNull() | (n < 0), text).when(n >= 1048576, scaled(n, 1048576, "G"))
        .when(n >= 1024, scaled(n, 1024, "M")).otherwise(F.concat(n.cast("string"), F.lit("K"))))


def usage_table(df: DataFrame) -> DataFrame:
    """``df`` lines by mount point; headers and short lines skipped, the last line wins."""
    rows = once(df, "f", fields(F.col("line"))).filter(
        (F.size("f") >= 6) & (field(F.col("f"), 0) != "Filesystem"))
    f = F.col("f")
    parsed = rows.select(
        "host", "line_no", field(f, 5).alias("mountpoint"), human_blocks(field(f, 1)).alias("size"),
        human_blocks(field(f, 2)).alias("used"), human_blocks(field(f, 3)).alias("avail"),
        field(f, 4).alias("use_percent"))
    return last_per_key(parsed, ["host", "mountpoint"], F.col("line_no")).drop("line_no")


def with_usage(mounts: DataFrame, usage: DataFrame) -> DataFrame:
    """Usage of real local file systems; '' where it does not apply or is unknown."""
    joined = mounts.join(usage, ["host", "mountpoint"], "left")
    local = ~is_pseudo(F.col("fstype")) & ~is_nfs(F.col("fstype"))
    return joined.select(*mounts.columns, *[
        F.when(local, F.coalesce(c, F.lit(""))).otherwise("").alias(c)
        for c in ("size", "used", "avail", "use_percent")])


def with_probe(mounts: DataFrame, probes: DataFrame) -> DataFrame:
    """Add ``stale`` for network mounts whose probe (host, device, stale) did not answer."""
    per_device = probes.groupBy("host", "device").agg(F.bool_or("stale").alias("stale"))
    joined = mounts.join(per_device, ["host", "device"], "left")
    return joined.withColumn("stale", is_nfs(F.col("fstype")) & F.coalesce("stale", F.lit(False)))


def kind_counts(mounts: DataFrame) -> DataFrame:
    real, nfs = ~is_pseudo(F.col("fstype")), is_nfs(F.col("fstype"))
    return mounts.groupBy("host").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(real).alias("real"), F.count_if(nfs).alias("nfs"),
        F.count_if(nfs & F.col("stale")).alias("stale_nfs"))


def pseudo_summary(mounts: DataFrame) -> DataFrame:
    """``proc×3, tmpfs×12`` per host; at most one entry per known type."""
    counts = mounts.filter(is_pseudo(F.col("fstype"))).groupBy("host", "fstype").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct("fstype", F.concat("fstype", F.lit("×"), F.col("n").cast("string")).alias("text"))
    return counts.groupBy("host").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["text"]), ", ").alias("pseudo_filesystems"))


def findings(mounts: DataFrame) -> DataFrame:
    """Full disks, stale network mounts, read-only mounts, remount-on-error; pseudo ones never."""
    pct = F.regexp_extract("use_percent", r"^([0-9]+)%$", 1).try_cast("int")
    options = F.split("options", ",")
    row = lambda cond, sev, text: F.when(cond, F.struct(
        F.lit(sev).alias("severity"), F.lit(text).alias("finding")))
    found = F.array_compact(F.array(
        row(pct >= CRITICAL_PERCENT, "critical", "disk almost full"),
        row((pct >= WARN_PERCENT) & (pct < CRITICAL_PERCENT), "warning", "disk filling up"),
        row(F.col("stale"), "critical", "network mount is stale"),
        row(F.array_contains(options, "ro") & ~F.col("mountpoint").rlike("^/(boot|sys)(/|$)"), "warning", "mounted read-only"),
        row(F.array_contains(options, "errors=remount-ro"), "warning", "remounts read-only on errors")))
    return mounts.filter(~is_pseudo(F.col("fstype"))).select("host", "mountpoint", F.inline(found))


def digest_line() -> Column:
    usage = F.when(F.col("size") != "", F.concat(
        F.lit("\nsize:        "), "size", F.lit("\nused:        "), "used", F.lit("  ("), "use_percent",
        F.lit(")\navailable:   "), "avail")).otherwise("")
    probe = F.when(is_nfs(F.col("fstype")), F.when(F.col("stale"), "\nnfs_status:  STALE").otherwise(
        "\nnfs_status:  responsive")).otherwise("")
    return F.concat(
        F.lit("device:      "), "device", F.lit("\nmountpoint:  "), "mountpoint", F.lit("\nfstype:      "), "fstype",
        F.lit("\noptions:     "), "options", usage, probe, F.lit("\n"))
