"""Snapshot audit: baselines, diffs, the change feed and its summaries.

Snapshot tables are long, keyed by (host, snapshot_id): services/ports/users carry
``item``, files (path, mtime, size), perms (path, mode, owner, grp), packages ``line``.
Each diff reads both snapshots once and aggregates by the entry's own key, so a large
host spreads over its entries and rows combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from opslake.functions.redact import sanitise
from opslake.functions.text import once, trim
from opslake.plans.partitioning import last_per_key
from opslake.plans.session import materialise

# Snapshot format, scan scope and report limits.
BASELINE_VERSION = 1
DEFAULT_DIRS = ["/etc", "/usr/local/bin", "/usr/local/sbin"]
MAX_DEPTH = 5
SHOWN_PER_CATEGORY = 20
CATEGORIES = ["services", "files", "permissions", "ports", "packages", "users"]
CHANGES = [
    ("service", "added"), ("service", "removed"),
    ("file", "added"), ("file", "removed"), ("file", "modified"),
    ("permission", "changed"),
    ("package", "added"), ("package", "removed"), ("package", "updated"),
    ("port", "opened"), ("port", "closed"),
    ("user", "added"), ("user", "removed"),
]

FEED_COLUMNS = {
    "host": "string", "category": "string", "change": "string", "item": "string",
    "old_mtime": "bigint", "new_mtime": "bigint", "old_size": "bigint", "new_size": "bigint",
    "old_mode": "string", "new_mode": "string", "old_owner": "string", "new_owner": "string",
    "old_grp": "string", "new_grp": "string", "old_version": "string", "new_version": "string",
}
SANITISED_COLUMNS = ["item", "old_owner", "new_owner", "old_grp", "new_grp", "old_version", "new_version"]


class MissingBaseline(Exception):
    """No baseline was ever written at this path."""


class IncompatibleBaseline(Exception):
    """The baseline was written with another format version."""


def _side(df: DataFrame, keys: Sequence[str], values: Sequence[str], old: int, new: int,
          order: str | None) -> DataFrame:
    """One row per key with structs ``o`` and ``n`` (null where absent in that snapshot)."""
    pack = F.struct(*[F.col(v) for v in values])

    def pick(snapshot: int) -> Column:
        mine = F.when(F.col("snapshot_id") == snapshot, pack)
        if order is None:
            return F.max(mine)
        return F.max_by(mine, F.when(F.col("snapshot_id") == snapshot, F.col(order)))
    return (df.filter(F.col("snapshot_id").isin(old, new)).groupBy(*keys)
            .agg(pick(old).alias("o"), pick(new).alias("n")))


def diff_sets(df: DataFrame, old: int = 1, new: int = 2, added: str = "added",
              removed: str = "removed") -> DataFrame:
    """(host, change, item) for items present in only one snapshot; repeats do not matter."""
    seen = df.filter(F.col("snapshot_id").isin(old, new)).groupBy("host", "item").agg(
        F.bool_or(F.col("snapshot_id") == old).alias("was"),
        F.bool_or(F.col("snapshot_id") == new).alias("is"))
    return seen.filter(F.col("was") != F.col("is")).select(
        "host", F.when(F.col("is"), added).otherwise(removed).alias("change"), "item")


def diff_files(df: DataFrame, old: int = 1, new: int = 2, order: str | None = None) -> DataFrame:
    """Added, removed, and modified (mtime or size differs) files with both sides' values."""
    both = _side(df, ["host", "path"], ["mtime", "size"], old, new, order)
    change = (F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed")
              .when((F.col("o.mtime") != F.col("n.mtime")) | (F.col("o.size") != F.col("n.size")), "modified"))
    return both.withColumn("change", change).filter("change is not null").select(
        "host", "change", "path",
        F.col("o.mtime").alias("old_mtime"), F.col("n.mtime").alias("new_mtime"),
        F.col("o.size").alias("old_size"), F.col("n.size").alias("new_size"))


def diff_permissions(df: DataFrame, old: int = 1, new: int = 2, order: str | None = None) -> DataFrame:
    """Paths in both snapshots whose mode, owner or group differs; every current row counts."""
    was = df.filter(F.col("snapshot_id") == old)
    was = last_per_key(was, ["host", "path"], F.col(order) if order else F.struct("mode", "owner", "grp"))
    was = was.select("host", "path", *[F.col(c).alias(f"old_{c}") for c in ("mode", "owner", "grp")])
    now = df.filter(F.col("snapshot_id") == new).select(
        "host", "path", *[F.col(c).alias(f"new_{c}") for c in ("mode", "owner", "grp")])
    differs = reduce(lambda a, b: a | b, [
        F.col(f"old_{c}") != F.col(f"new_{c}") for c in ("mode", "owner", "grp")])
    return now.join(was, ["host", "path"]).filter(differs)


def parse_package(line: Column) -> Column:
    """struct(name, version): split at the first space, version '' when there is none."""
    text = trim(line)
    at = F.instr(text, " ")
    return F.struct(
        F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("name"),
        F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise("").alias("version"))


def diff_packages(df: DataFrame, old: int = 1, new: int = 2, order: str = "line_no") -> DataFrame:
    """Added, removed and updated packages; the last line of a name wins."""
    named = df.filter(trim(F.col("line")) != "").withColumn("p", parse_package(F.col("line"))).select(
        "host", "snapshot_id", order, F.col("p.name").alias("name"), F.col("p.version").alias("version"))
    both = _side(named, ["host", "name"], ["version"], old, new, order)
    change = (F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed")
              .when(F.col("o.version") != F.col("n.version"), "updated"))
    item = F.when(F.col("o").isNull(), F.concat_ws(" ", "name", "n.version")).when(
        F.col("n").isNull(), F.concat_ws(" ", "name", "o.version")).otherwise(F.col("name"))
    updated = F.col("change") == "updated"
    return both.withColumn("change", change).filter("change is not null").select(
        "host", "change", item.alias("item"),
        F.when(updated, F.col("o.version")).alias("old_version"),
        F.when(updated, F.col("n.version")).alias("new_version"))


# What the entries of each category carry besides their key.
_VALUES = {"mtime": "bigint", "size": "bigint", "mode": "string", "owner": "string", "grp": "string", "version": "string"}
_ENTERED = {"port": ("opened", "closed")}


def _entries(df: DataFrame, category: str, key: Column, values: dict[str, Column], order: Column | None = None,
             times: Column | None = None) -> DataFrame:
    """Entries of a category in the long form: host, category, key, snapshot_id, v (order and values), times."""
    given = [values.get(c, F.lit(None).cast(t)).cast(t).alias(c) for c, t in _VALUES.items()]
    return df.select(
        "host", F.lit(category).alias("category"), key.alias("key"), "snapshot_id",
        F.struct((order if order is not None else F.lit(None)).cast("bigint").alias("ord"), *given).alias("v"),
        (times if times is not None else F.lit(1)).cast("bigint").alias("times"))


def change_feeds(services: DataFrame, files: DataFrame, perms: DataFrame, packages: DataFrame, ports: DataFrame,
                 users: DataFrame, snapshots: Sequence[int]) -> DataFrame:
    """The changes between each two snapshots in a row: old_snapshot, new_snapshot, and the columns of the feed.

    Every table is read once, however many snapshots: all entries go into one aggregation by
    (host, category, key, pair of snapshots), where an entry counts as new in one pair and as old in the
    next, and the categories differ only in what they compare.
    """
    if len(snapshots) < 2:
        raise ValueError("changes need at least two snapshots")
    attributes = ("mode", "owner", "grp")
    # equal rows of a path are counted first, so that a path has one entry for each different value
    modes = perms.groupBy("host", "snapshot_id", "path", *attributes).agg(F.count(F.lit(1)).alias("times"))
    named = packages.filter(trim(F.col("line")) != "").withColumn("p", parse_package(F.col("line")))
    every = reduce(DataFrame.unionByName, [
        _entries(services, "service", F.col("item"), {}),
        _entries(files, "file", F.col("path"), {c: F.col(c) for c in ("mtime", "size")}),
        _entries(modes, "permission", F.col("path"), {c: F.col(c) for c in attributes}, times=F.col("times")),
        _entries(named, "package", F.col("p.name"), {"version": F.col("p.version")}, F.col("line_no")),
        _entries(ports, "port", F.col("item"), {}), _entries(users, "user", F.col("item"), {})])
    pairs = list(zip(snapshots, snapshots[1:]))
    sides = F.array(*[F.struct(F.lit(s).alias("at"), F.lit(p).alias("pair"), F.lit(is_new).alias("new"))
                      for p, pair in enumerate(pairs) for s, is_new in zip(pair, (False, True))])
    mine = F.filter(sides, lambda x: x["at"] == F.col("snapshot_id"))
    dealt = every.filter(F.col("snapshot_id").isin(list(snapshots))).withColumn("side", F.explode(mine))
    last = lambda is_new: F.max(F.when(F.col("side.new") == is_new, F.col("v")))
    met = dealt.groupBy("host", "category", "key", F.col("side.pair").alias("pair")).agg(
        last(False).alias("o"), last(True).alias("n"),
        F.collect_list(F.when((F.col("category") == "permission") & F.col("side.new"), F.struct("v", "times"))).alias("now"))
    o, n, category = F.col("o"), F.col("n"), F.col("category")
    differs = lambda a, b, cols: reduce(lambda x, y: x | y, [a[c] != b[c] for c in cols])
    opened, closed = [F.coalesce(*[F.when(category == c, w[i]) for c, w in _ENTERED.items()], F.lit(w0))
                      for i, w0 in enumerate(("added", "removed"))]
    change = (
        F.when(category == "permission", F.when(o.isNotNull() & n.isNotNull(), "changed"))
        .when(o.isNull(), opened).when(n.isNull(), closed)
        .when((category == "file") & differs(o, n, ("mtime", "size")), "modified")
        .when((category == "package") & (o["version"] != n["version"]), "updated"))
    # every current row of a path counts, the other categories have one current value
    changed = F.filter("now", lambda x: differs(o, x["v"], attributes))
    rows = F.when(category == "permission", F.flatten(F.transform(changed, lambda x: F.array_repeat(x["v"], x["times"].cast("int")))))
    found = met.withColumn("change", change).filter("change is not null").withColumn(
        "row", F.explode(F.coalesce(rows, F.array(n))))
    old, new, text = pair_columns(pairs), F.col("row"), F.concat_ws(" ", "key", F.coalesce("n.version", "o.version"))
    both = lambda cols, when: [x for c in cols for x in (
        F.when(when, o[c]).alias(f"old_{c}"), F.when(when, new[c]).alias(f"new_{c}"))]
    return found.select(
        *old, "host", "category", "change",
        F.when((category == "package") & (F.col("change") != "updated"), text).otherwise(F.col("key")).alias("item"),
        *both(("mtime", "size"), category == "file"), *both(attributes, category == "permission"),
        *both(("version",), F.col("change") == "updated"))


def pair_columns(pairs: Sequence[tuple[int, int]]) -> list[Column]:
    return [F.element_at(F.array(*[F.lit(p[i]) for p in pairs]), F.col("pair") + 1).alias(c)
            for i, c in enumerate(("old_snapshot", "new_snapshot"))]


def change_feed(services: DataFrame, files: DataFrame, perms: DataFrame, packages: DataFrame,
                ports: DataFrame, users: DataFrame, old: int = 1, new: int = 2) -> DataFrame:
    """All six diffs of two snapshots as one long table."""
    return change_feeds(services, files, perms, packages, ports, users, [old, new]).select(*FEED_COLUMNS)


def permission_detail() -> Column:
    """``mode a→b, owner c→d`` for the attributes that changed."""
    def part(label: str, col: str) -> Column:
        o, n = F.col(f"old_{col}"), F.col(f"new_{col}")
        return F.when(o != n, F.concat(F.lit(f"{label} "), o, F.lit("→"), n))
    return F.array_join(F.array(part("mode", "mode"), part("owner", "owner"), part("group", "grp")), ", ")


def change_text() -> Column:
    """One display line per change."""
    item = F.col("item")
    # The wording of the lines.
    return (
        F.when(F.col("change") == "modified", F.concat(
            item, F.lit("  (size: "), F.col("old_size").cast("string"), F.lit(" → "),
            F.col("new_size").cast("string"), F.lit(" bytes, mtime changed: "),
            (F.col("old_mtime") != F.col("new_mtime")).cast("string"), F.lit(")")))
        .when(F.col("category") == "permission", F.concat(item, F.lit("  ("), permission_detail(), F.lit(")")))
        .when(F.col("change") == "updated", F.concat(
            item, F.lit("  ("), F.col("old_version"), F.lit(" → "), F.col("new_version"), F.lit(")")))
        .otherwise(item))


def _all_changes() -> Column:
    return F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k).alias("change")) for c, k in CHANGES])


def change_totals(feed: DataFrame, hosts: DataFrame) -> DataFrame:
    """Counts per host, category and change with zeros filled in, and every subtotal.

    A host is unchanged when its (all)/(all) row is 0.
    """
    counted = feed.groupBy("host", "category", "change").agg(F.count(F.lit(1)).alias("n"))
    zeros = hosts.select("host", F.inline(_all_changes())).withColumn("n", F.lit(0).cast("bigint"))
    rolled = counted.unionByName(zeros).rollup("host", "category", "change").agg(F.sum("n").alias("n"))
    return rolled.select(
        *[F.coalesce(F.col(c), F.lit("(all)")).alias(c) for c in ("host", "category", "change")], "n")


def capped_feed(feed: DataFrame, shown: int = SHOWN_PER_CATEGORY) -> DataFrame:
    """First ``shown`` lines per host and list, with how many more there are.

    The report shows a fixed number of lines; the count of the rest is exact.
    """
    lists = ["host", "category", "change"]
    feed = materialise(feed.select(*lists, "item", change_text().alias("text")), "feed")  # built once, read twice
    counts = feed.groupBy(*lists).agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy(*lists).orderBy("item", "text")
    first = (
        feed.withColumn("shown_no", F.row_number().over(w)).filter(F.col("shown_no") <= shown))
    return first.join(counts, lists).select(
        *lists, "shown_no", "text", F.greatest(F.col("total") - shown, F.lit(0)).alias("more"))


def baseline_age(created: Column, as_of: Column) -> Column:
    """Whole seconds between the baseline and ``as_of``."""
    return F.timestamp_diff("SECOND", created, as_of)


def age_text(seconds: Column) -> Column:
    """``2d 3h``, ``4h 5m``, ``just now``; minutes only below a day."""
    minutes = F.floor(seconds / 60)
    days, hours, rest = F.floor(minutes / 1440), F.floor(minutes / 60) % 24, minutes % 60
    part = lambda n, unit, cond: F.when(cond, F.concat(n.cast("string"), F.lit(unit)))
    return F.when(minutes <= 0, "just now").otherwise(F.array_join(F.array(
        part(days, "d", days > 0), part(hours, "h", hours > 0),
        part(rest, "m", (rest > 0) & (days == 0))), " "))


def snapshot_rows(services: DataFrame, files: DataFrame, perms: DataFrame, packages: DataFrame,
                  ports: DataFrame, users: DataFrame, snapshot_id: int) -> DataFrame:
    """(host, category, entry) of one snapshot."""
    def rows(df: DataFrame, category: str, col: str) -> DataFrame:
        return df.filter(F.col("snapshot_id") == snapshot_id).select(
            "host", F.lit(category).alias("category"), F.col(col).alias("entry"))
    return reduce(DataFrame.unionByName, [
        rows(services, "services", "item"), rows(files, "files", "path"), rows(perms, "permissions", "path"),
        rows(ports, "ports", "item"), rows(packages, "packages", "line"), rows(users, "users", "item")])


def build_snapshot(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """Entries, status and error per host and category; a failed category stays visible."""
    counts = rows.groupBy("host", "category").agg(F.count(F.lit(1)).alias("entries"))
    hosts = rows.select("host").union(errors.select("host")).distinct()
    grid = hosts.select("host", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
    return grid.join(counts, ["host", "category"], "left").join(errors, ["host", "category"], "left").select(
        "host", "category", F.coalesce("entries", F.lit(0)).alias("entries"),
        F.coalesce("error", F.lit("")).alias("error"),
        F.when(F.col("error").isNotNull(), "failed").when(F.col("entries").isNull(), "empty")
        .otherwise("collected").alias("status"))


def baseline_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("host").agg(*[
        F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])


def in_scope(files: DataFrame, dirs: Sequence[str] = (), depth: int = MAX_DEPTH) -> DataFrame:
    """Files below one of the watched directories, at most ``depth`` levels down."""
    def below(root: str) -> Column:
        rel = F.substring(F.col("path"), F.lit(len(root) + 2), F.length("path"))
        return F.col("path").startswith(root + "/") & (F.size(F.split(rel, "/")) <= depth)
    # one predicate per directory of the argument: no join, and prefixes can reach the scan
    return files.filter(reduce(lambda a, b: a | b, [below(d.rstrip("/")) for d in (dirs or DEFAULT_DIRS)]))


def parse_dirs(raw: str) -> list[str]:
    return [p.strip() for p in raw.split(",") if p.strip()]


def parse_listing(df: DataFrame, line: str = "line") -> DataFrame:
    """``mtime size path`` lines as typed rows; rows that do not parse are skipped."""
    parts = F.split(trim(F.col(line)), " ", 3)
    stamp = F.when(F.get(parts, F.lit(0)).rlike(r"^[+-]?\d+(\.\d*)?([eE][+-]?\d+)?$"),
                   F.get(parts, F.lit(0)).try_cast("double").cast("bigint"))
    return df.select("*", stamp.alias("mtime"), F.get(parts, F.lit(1)).try_cast("bigint").alias("size"),
                     F.get(parts, F.lit(2)).alias("path")).filter(
        "mtime is not null and size is not null and path is not null").drop(line)


def change_severity() -> Column:
    """critical for immediate security risk, warning for review, info for routine changes."""
    cat, change, mode = F.col("category"), F.col("change"), F.col("new_mode")
    port = F.regexp_extract("item", r":(\d+)$", 1).try_cast("int")
    suid = mode.rlike("^[0-7]*[4-7][0-7]{3}$")
    world_writable = mode.rlike("[2367]$")
    mode_changed = F.col("old_mode") != mode
    return (
        F.when((cat == "port") & (change == "opened") & (port < 1024), "critical")
        .when((cat == "permission") & mode_changed
              & (suid | (world_writable & (F.col("new_owner") == "root"))), "critical")
        .when((cat == "user") & (change == "added"), "critical")
        .when((cat == "permission") | ((cat == "port") & (change == "opened"))
              | ((cat == "file") & change.isin("modified", "removed"))
              | ((cat == "service") & (change == "removed")) | (cat == "user"), "warning")
        .otherwise("info"))


def sanitised_changes(feed: DataFrame) -> DataFrame:
    """The feed with every text field redacted and every number and mode kept."""
    texts = F.transform(F.array(*SANITISED_COLUMNS), lambda t: sanitise(t))
    at = {c: i for i, c in enumerate(SANITISED_COLUMNS)}
    return once(feed, "_texts", texts).select(*[
        F.get("_texts", F.lit(at[c])).alias(c) if c in at else F.col(c) for c in feed.columns])


def write_baseline(df: DataFrame, path: str, version: int = BASELINE_VERSION) -> None:
    """Write one snapshot table to a new path, clustered by host so reads can skip files.

    The ranges also follow the first other column, so that a large host is cut.
    """
    order = ["host", *[c for c in df.columns if c != "host"][:1]]
    (df.withColumn("version", F.lit(version)).repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("errorifexists").parquet(path))


def read_baseline(spark: SparkSession, path: str, version: int = BASELINE_VERSION) -> DataFrame:
    """Read a baseline; a missing one and one of another version are different errors."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise MissingBaseline(f"no baseline at {path}") from e
    stored = df.filter(F.col("version") != version).select("version").head()
    if stored is not None:
        raise IncompatibleBaseline(f"baseline version {stored[0]}, expected {version}")
    return df.drop("version")
