"""Plan helpers that keep work spread out whatever the key distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.plans.session import materialise


def spread(df: DataFrame) -> DataFrame:
    """Use every core for per-row work on a scan with fewer splits than cores.

    A large scan already has more splits than the cluster has cores, and then
    nothing is shuffled. Only for scans and their projections: counting the partitions
    of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def spread_rows(df: DataFrame, rows: int) -> DataFrame:
    """Hands on at most about ``rows`` rows a task, for work that is dear beside the bytes it reads.

    Splits of a scan follow its bytes and end at row groups, so few bytes a row make few, long tasks. For scans,
    before the work: they are counted, which reads little, and shuffled.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def last_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Newest ``n`` rows per group.

    The ``rank <= n`` filter becomes a group limit below the shuffle, so a hot
    group sends at most n rows per input split.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the one with the smallest ``order`` (combined map-side)."""
    return _pick(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the one with the largest ``order`` (combined map-side)."""
    return _pick(df, keys, order, F.max_by)


def _pick(df: DataFrame, keys: Sequence[str], order: Column, by) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def carry_forward(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str,
                  chunk_rows: int = 65536) -> DataFrame:
    """Last non-null ``value`` at or before each row of a group, by dense ``order``.

    Groups are cut into chunks of ``order``; only one summary row per chunk is
    looked at group-wide, so a group of any size stays spread out.
    """
    cut = df.withColumn("_val", value).withColumn("_chunk", F.floor(F.col(order) / chunk_rows))
    per_chunk = cut.groupBy(*keys, "_chunk").agg(
        F.max_by("_val", F.when(F.col("_val").isNotNull(), F.col(order))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(
        *keys, "_chunk", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    here = Window.partitionBy(*keys, "_chunk").orderBy(order)
    return (
        cut.withColumn("_here", F.last("_val", ignorenulls=True).over(here))
        .join(carried, [*keys, "_chunk"], "left")
        .withColumn(name, F.coalesce("_here", "_before"))
        .drop("_val", "_chunk", "_here", "_before")
    )


def collapse_runs(df: DataFrame, keys: Sequence[str], order: str, value: str,
                  chunk_rows: int = 65536) -> DataFrame:
    """Runs of consecutive equal values per group: keys, run_start, value, run_length.

    ``order`` is a whole number. Runs are found inside chunks of it and only the runs
    that touch a chunk edge are stitched group-wide (two rows per chunk at most).
    """
    cut = df.select(*keys, order, value, F.floor(F.col(order) / chunk_rows).alias("_chunk"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    marked = cut.withColumn(
        "_new", F.when(F.lag(value).over(inside).eqNullSafe(F.col(value))
                       & F.lag(order).over(inside).isNotNull(), 0).otherwise(1))
    local = (
        marked.withColumn("_run", F.sum("_new").over(inside))
        .groupBy(*keys, "_chunk", "_run", value)
        .agg(F.min(order).alias("run_start"), F.count(F.lit(1)).alias("run_length"))
    )
    bounds = local.groupBy(*keys, "_chunk").agg(F.max("_run").alias("_last"))
    local = local.join(bounds, [*keys, "_chunk"])
    edge = (F.col("_run") == 1) | (F.col("_run") == F.col("_last"))
    across = Window.partitionBy(*keys).orderBy("_chunk", "_run")
    joined = local.filter(edge).withColumn(
        "_new",
        # only the first run of a chunk can continue the last run of the chunk before
        F.when((F.col("_run") == 1) & F.lag("_chunk").over(across).isNotNull()
               & F.lag(value).over(across).eqNullSafe(F.col(value)), 0).otherwise(1),
    ).withColumn("_group", F.sum("_new").over(across))
    stitched = joined.groupBy(*keys, "_group", value).agg(
        F.min("run_start").alias("run_start"), F.sum("run_length").alias("run_length"))
    cols = [*keys, "run_start", value, "run_length"]
    return local.filter(~edge).select(*cols).unionByName(stitched.select(*cols))


def running_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                  name: str) -> DataFrame:
    """1-based position of each row in its group.

    ``bucket`` must not decrease along ``order`` (``range_buckets`` makes one). Rows are numbered inside buckets and
    shifted by the sizes of the buckets before, so a hot group is not sorted by one task.
    """
    cut = df.withColumn("_bucket", bucket)
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        cut.withColumn("_pos", F.row_number().over(inside))
        .join(shifts, [*keys, "_bucket"])
        .withColumn(name, F.col("_pos") + F.col("_shift"))
        .drop("_bucket", "_pos", "_shift")
    )


#: Bits of a key filter for each wanted key, and in all (2^27 bits are 16 MB).
FILTER_BITS_A_KEY, FILTER_BITS = 16, (16, 27)


def may_be_wanted(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose key is among those of ``wanted``, and a few others; nothing of them is shuffled.

    A bitmap of hashed keys goes to the scan, in pieces of 32,768 bits. Its size follows the number
    of wanted keys up to a fixed bound; beyond that more of the others pass. ``wanted`` is read twice.
    """
    n = wanted.count()
    low, high = FILTER_BITS
    bits = min(max((FILTER_BITS_A_KEY * n).bit_length(), low), high)
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << bits))
    maps = wanted.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    placed = df.withColumn("_place", place).withColumn("_piece", F.bitmap_bucket_number("_place"))
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8) + 1, F.lit(1))), 16, 10).cast("int")
    met = placed.join(F.broadcast(maps), "_piece")  # 16 MB at most
    return met.filter(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_place", "_piece", "_bits")


def range_buckets(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_bucket") -> DataFrame:
    """Rows with a bucket that does not decrease along (keys, order), from a sampled range partitioning.

    Buckets are about equal in rows however bursty a key is, because a burst is cut at any
    row. They are written once, as a later evaluation could cut elsewhere.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(parts, *keys, *order).withColumn(name, F.spark_partition_id()), "ordered")


def balanced_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_rows: int,
                    name: str = "chunk") -> DataFrame:
    """Cut each group into consecutive slices of ``chunk_rows`` rows along ``order``.

    A group of no more rows stays whole, as slice 0; ``<name>s_many`` says whether it was cut.
    """
    cut = range_buckets(df, keys, order)
    at = running_index(cut, keys, order, F.col("_bucket"), "_at")
    totals = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    return at.join(totals, list(keys)).withColumns({
        f"{name}s_many": F.col("_total") > chunk_rows,
        name: F.floor((F.col("_at") - 1) / chunk_rows).cast("bigint")}).drop("_at", "_total")
