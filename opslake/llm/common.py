"""What the operators share: row keys, kept copies, Arrow passes and graph components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.plans.session import scratch_path


#: Rows whose texts are Python objects at a time.
SLICE_ROWS = 500


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, id_col: str, name: str = "_row") -> DataFrame:
    """``df`` with a unique long ``name`` as its last column; it must be free in ``df``.

    The id is the row key where it is a whole number, never null and never repeated;
    else the rows are numbered in a kept copy.
    """
    if dict(df.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        ids = df.select(df[id_col].alias("_id"))
        if ids.groupBy("_id").count().filter("_id is null or count > 1").isEmpty():
            return df.withColumn(name, df[id_col].cast("long"))
    return keep(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``_row`` (unique long), ``_id`` and ``_text`` of any table.

    Other columns, whatever they are called, go.
    """
    narrow = df.select(df[id_col].alias("_id"), df[text_col].alias("_text"))
    return numbered(narrow, "_id").select("_row", "_id", "_text")


def utf8_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` entries of an array of structs, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def arrow_rows(fn: Callable[[dict], Iterator[dict]] | Callable, columns: list[str]):
    """A mapInArrow function from one that maps columns of a batch to an Arrow table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            yield from fn(*[part.column(c) for c in columns]).to_batches()
    return run


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut small, as their texts become Python objects a slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, and where each row starts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def sets_of_rows(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each; a longer row stands alone."""
    lo = 0
    n = len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of ``edges`` (a, b long): node, label.

    Alternating stars: every round points a node's larger neighbours, then its smaller ones,
    at its least neighbour, until the edges are stars. A round moves as many rows as there
    are edges, whatever the length of chains, and is kept in the shared folder.
    """
    cur = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
               .filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        large = (both.filter("b > a").withColumnRenamed("a", "u").join(least, "u")
                 .select(F.least("u", "m").alias("a"), "b").filter("a <> b").distinct())
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(low, "u").select("m", "v").filter("m <> v")
                 .unionByName(low.select("m", F.col("u").alias("v"))))
        cur = keep(small.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "edges")
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return cur.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
        cur.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
