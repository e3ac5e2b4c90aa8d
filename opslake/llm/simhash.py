"""Near duplicates by 64-bit SimHash, found by exact tiled comparison.

Method. Distinct fingerprints are compared in tiles with numpy exclusive-or and bit counts;
rows lie in order of their population count, and two tiles whose counts differ by more than
the radius are skipped. Tiles are cut inside blocks: two fingerprints that differ in at most
three bits agree in one of four 16-bit blocks, and in one of four 12-bit parts of the other
48 bits, so each fingerprint is dealt to 16 blocks of 28 known bits and no pair is lost.
A block above ``TILE`` rows is dealt to tasks tile pair by tile pair, so that no task takes
more than two tiles. A task passes on a spanning forest of what it linked, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.llm.common import arrow_rows, components, free_name, keep, keyed, numbered

RADIUS = 3
SHINGLE = 3
SEED = 42
TILE = 4096
SUB = 512
SHIFTS = 24


def shingle_hashes(data: bytes, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of every word shingle of a text, in pieces."""
    words = data.lower().split()
    if not words:
        return
    if len(words) < width:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    ends = ends[width - 1:]
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(starts), 1 << 16):
        pairs = zip(starts[lo:lo + (1 << 16)].tolist(), ends[lo:lo + (1 << 16)].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)


def fingerprint(data: bytes, width: int = SHINGLE) -> int:
    """Bits set in more than half of the shingle hashes; 0 for a text without words."""
    total, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(data, width):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:  # sums of 255 bits fit a byte
            ones += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += bits[whole:].sum(0, dtype=np.int64)
        total += len(h)
    bits = np.packbits((ones * 2 > total).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: _row, _id, fp. A null text has no words."""
    def fold(rows, ids, texts):
        fps = [fingerprint((t or "").encode("utf-8")) for t in texts.to_pylist()]
        return pa.table({"_row": rows, "_id": ids, "fp": pa.array(fps, pa.int64())})

    rows = keyed(docs, id_col, text_col)
    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(arrow_rows(fold, ["_row", "_id", "_text"]), f"_row long, _id {kind}, fp long")


def _blocks(fp: Column) -> Column:
    """The 16 block keys of a fingerprint."""
    keys = []
    for i in range(4):
        known = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF)
        low = fp.bitwiseAND((1 << 16 * i) - 1)
        high = F.shiftleft(F.shiftrightunsigned(fp, 16 * (i + 1)), 16 * i) if i < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high)
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF)
            keys.append(F.shiftleft(known, 12).bitwiseOR(part) + F.lit((4 * i + j) << 28))
    return F.array(*keys)


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; ``labels`` holds the least index of each set."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        a, b = a[differ], b[differ]
        if not len(a):
            return
        np.minimum.at(labels, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
        while True:
            nxt = labels[labels]
            if (nxt == labels).all():
                break
            labels[:] = nxt


def link_sorted(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (indices) among rows of equal ``group``; rows come by group, then bit count."""
    n = len(fp)
    labels = np.arange(n)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    small = np.repeat(sizes <= SHIFTS, sizes)
    for d in range(1, min(SHIFTS, int(sizes.max(initial=0)))):
        at = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= radius]
        _merge(labels, near, near + d)
    for s, size in zip(starts[sizes > SHIFTS].tolist(), sizes[sizes > SHIFTS].tolist()):
        ones = np.bitwise_count(fp[s:s + size]).astype(np.int64)
        for i in range(0, size, SUB):
            top = ones[min(i + SUB, size) - 1]
            for j in range(i, size, SUB):
                if ones[j] - top > radius:
                    break
                x = np.bitwise_count(fp[s + i:s + min(i + SUB, size), None] ^ fp[None, s + j:s + min(j + SUB, size)])
                a, b = np.nonzero(x <= radius)
                if len(a):
                    _merge(labels, a + s + i, b + s + j)
    a = np.flatnonzero(labels != np.arange(n))
    return a, labels[a]


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of whole groups; the last group of a batch waits for its rest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(key, tile, fp):
        change = np.concatenate(([True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])))
        a, b = link_sorted(np.cumsum(change), fp.view(np.uint64))
        return pa.record_batch([pa.array(fp[a]), pa.array(fp[b])], schema=schema)

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate((h, batch.column(c).to_numpy())) for h, c in zip(held, ("key", "tile", "fp"))]
        key, tile, fp = held
        last = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))
        if len(last):
            cut = last[-1] + 1
            yield linked(key[:cut], tile[:cut], fp[:cut])
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield linked(*held)


def links(fps: DataFrame, tile_rows: int = TILE) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within the radius of each other."""
    dealt = fps.select("fp", F.bit_count("fp").alias("ones"), F.explode(_blocks(F.col("fp"))).alias("key"))
    large = dealt.groupBy("key").count().filter(F.col("count") > tile_rows).select("key")
    rest = dealt.join(large, "key", "left_anti").withColumn("tile", F.lit(0).cast("long"))
    hot = dealt.join(large, "key", "left_semi")
    cuts = hot.groupBy("key", "ones").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("cuts"))
    own = hot.join(cuts, ["key", "ones"]).withColumn("slot", F.pmod(F.xxhash64("fp"), F.col("cuts")))
    beside = cuts.select("key", F.col("ones").alias("other"), F.col("cuts").alias("other_cuts"))
    paired = (
        own.withColumn("other", F.explode(F.sequence(F.col("ones") - RADIUS, F.col("ones") + RADIUS)))
        .join(beside, ["key", "other"])
        .withColumn("other_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_cuts") - 1)))
    )
    name = lambda ones, slot: F.shiftleft(F.col(ones).cast("long"), 24) + F.col(slot)
    pair = paired.withColumn("x", name("ones", "slot")).withColumn("y", name("other", "other_slot")).withColumn(
        "tile", F.shiftleft(F.least("x", "y") + 1, 31) + F.greatest("x", "y") + 1)
    cols = ["key", "tile", "ones", "fp"]
    tiles = rest.select(*cols).unionByName(pair.select(*cols))
    return tiles.repartition("key", "tile").sortWithinPartitions("key", "tile", "ones", "fp").select(
        "key", "tile", "fp").mapInArrow(_link_batches, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest id reachable over links of at most three differing bits.
    Null and empty texts have fingerprint zero and are linked like any other; equal rows stay
    rows of their own in one component; a null id never names a component unless all ids of
    it are null. An empty table gives no rows.
    """
    of_docs = keep(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = keep(of_docs.groupBy("fp").agg(F.min("_id").alias("first_id")), "distinct-fp")
    labels = components(links(distinct)).select(F.col("node").alias("fp"), "label")
    known = distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = known.join(least, "label").select("fp", "component_id")
    return of_docs.join(classes, "fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with one of each near-duplicate group: that of the smallest row key.

    All columns come back unchanged, whatever they are called.
    """
    row = free_name(docs, "_row")
    rows = numbered(docs, id_col, row)
    stay = near_duplicates(rows, row, text_col).filter(F.col(row) == F.col("component_id")).select(row)
    return rows.join(stay, row, "left_semi").drop(row)
