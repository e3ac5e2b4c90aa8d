"""Hard negatives by layers of rotated one-bit codes with stored alignment.

Method. A vector x is rotated by an isometry P (signed Hadamard rounds) and keeps one bit a
coordinate: u = P' sign(Px) / sqrt(D), a unit vector. Its alignment with x is stored as the weight
w = <u, x> = |x| cos(u, x). What it leaves, x - w u, is coded in the same way with a rotation of
its own, ``COPIES`` layers in all, and the length of what the last one leaves is stored too. With an
anchor y held as its rotations,

    <x, y> = sum_l w_l <u_l, y> + <r, y>,   |<r, y>| <= |r| |y|

by Cauchy-Schwarz, a fixed interval and no estimate of chance; rounding in single precision widens
it by its greatest size. Rows whose interval cannot reach an anchor's best so far are dropped, the
others get their integer score.

The anchors are a stated query set. They meet all rows in a grid: rows in slices of about
``SLICE_ROWS``, anchors in blocks of about ``BLOCK_ANCHORS``, one group a pair of them, so that no
group grows with the table or with a label. A group goes through its rows tile by tile and passes on
its best few rows for each anchor.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.llm.common import arrow_rows, keep

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Least and largest score of a negative, in hundredths of the positive's.
LOW, HIGH = 50, 95
ANCHOR_EVERY = 50
#: Rows and anchors of a group, fewer if vectors are longer than 64.
SLICE_ROWS = 8192
BLOCK_ANCHORS = 2048
#: Layers of codes, and rounds of signs and Hadamard in each.
COPIES = 6
ROUNDS = 3
SEED = 11
#: Squared norms from here on take no part: hundredfold scores would leave 64 bits.
TOO_LONG = 2.0 ** 56
#: Pairs scored at a time, and pairs whose intervals stand at a time.
PAIRS = 1 << 16
TILE = 1 << 19
#: Rows of the first tile.
FIRST_TILE = 64
#: Below all scores, and above all.
LEAST, MOST = -(1 << 62), 1 << 62


@functools.cache
def _signs(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice([-1.0, 1.0], (COPIES, ROUNDS, width))


@functools.cache
def _block(width: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < width:
        h = np.block([[h, h], [h, -h]])
    return h


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    h = min(width, 64)
    x = x.reshape(n, -1, h) @ _block(h)
    while h < width:
        x = x.reshape(n, -1, 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2)
        h *= 2
    return x.reshape(n, width) / math.sqrt(width)


def code_width(dims: int) -> int:
    """Dimensions padded to a power of two, 64 at least."""
    return max(64, 1 << max(0, dims - 1).bit_length())


def _turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Px of each row of ``x`` for the rotation of one layer."""
    for s in signs:
        x = _hadamard(x * s)
    return x


def _turned_back(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs[::-1]:
        x = _hadamard(x) * s
    return x


def rotated(x: np.ndarray) -> np.ndarray:
    """The rotations of all layers of each row of ``x`` (n x code_width) side by side, as one isometry."""
    return np.concatenate([_turned(x, signs) for signs in _signs(x.shape[1])], 1) / math.sqrt(COPIES)


def decoded(c: np.ndarray) -> np.ndarray:
    """``rotated`` taken back, layers added up."""
    parts = zip(_signs(c.shape[1] // COPIES), np.split(c, COPIES, 1))
    return sum(_turned_back(y, signs) for signs, y in parts) / math.sqrt(COPIES)


def encoded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words of all layers, their weights, and the length of what they leave, of the rows of ``x``."""
    root, left, bits, weights = math.sqrt(x.shape[1]), x, [], []
    for signs in _signs(x.shape[1]):
        y = _turned(left, signs)
        bits.append(y >= 0)
        weights.append(np.abs(y).sum(1) / root)
        left = left - weights[-1][:, None] * _turned_back(np.where(bits[-1], 1.0, -1.0) / root, signs)
    words = np.packbits(np.concatenate(bits, 1), axis=1, bitorder="little").view(np.uint64)
    return words, np.stack(weights, 1), np.sqrt((left * left).sum(1))


class Anchors:
    """Anchors as their rotations, in single precision."""

    def __init__(self, y: np.ndarray):
        self.norm = np.sqrt((y * y).sum(1))
        self.turned = rotated(y).astype(np.float32)

    def middles(self, at: np.ndarray, code: np.ndarray, weights: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middles and half widths of the intervals of each anchor of ``at`` with each row."""
        bits = 64 * code.shape[1]
        scale = np.repeat((weights * math.sqrt(COPIES * COPIES / bits)).astype(np.float32), bits // COPIES, 1)
        coded = np.where(np.unpackbits(code.view(np.uint8), axis=1, bitorder="little"), scale, -scale)
        # the greatest error of a product of so many terms in single precision, its factors' and its interval's rounding
        rounding = (2 * bits + 16) * 2.0 ** -24 * math.sqrt(COPIES) * np.sqrt((weights * weights).sum(1))
        return self.turned[at] @ coded.T, np.multiply.outer(self.norm[at].astype(np.float32), (left + rounding).astype(np.float32))

    def intervals(self, at: np.ndarray, code: np.ndarray, weights: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the score of each anchor of ``at`` with each row."""
        mid, half = self.middles(at, code, weights, left)
        return mid - half, mid + half

    def reaching(self, at: np.ndarray, floor: np.ndarray, *codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``at`` and of rows whose scores may be ``floor`` (one for each of ``at``) or more, and their lower bounds."""
        mid, half = self.middles(at, *codes)
        low = np.nextafter(floor.astype(np.float32), np.float32(-np.inf))
        i, j = np.nonzero(mid + half >= low[:, None])
        return i, j, mid[i, j] - half[i, j]


def _scores(x: np.ndarray, y: np.ndarray, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs."""
    out = np.empty(len(rows), np.int64)
    for lo in range(0, len(rows), PAIRS):
        part = slice(lo, lo + PAIRS)
        out[part] = np.einsum("ij,ij->i", x[rows[part]], y[anchors[part]])
    return out


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` of each group: higher scores, then smaller ids, then rows."""
    order = np.lexsort((rows, ids, -score, group))
    ranked = group[order]
    first = np.searchsorted(ranked, ranked)
    return order[np.arange(len(order)) - first < n]


class _Side:
    """Rows of one side of a group."""

    def __init__(self, table: pa.Table, width: int):
        self.row, self.id = table["_row"].to_numpy(), table["_id"].to_numpy()
        self.label = table["label"].to_numpy()
        raw = b"".join(table["x"].to_pylist())
        self.x = np.frombuffer(raw, np.int64).reshape(len(self.row), width)


def _codes(table: pa.Table) -> tuple[np.ndarray, ...]:
    code, weights = (b"".join(table[c].to_pylist()) for c in ("code", "weights"))
    return (np.frombuffer(code, np.uint64).reshape(len(table), -1), np.frombuffer(weights).reshape(len(table), -1),
            table["left"].to_numpy())


class _Best:
    """The first ``n`` rows of each group among those seen, and the least score that may still enter each."""

    def __init__(self, floor: np.ndarray, rows: _Side, n: int):
        self.floor, self.rows, self.n = floor.copy(), rows, n
        self.group, self.at, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        if not len(group):
            return
        group, at, score = (np.concatenate(c) for c in ((self.group, group), (self.at, at), (self.score, score)))
        top = _best(group, score, self.rows.id[at], self.rows.row[at], self.n)
        self.group, self.at, self.score = group[top], at[top], score[top]
        last = np.flatnonzero(np.bincount(self.group, minlength=len(self.floor)) == self.n)
        self.floor[last] = self.score[np.searchsorted(self.group, last, side="right") - 1]


def _tiles(places: np.ndarray, beside: int) -> Iterator[np.ndarray]:
    """``places`` in stretches of about ``TILE`` pairs with as many rows beside them; short ones first, to find floors."""
    lo, step, most = 0, FIRST_TILE, max(1, TILE // max(1, beside))
    while lo < len(places):
        yield places[lo:lo + min(step, most)]
        lo, step = lo + min(step, most), 2 * step


def _positives_of(rows: pa.Table, anchors: pa.Table, width: int) -> pa.Table:
    """Best same-label rows of a slice for each anchor of a block."""
    a, r = _Side(anchors, width), _Side(rows, width)
    codes, turned = _codes(rows), Anchors(a.x.astype(np.float64))
    best = _Best(np.full(len(a.row), LEAST), r, POSITIVES)
    by_label = np.argsort(r.label, kind="stable")
    labels = r.label[by_label]
    for label in np.unique(a.label):
        at = np.flatnonzero(a.label == label)
        for beside in _tiles(by_label[np.searchsorted(labels, label):np.searchsorted(labels, label, side="right")], len(at)):
            i, j, _ = turned.reaching(at, best.floor[at], *(c[beside] for c in codes))
            i, j = at[i], beside[j]
            other = a.row[i] != r.row[j]
            i, j = i[other], j[other]
            score = _scores(r.x, a.x, j, i)
            ok = score >= best.floor[i]
            best.add(i[ok], j[ok], score[ok])
    return pa.table({"anchor": a.row[best.group], "_row": r.row[best.at], "_id": r.id[best.at], "score": best.score})


def _negatives_of(rows: pa.Table, anchors: pa.Table, width: int) -> pa.Table:
    """Best different-label rows of a slice for each anchor and positive of a block."""
    a, r = _Side(anchors, width), _Side(rows, width)
    codes, turned = _codes(rows), Anchors(a.x.astype(np.float64))
    least, most = np.full((2, len(a.row), POSITIVES), [[[MOST]], [[LEAST]]])
    for i, scores in enumerate(anchors["positives"].to_pylist()):
        goal = np.array(scores, np.int64)
        least[i, :len(goal)], most[i, :len(goal)] = -(-LOW * goal // 100), HIGH * goal // 100
    least[least > most] = MOST  # of a positive below zero
    greatest = most.max(1)
    best = _Best(least.ravel(), r, NEGATIVES)
    everyone = np.arange(len(a.row))
    for beside in _tiles(np.arange(len(r.row)), len(a.row)):
        floor = best.floor.reshape(-1, POSITIVES)
        i, j, low = turned.reaching(everyone, floor.min(1), *(c[beside] for c in codes))
        j = beside[j]
        ok = (a.label[i] != r.label[j]) & (low <= greatest[i])
        i, j = i[ok], j[ok]
        score = _scores(r.x, a.x, j, i)
        pair, p = np.nonzero((score[:, None] >= floor[i]) & (score[:, None] <= most[i]))
        best.add(i[pair] * POSITIVES + p, j[pair], score[pair])
    return pa.table({"anchor": a.row[best.group // POSITIVES], "nth": (best.group % POSITIVES + 1).astype(np.int32),
                     "_row": r.row[best.at], "_id": r.id[best.at], "score": best.score})


def vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int]:
    """Rows that take part, with integer vectors and codes, in a kept table; and the padded width."""
    x = F.transform(table[vec_col], lambda v: F.floor(F.lit(SCALE) * v.cast("double")))
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    ids, label = table[id_col].cast("long"), table[label_col].cast("long")
    rows = table.filter(ids.isNotNull() & label.isNotNull() & table[vec_col].isNotNull() & F.forall(table[vec_col], number)).select(
        ids.alias("_id"), F.when(ids % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), x.alias("x"))
    short = rows.filter(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) < TOO_LONG)
    dims = short.agg(F.max(F.size("x"))).first()[0]
    width = code_width(dims or 0)

    def fold(ids, label, x):
        x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        whole = np.zeros((len(x), width), np.int64)
        sizes = np.diff(x.offsets.to_numpy())
        whole[np.arange(width)[None, :] < sizes[:, None]] = x.flatten().to_numpy(zero_copy_only=False)
        code, weights, left = encoded(whole.astype(np.float64))
        return pa.table({"_id": ids, "label": label, "left": left} | {
            c: pa.array([v.tobytes() for v in y], pa.binary()) for c, y in (("x", whole), ("code", code), ("weights", weights))})

    coded = short.mapInArrow(arrow_rows(fold, ["_id", "label", "x"]),
                             "_id long, label long, left double, x binary, code binary, weights binary")
    return keep(coded.withColumn("_row", F.monotonically_increasing_id()), "codes"), width


def _dealt(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n))


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _grid(rows: DataFrame, anchors: DataFrame, slices: int, blocks: int, fold, schema: str) -> DataFrame:
    left = rows.withColumn("slice", _dealt("_row", slices)).withColumn("block", _every(blocks))
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns of their own, as both sides are one table
    right = anchors.withColumn("block", _dealt("_row", blocks)).withColumn("slice", _every(slices))
    return left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInArrow(fold, schema)


def mine(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id or label, a null vector or any null or non-finite component take no part,
    nor do vectors whose scores would leave 64 bits. A shorter vector ends in zeros. Equal ids are
    rows of their own (ties go by the stored order), so a copy of an anchor may be its positive. An anchor
    without positives, or a positive without negatives, gives no rows; an empty table gives none.
    """
    rows, width = vectors(table, id_col, vec_col, label_col)
    queries = rows.filter(F.col("_id") % ANCHOR_EVERY == 0).select("_row", "_id", "label", "x")
    n, m = rows.count(), queries.count()
    slices, blocks = (max(1, -(-k * (width // 64) // most)) for k, most in ((n, SLICE_ROWS), (m, BLOCK_ANCHORS)))

    def folded(fold):
        return lambda r, a: fold(r, a, width) if len(r) and len(a) else fold(r.slice(0, 0), a.slice(0, 0), width)

    first = lambda *by: F.row_number().over(
        Window.partitionBy(*by).orderBy(F.desc("score"), "_id", "_row"))
    near = _grid(rows, queries, slices, blocks, folded(_positives_of), "anchor long, _row long, _id long, score long")
    positives = keep(near.withColumn("nth", first("anchor")).filter(F.col("nth") <= POSITIVES), "positives")
    goals = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "score"))).alias("p")).select(
        F.col("anchor").alias("_row"), F.col("p.score").alias("positives"))  # POSITIVES entries at most
    far = _grid(rows, queries.join(goals, "_row"), slices, blocks, folded(_negatives_of),
                "anchor long, nth int, _row long, _id long, score long")
    negatives = far.withColumn("rank", first("anchor", "nth")).filter(F.col("rank") <= NEGATIVES)
    named = positives.join(queries.select(F.col("_row").alias("anchor"), F.col("_id").alias("anchor_id")), "anchor").select(
        "anchor", "anchor_id", "nth", F.col("_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(negatives.select("anchor", "nth", "rank", F.col("_id").alias("negative_id"),
                                       F.col("score").alias("negative_score")), ["anchor", "nth"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: DuckDB SQL for ``mine`` over embeddings.
SQL = f"""
with rows as (
  select vec_id as id, row_number() over () as n,
    cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
    list_transform(embedding, lambda v: cast(floor({SCALE} * cast(v as double)) as bigint)) as x
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
pairs as (
  select a.n as anchor, a.id as anchor_id, b.n as other, b.id as other_id, a.label = b.label as same,
    cast(coalesce(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * coalesce(b.x[i], 0))), 0) as bigint) as score
  from rows a join rows b on a.id % {ANCHOR_EVERY} = 0 and a.n <> b.n),
positives as (
  select * from pairs where same
  qualify row_number() over (partition by anchor order by score desc, other_id, other) <= {POSITIVES})
select p.anchor_id, p.other_id as positive_id,
  cast(row_number() over (partition by p.anchor, p.other order by q.score desc, q.other_id, q.other) as integer) as rank,
  q.other_id as negative_id, p.score as positive_score, q.score as negative_score
from positives p join pairs q on q.anchor = p.anchor and not q.same
  and {LOW} * p.score <= 100 * q.score and 100 * q.score <= {HIGH} * p.score
qualify rank <= {NEGATIVES}"""
