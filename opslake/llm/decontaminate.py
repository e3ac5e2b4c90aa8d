"""Benchmark passages in documents, found by q-gram counting and banded alignment.

Method (q-gram lemma). An item of m characters that occurs with at most k edits shares at least
m - q + 1 - kq of its q-grams with the text, on diagonals (text place minus item place) that lie
within k of each other. Shared q-grams are counted per item in overlapping bands of diagonals;
bands that reach the bound are retained, and an alignment over the band's diagonals verifies them.

The benchmark is a stated query set: it goes to the tasks in blocks of bounded size, and every
block is searched in every document. Texts are compared in lower case with white space as spaces.
"""

from __future__ import annotations

import bisect
import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.llm.common import keep, keyed, sliced

Q = 8
#: Edits allowed per character of an item.
ERROR_RATE = 0.1
#: Characters of items sent to the tasks at once.
BLOCK_CHARS = 4 << 20
#: Characters of documents searched together.
TEXT_CHARS = 1 << 18
TABLE_BITS = 22
_MULT = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _folding() -> np.ndarray:
    """Code point to code point: lower case where that is one character, white space to a space."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x20000):
        c = chr(i)
        if c.isspace():
            table[i] = 32
        elif len(c.lower()) == 1:
            table[i] = ord(c.lower())
    return table


def folded(text: str) -> np.ndarray:
    return _folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def edit_budget(length: int, rate: float = ERROR_RATE) -> int:
    """Edits allowed in an item, as many as leave the lemma a bound of at least one q-gram."""
    return max(0, min(int(rate * length), (length - Q) // Q))


def gram_codes(codes: np.ndarray) -> np.ndarray:
    """Hash of the Q characters from each place."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * _MULT
    for i, odd in enumerate((0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)):
        h = h[:-(1 << i)] * np.uint64(odd) + h[1 << i:]
    h ^= h >> np.uint64(29)
    return h * _MULT


class Items:
    """Index of the q-grams of a block of items; items shorter than Q are looked up as they are."""

    def __init__(self, rows: list[tuple[int, str]], rate: float = ERROR_RATE):
        kept = [(i, folded(t)) for i, t in rows if t]
        self.tiny = [(i, c) for i, c in kept if len(c) < Q]
        self.items = [(i, c) for i, c in kept if len(c) >= Q]
        self.budget = np.array([edit_budget(len(c), rate) for _, c in self.items], np.int64)
        lengths = np.array([len(c) for _, c in self.items], np.int64)
        self.bound = lengths - Q + 1 - self.budget * Q
        grams = [gram_codes(c) for _, c in self.items]
        code = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.item, self.place = item[order], place[order]
        self.codes, self.first = np.unique(code[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(code)))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.codes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def shared(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shared q-grams of a text: place in the text, item, place in the item."""
        none = np.zeros(0, np.int64)
        if len(text) < Q or not len(self.codes):
            return none, none, none
        h = gram_codes(text)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.codes, h[at]), len(self.codes) - 1)
        real = self.codes[slot] == h[at]
        at, slot = at[real], slot[real]
        n = self.count[slot]
        ends = np.cumsum(n)
        pick = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(self.first[slot], n)
        return np.repeat(at, n), self.item[pick], self.place[pick]


def retained(items: Items, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bands that reach the bound: rows of (text index, item, lowest diagonal).

    ``text`` is a buffer of texts that end at ``ends``; each is followed by a code no item has.
    """
    at, item, place = items.shared(text)
    of = np.searchsorted(ends, at, side="right")
    n = len(items.items)
    # a band cannot reach what the whole document does not
    _, pair, total = np.unique(of * n + item, return_inverse=True, return_counts=True)
    enough = total[pair] >= items.bound[item]
    at, item, place, of = at[enough], item[enough], place[enough], of[enough]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    step = items.budget[item] + 1
    diagonal = at - place
    found = []
    for half in (0, 1):  # bands of two steps, one step apart: any k + 1 diagonals lie in one of them
        band = (diagonal + half * step) // (2 * step)
        order = np.lexsort((place, band, item, of))
        each = np.stack((of, item, band, place), 1)[order]
        each = each[np.concatenate(([True], (each[1:] != each[:-1]).any(1)))]  # a q-gram of the item counts once
        head = np.flatnonzero(np.concatenate(([True], (each[1:, :3] != each[:-1, :3]).any(1))))
        count = np.diff(np.append(head, len(each)))
        rows = each[head, :3]
        rows = rows[count >= items.bound[rows[:, 1]]]
        width = items.budget[rows[:, 1]] + 1
        rows[:, 2] = rows[:, 2] * 2 * width - half * width
        found.append(rows)
    return np.unique(np.concatenate(found), axis=0)


def align(item: np.ndarray, text: np.ndarray, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """Fewest edits of ``item`` in ``text`` on diagonals low .. low + width - 1: (edits, start, end), or None beyond the budget.

    The leftmost end wins a tie, then the rightmost start.
    """
    m, n = len(item), len(text)
    far = m + 1
    whole = text[max(low, 0):max(low, 0) + width + m].tobytes()
    at = whole.find(item.tobytes())
    while at >= 0 and at % 4:
        at = whole.find(item.tobytes(), at + 1)
    if at >= 0:  # no edits, so nothing to align
        at = max(low, 0) + at // 4
        return 0, at, at + m
    diagonals = np.arange(low, low + width)
    cost = np.where((diagonals >= 0) & (diagonals <= n), 0, far).astype(np.int64)
    start = diagonals.copy()
    steps = np.arange(width)
    for i in range(1, m + 1):
        at = diagonals + i  # text characters used
        ok = (at >= 1) & (at <= n)
        letters = text[np.clip(at - 1, 0, max(n - 1, 0))] if n else np.zeros(width, np.uint32)
        swap = np.where(ok, cost + (letters != item[i - 1]), far)
        drop = np.append(cost[1:], far) + 1  # item character left out
        new = np.minimum(swap, drop)
        came = np.where((swap < drop) | ((swap == drop) & (start >= np.append(start[1:], -1))), start, np.append(start[1:], -1))
        # text characters put in: the least of new[j] + (d - j) over the diagonals before
        best = np.minimum.accumulate(new - steps)
        last = np.maximum.accumulate(np.where(new - steps == best, steps, -1))
        new, start = best + steps, came[last]
        new[(at < 0) | (at > n)] = far
        cost = np.minimum(new, far)
    edits = int(cost.min())
    if edits > budget:
        return None
    d = int(np.argmin(cost))
    return edits, int(start[d]), int(diagonals[d] + m)


def apart(regions: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Regions (edits, start, end) that overlap no better one: fewer edits, then further left."""
    kept: list[tuple[int, int, int]] = []
    starts: list[int] = []
    for edits, a, b in sorted(set(regions)):
        at = bisect.bisect_left(starts, a)
        # kept regions do not overlap, so only the neighbours can meet this one
        if (at == 0 or kept[at - 1][2] <= a) and (at == len(kept) or kept[at][1] >= b):
            starts.insert(at, a)
            kept.insert(at, (edits, a, b))
    return kept


def _places(code: np.ndarray, text: np.ndarray) -> Iterator[int]:
    """Where a short item occurs, from left to right without overlaps."""
    whole, part = text.tobytes(), code.tobytes()
    at = whole.find(part)
    while at >= 0:
        if at % 4 == 0:
            yield at // 4
        at = whole.find(part, at + (len(part) if at % 4 == 0 else 1))


def search(items: Items, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text index, item id, edits, start, end) of the verified regions of every item in every text.

    Of regions of an item that overlap the best one counts.
    """
    codes = [folded(t) for t in texts]
    stop = np.array([0x110000 + 5], np.uint32)
    text = np.concatenate([x for c in codes for x in (c, stop)]) if codes else np.zeros(0, np.uint32)
    ends = np.cumsum([len(c) + 1 for c in codes])
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for of, item, low in retained(items, text, ends).tolist():
        base = int(ends[of]) - len(codes[of]) - 1
        k = int(items.budget[item])
        got = align(items.items[item][1], codes[of], low - base, 2 * (k + 1), k)
        if got:
            found.setdefault((of, item), []).append(got)
    for (of, item), regions in found.items():
        for region in apart(regions):
            yield (of, items.items[item][0], *region)
    for i, c in items.tiny:
        for of, doc in enumerate(codes):
            for at in _places(c, doc):
                yield of, i, 0, at, at + len(c)


def search_all(items: Items, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """``search`` over some texts at a time."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= TEXT_CHARS):
            size += len(texts[hi])
            hi += 1
        for of, *rest in search(items, texts[lo:hi]):
            yield (lo + of, *rest)
        lo = hi


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, id_col: str = "item_id",
                text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_chars`` characters, read one block at a time; null and empty items go."""
    items = benchmark.select(benchmark[id_col].cast("long").alias("i"), benchmark[text_col].alias("t")).filter(
        "t is not null and t <> ''")
    # dealt by a number of their own, so that equal items spread over the blocks
    items = keep(items.withColumn("n", F.monotonically_increasing_id()), "items")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // block_chars)
    for b in range(n):
        yield [(r.i, r.t) for r in items.filter(F.pmod(F.xxhash64("n"), F.lit(n)) == b).collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id",
                  text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for every region of a document that holds an item: _row, id, item_id, edits, start, end (code points, exclusive).

    Regions of an item in a document do not overlap. Null and empty texts and items match nothing; equal rows give equal rows; an item shorter than
    Q characters must occur exactly; an item id may be null; either table may be empty.
    """
    rows = keyed(docs, id_col, text_col)
    spark = docs.sparkSession
    kind = dict(rows.dtypes)["_id"]
    schema = f"_row long, _id {kind}, item_id long, edits long, start long, end long"
    out = None
    for block in item_blocks(benchmark, block_chars):
        sent = spark.sparkContext.broadcast(pickle.dumps(Items(block, rate)))

        def fold(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = pickle.loads(sent.value)
            for batch in sliced(batches):
                found = list(search_all(items, [t or "" for t in batch["_text"].to_pylist()]))
                at = pa.array([f[0] for f in found], pa.int64())
                values = [pa.array([f[c] for f in found], pa.int64()) for c in range(1, 5)]
                yield pa.record_batch([batch["_row"].take(at), batch["_id"].take(at), *values],
                                      names=["_row", "_id", "item_id", "edits", "start", "end"])

        part = rows.mapInArrow(fold, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnRenamed("_id", id_col)


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id",
                    text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no benchmark item is found, with all of their columns."""
    at = docs.columns.index(text_col)
    out = docs
    for block in item_blocks(benchmark, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(Items(block, rate)))

        def stays(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = pickle.loads(sent.value)
            for batch in sliced(batches):
                texts = [t or "" for t in batch.column(at).to_pylist()]
                keep = np.ones(len(texts), bool)
                for of, *_ in search_all(items, texts):
                    keep[of] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(stays, docs.schema)
    return out
