"""Removal of every byte covered by a 200-byte string that also starts elsewhere.

Method. Suffixes are sorted in two stages: those smaller than their successors are sorted
directly, the rest are induced by scans over the buckets of their first byte; common prefixes of
neighbours in that order then tell which strings of 200 bytes occur twice.

A whole corpus is one text only in name, so it is cut first. The least 32-byte hash inside a
string of 200 bytes is its anchor, and consecutive starts with one anchor form a *stretch*. Equal
strings have equal anchors, so a string needs to be compared only with stretches of the same
anchor. Anchors that occur once are out after one count of hashes; of equal stretches one is
sorted, with its number of copies. Suffix arrays are built over blocks of whole anchor groups.
A group too large for a block (one passage in very many different surroundings) is resolved by
128-bit digests of its strings, counted with partial sums, which needs no group in one place.

Texts are staged once in a table bucketed by row key, so that the joins with them move no text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.llm.common import byte_buffers, keep, keyed, sets_of_rows
from opslake.plans.session import scratch_path

WIDTH = 200
GRAM = 32
#: Bytes handled at a time by the anchor pass, and by one suffix array.
TILE_BYTES = 1 << 18
BLOCK_BYTES = 1 << 21
#: An anchor group of more bytes than this is resolved by digests.
GROUP_BYTES = 1 << 22
#: Text bytes in a bucket of the staged table.
BUCKET_BYTES = 48 << 20
STOP = 0xFF  # occurs in no UTF-8 text

_ODD = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes that start at each place."""
    h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D)
    for i, odd in enumerate(_ODD):
        h = h[:-(1 << i)] * np.uint64(odd) + h[1 << i:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of the string at each start, and whether the anchor sits at the start itself."""
    h = gram_hashes(data)
    span = WIDTH - GRAM + 1
    m, have = h, 1
    while have * 2 <= span:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if span > have:
        m = np.minimum(m[:have - span], m[span - have:])
    return m, h[:len(m)] == m


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: key, text index, first start in the buffer, starts, whether it may repeat itself.

    ``data`` is a buffer of whole texts that end at ``ends``. Read tile by tile.
    """
    limit = len(data) - WIDTH + 1
    parts = []
    for lo in range(0, max(limit, 0), TILE_BYTES):
        hi = min(lo + TILE_BYTES, limit)
        m, own = anchors(data[lo:hi + WIDTH - 1])
        at = np.arange(lo, hi)
        of = np.searchsorted(ends, at, side="right")
        inside = at + WIDTH <= ends[of]
        fresh = np.ones(len(m), bool)
        fresh[1:] = (m[1:] != m[:-1]) | (of[1:] != of[:-1])
        # an anchor at a start whose run goes on occurs again further right
        again = np.zeros(len(m), bool)
        again[:-1] = own[:-1] & ~fresh[1:]
        fresh, again = fresh & inside, again & inside
        first = np.flatnonzero(fresh)
        if not len(first):
            continue
        rank = np.cumsum(fresh) - 1
        n = np.bincount(rank[inside], minlength=len(first))
        twice = np.bincount(rank[again], minlength=len(first)) > 0
        parts.append((m[first], of[first], first + lo, n, twice))
    if not parts:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.int64, np.int64, np.int64, bool))
    key, of, start, n, twice = (np.concatenate(c) for c in zip(*parts))
    # a run cut by a tile edge is one stretch; whether its anchor recurs across the edge is left open
    joint = (key[1:] == key[:-1]) & (of[1:] == of[:-1]) & (start[1:] == start[:-1] + n[:-1])
    head = np.flatnonzero(np.concatenate(([True], ~joint)))
    return (key[head], of[head], start[head], np.add.reduceat(n, head),
            np.logical_or.reduceat(twice | np.concatenate(([False], joint)), head))


# ---- suffix arrays ----

def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the one after it; the last one is not."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    known = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(known[::-1])[::-1]] > 0


def _direct(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in order of the first ``depth`` bytes of their suffixes; equal ones stay in any order.

    Sorted by eight bytes at a time; only what is still equal goes on.
    """
    order = np.argsort(words[places], kind="stable")
    places = places[order]
    w = words[places]
    group = np.cumsum(np.concatenate(([False], w[1:] != w[:-1])))
    out = places.copy()
    at = np.arange(len(places))
    for d in range(8, depth, 8):
        size = np.bincount(group)
        tied = size[group] > 1
        at, places, group = at[tied], places[tied], group[tied]
        if not len(at):
            break
        w = words[np.minimum(places + d, len(words) - 1)]
        order = np.lexsort((w, group))
        places, w, group = places[order], w[order], group[order]
        out[at] = places
        group = np.cumsum(np.concatenate(([False], (w[1:] != w[:-1]) | (group[1:] != group[:-1]))))
    return out


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a big-endian number; beyond the end stand STOPs."""
    padded = np.concatenate((text, np.full(8, STOP, np.uint8)))
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i:i + len(text)]
    return out


def sorted_suffixes(text: np.ndarray, wanted: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Wanted places in order of the first ``depth`` bytes of their suffixes, by two-stage sorting.

    ``wanted`` marks places; with each, those up to the next directly sorted one are put in order
    too, because it is induced from them. The last byte of ``text`` is a STOP.
    """
    n = len(text)
    up = smaller_than_next(text)
    up[-1] = True  # nothing to induce it from
    follow = np.where(up, np.arange(n), n)
    follow = np.minimum.accumulate(follow[::-1])[::-1]
    opens = np.zeros(n + 1, np.int64)
    places = np.flatnonzero(wanted)
    np.add.at(opens, places, 1)
    np.add.at(opens, follow[places] + 1, -1)
    used = np.cumsum(opens[:-1]) > 0
    direct = _direct(eight_bytes(text), np.flatnonzero(up & used), depth)
    induced = used & ~up
    rank_of_byte = text[direct]
    buckets = []
    waiting: dict[int, list[np.ndarray]] = {}

    def induce(source: np.ndarray) -> None:
        before = source[source > 0] - 1
        before = before[induced[before]]
        letters = text[before]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        cuts = np.flatnonzero(np.concatenate(([True], letters[1:] != letters[:-1]))) if len(letters) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(letters)]):
            waiting.setdefault(int(letters[lo]), []).append(before[lo:hi])

    for c in range(256):
        # in a bucket the induced suffixes, larger than their successors, come before the direct ones
        while waiting.get(c):
            got = np.concatenate(waiting.pop(c))
            buckets.append(got)
            induce(got)  # those with the same first byte join this bucket as its next wave
        own = direct[np.searchsorted(rank_of_byte, c, "left"):np.searchsorted(rank_of_byte, c, "right")]
        if len(own):
            buckets.append(own)
            induce(own)
    order = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefix_reaches(text: np.ndarray, order: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Whether each place of a suffix order shares its first ``depth`` bytes with the one before."""
    words = eight_bytes(text)
    same = np.ones(len(order), bool)
    same[:1] = False
    live = np.flatnonzero(same)
    for d in [*range(0, depth - 7, 8), depth - 8]:
        a, b = order[live] + d, order[live - 1] + d
        equal = words[np.minimum(a, len(words) - 1)] == words[np.minimum(b, len(words) - 1)]
        same[live[~equal]] = False
        live = live[equal]
    return same


def repeated_starts(pieces: list[bytes], starts: list[int]) -> list[np.ndarray]:
    """For every piece, which of its first ``starts`` strings of WIDTH bytes occur again in any piece."""
    text = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8)
    heads = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
    wanted = np.zeros(len(text), bool)
    for h, n in zip(heads, starts):
        wanted[h:h + n] = True
    order = sorted_suffixes(text, wanted)
    same = common_prefix_reaches(text, order)
    same[:-1] |= same[1:]
    hit = np.zeros(len(text), bool)
    hit[order[same]] = True
    return [hit[h:h + n] for h, n in zip(heads, starts)]


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


# ---- the job ----

def _stage(rows: DataFrame) -> DataFrame:
    """The texts as bytes in a table bucketed by row key, in the shared folder."""
    spark = rows.sparkSession
    total = rows.select(F.sum(F.octet_length("_text"))).first()[0] or 0
    # with fewer buckets than shuffle partitions the joins would deal the texts anew
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES, 1)
    name = f"texts_{uuid.uuid4().hex}"
    (rows.select("_row", "_id", F.coalesce(F.encode("_text", "UTF-8"), F.lit(b"")).alias("data"))
     .repartition(buckets, "_row").write.bucketBy(buckets, "_row").option("compression", "zstd")
     .option("path", scratch_path(spark, "texts")).saveAsTable(name))
    return spark.table(name)


def _anchor_rows(staged: DataFrame) -> DataFrame:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_buffers(batch["data"])
            rows = batch["_row"].to_numpy()
            for lo, hi in sets_of_rows(offsets, 4 * TILE_BYTES):
                part = data[offsets[lo]:offsets[hi]]
                key, of, start, n, twice = stretches(part, offsets[lo + 1:hi + 1] - offsets[lo])
                base = (offsets[lo:hi] - offsets[lo])[of] if len(of) else start
                yield pa.record_batch({
                    "key": pa.array(key.view(np.int64)), "_row": pa.array(rows[lo:hi][of] if len(of) else np.zeros(0, np.int64)),
                    "start": pa.array((start - base).astype(np.int32)), "n": pa.array(n.astype(np.int32)),
                    "twice": pa.array(twice)})

    return staged.select("_row", "data").mapInArrow(fold, "key long, _row long, start int, n int, twice boolean")


def _cut(texts: DataFrame, what: str) -> DataFrame:
    """Stretches of texts joined with their ``wants`` (array of key, start, n): key, _row, start, n, digest, and bytes if asked for."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"key": [], "_row": [], "start": [], "n": [], what: []}
            for row, data, wants in zip(batch["_row"].to_pylist(), batch["data"], batch["wants"].to_pylist()):
                data = data.as_py()
                for w in wants:
                    piece = data[w["start"]:w["start"] + w["n"] + WIDTH - 1]
                    value = piece if what == "piece" else hashlib.blake2b(piece, digest_size=16).digest()
                    for c, v in zip(out, (w["key"], row, w["start"], w["n"], value)):
                        out[c].append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.record_batch({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})

    return texts.mapInArrow(fold, f"key long, _row long, start int, n int, {what} binary")


def _wanted(staged: DataFrame, stretch: DataFrame) -> DataFrame:
    """Texts with the stretches asked of them; a row's list is no longer than its text."""
    wants = stretch.groupBy("_row").agg(F.collect_list(F.struct("key", "start", "n")).alias("wants"))
    return staged.join(wants, "_row").select("_row", "data", "wants")


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs of the distinct stretches of whole anchor groups, block by block."""
    held: list[tuple] = []
    size = 0

    def block(rows: list[tuple]) -> pa.RecordBatch:
        groups: dict[int, int] = {}
        for r in rows:
            groups[r[0]] = groups.get(r[0], 0) + 1
        # a stretch alone in its group and free of its own anchor has only its copies to match
        sort = [r for r in rows if groups[r[0]] > 1 or r[4]]
        found = dict(zip(((r[0], r[1]) for r in sort), repeated_starts([r[2] for r in sort], [r[3] for r in sort]))) if sort else {}
        out: dict[str, list] = {"key": [], "digest": [], "lo": [], "hi": []}
        for key, digest, _, n, _, copies in rows:
            spans = [(0, n)] if copies > 1 else runs(found.get((key, digest), np.zeros(n, bool)))
            for lo, hi in spans:
                for c, v in zip(out, (key, digest, lo, hi)):
                    out[c].append(v)
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32()]
        return pa.record_batch({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})

    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("key", "digest", "piece", "n", "twice", "copies"))):
            if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                yield block(held)
                held, size = [], 0
            held.append(row)
            size += len(row[2])
    if held:
        yield block(held)


def _window_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every string of the stretches of oversize groups."""
    for batch in batches:
        for key, digest, piece, copies in zip(*(batch[c].to_pylist() for c in ("key", "digest", "piece", "copies"))):
            n = len(piece) - WIDTH + 1
            sums = [hashlib.blake2b(piece[i:i + WIDTH], digest_size=16).digest() for i in range(n)]
            yield pa.record_batch({
                "key": pa.array([key] * n, pa.int64()), "digest": pa.array([digest] * n, pa.binary()),
                "at": pa.array(range(n), pa.int32()), "string": pa.array(sums, pa.binary()),
                "copies": pa.array([copies] * n, pa.int64())})


def repeated_runs(staged: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """_row, lo, hi: runs of starts whose strings also start elsewhere."""
    stretch = keep(_anchor_rows(staged), "stretches")
    often = stretch.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("twice").alias("t")).filter("c > 1 or t").select("key")
    some = keep(stretch.join(often, "key"), "repeated")
    # equal stretches are known by their digests; only one of each is cut out as bytes
    prints = keep(_cut(_wanted(staged, some), "digest").join(
        some.select("_row", "start", "key", "twice"), ["_row", "start", "key"]), "prints")
    one = F.min(F.struct("_row", "start"))
    distinct = keep(prints.groupBy("key", "digest").agg(
        F.count(F.lit(1)).alias("copies"), F.max("twice").alias("twice"), F.max("n").alias("n"), one.alias("one")), "distinct")
    # kept, so that joins by key are between plain shuffles, where a hot key can be split
    size = keep(distinct.groupBy("key").agg(
        F.sum(F.col("n") + WIDTH).alias("bytes"), F.count(F.lit(1)).alias("members"), F.max("twice").alias("open")), "sizes")
    # without a second member, and without its own anchor twice, nothing is left to sort
    alone = size.filter("members = 1 and not open").select("key")
    large = size.filter((F.col("bytes") > group_bytes) & (F.col("members") > 1)).select("key")
    copied = distinct.join(alone, "key", "left_semi").filter("copies > 1").select(
        "key", "digest", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    rest = distinct.join(alone, "key", "left_anti").select("key", F.col("one._row").alias("_row"), F.col("one.start").alias("start"), "n")
    pieces = keep(_cut(_wanted(staged, rest), "piece").withColumnRenamed("start", "s").join(
        distinct.select("key", F.col("one._row").alias("_row"), F.col("one.start").alias("s"), "digest", "copies", "twice"),
        ["key", "_row", "s"]).select("key", "digest", "piece", "n", "twice", "copies"), "pieces")
    sorted_runs = (pieces.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key")
                   .mapInArrow(_sort_groups, "key long, digest binary, lo int, hi int"))
    strings = pieces.join(large, "key", "left_semi").mapInArrow(
        _window_digests, "key long, digest binary, at int, string binary, copies long")
    counted = strings.groupBy("key", "string").agg(F.sum("copies").alias("times")).filter("times > 1").select("key", "string")
    by_digest = strings.join(counted, ["key", "string"]).select(
        "key", "digest", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))
    found = keep(sorted_runs.unionByName(by_digest).unionByName(copied), "runs")
    return prints.select("_row", "start", "key", "digest").join(found, ["key", "digest"]).select(
        "_row", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the strings at runs of starts."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        hi += WIDTH - 1
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False,
                   group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes, with ``texts``).

    A null text is empty; equal rows are each other's repeats; texts under 200 bytes lose nothing;
    an empty table gives no rows. Texts are read whole, and strings never cross documents.
    """
    rows = keyed(docs, id_col, text_col)
    kind = dict(rows.dtypes)["_id"]
    staged = _stage(rows)
    covered = repeated_runs(staged, group_bytes).groupBy("_row").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for data, found in zip(batch["data"], batch["runs"].to_pylist()):
                data, at, parts, gone = data.as_py(), 0, [], 0
                spans = merged([(r["lo"], r["hi"]) for r in found or []])
                for lo, hi in spans:
                    parts.append(data[at:lo])
                    gone += hi - lo
                    at = hi
                left = b"".join(parts) + data[at:] if spans else data
                for c, v in zip(out, (len(data), gone, len(spans), hashlib.sha256(left).hexdigest(), left)):
                    out[c].append(v)
            if not texts:
                del out["kept"]
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.record_batch({"_id": batch["_id"]} | {c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})

    schema = f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return staged.join(covered, "_row", "left").select("_id", "data", "runs").mapInArrow(fold, schema).withColumnRenamed("_id", id_col)
