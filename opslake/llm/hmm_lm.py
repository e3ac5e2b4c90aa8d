"""Hidden Markov language model over words, trained by Baum-Welch on a corpus.

Method. A hidden Markov chain of ``STATES`` states emits the words of a text and an end. Training
goes from tied to untied emissions. First words share classes: each of the ``OWN_CLASS`` most
frequent words is its own, the rest are classed by a hash of their last three letters. Rounds of
Baum-Welch over classes add up expected counts in all partitions over all training documents, from
a seeded start until a round gains less than ``TOLERANCE``. A last round over all training documents
unties the emissions: every word seen ``MIN_COUNT`` times or more gets its own expected counts by
state, interpolated with its share of the class; the rarer words of a class back off to what is
left of it. The scaled forward recursion gives the exact likelihood of a whole text.

Corpus counts. Tasks cut their documents into chunks of bounded size and write each document as
numbers of a vocabulary of its chunk, and the vocabulary with its counts. Counts of a word are
summed over chunks and joined back to the chunks that hold it, and so are its expected counts by
state. What moves is one row per chunk and word; no task or driver holds the vocabulary of the
corpus or its emission table, which both grow with the input.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from opslake.llm.common import keep, sliced

STATES = 8
OWN_CLASS = 2000
SHARED_CLASSES = 1024
CLASSES = OWN_CLASS + SHARED_CLASSES + 1
END = CLASSES - 1
#: Training ends when a round gains less than this log likelihood a token.
TOLERANCE = 0.01
#: Added to every count of a word; and to every expected count of a class.
ADD = 0.1
PRIOR = 0.01
#: Words seen as often in training have emissions of their own.
MIN_COUNT = 50
#: Weight of the tied model beside the expected counts of the last round.
TIED = 0.01
#: Bits of a symbol that hold its class; those above hold the word's rank among its class's own, 0 for rarer words.
CLASS_BITS = 12
CLASS_MASK = (1 << CLASS_BITS) - 1
#: Rows of expected counts by word that a task holds before it hands them on.
HELD_WORDS = 500_000
#: Tokens in a chunk, and in one forward-backward pass.
CHUNK_TOKENS = 4_000_000
PASS_TOKENS = 1_000_000
#: Bytes of different words that a task holds of a chunk before it closes it.
CHUNK_BYTES = 256 << 20
#: Steps between scalings of forward probabilities. As emissions are over their mean, a step takes them down
#: to the least transition at most, some 1e-12, so that three stay in single precision.
SCALE_EVERY = 3
#: Tokens whose emissions are looked up at a time.
BLOCK_TOKENS = 1 << 15
#: Tokens whose expected counts are added up at a time, or as many as there are places.
SUM_TOKENS = 1 << 13


def held_out(doc_id: object) -> bool:
    """Every tenth document by the CRC-32 of its id as text (a null id is the empty text)."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


# ---- the model ----

@dataclass
class Hmm:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # classes x states

    @classmethod
    def random(cls, seed: int = 7, states: int = STATES, classes: int = CLASSES) -> Hmm:
        rng = np.random.default_rng(seed)
        step = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(step, 0.9)
        emit = rng.uniform(0.5, 1.5, (classes, states))
        return cls(np.full(states, 1 / states), step / step.sum(1, keepdims=True), emit / emit.sum(0))

    @classmethod
    def from_counts(cls, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> Hmm:
        start, step, emit = start + PRIOR, step + PRIOR, emit + PRIOR
        return cls(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


@dataclass
class Ragged:
    """Sequences by falling length, laid out step by step: step t holds the first ``live[t]`` of them."""

    symbols: np.ndarray
    of: np.ndarray
    live: np.ndarray
    off: np.ndarray
    order: np.ndarray
    #: Where each sequence ends.
    ends: np.ndarray

    @classmethod
    def of_sequences(cls, sequences: list[np.ndarray]) -> Ragged:
        sizes = np.array([len(s) for s in sequences], np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, sizes[0] + 1), side="left")
        off = np.concatenate(([0], np.cumsum(live)))
        heads = np.repeat(np.cumsum(sizes) - sizes, sizes)
        of = np.repeat(np.arange(len(sizes)), sizes)
        place = off[np.arange(len(of)) - heads] + of
        symbols, owner = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
        symbols[place] = np.concatenate([sequences[i] for i in order])
        owner[place] = of
        return cls(symbols, owner, live, off, order, off[sizes - 1] + np.arange(len(sizes)))


class Room:
    """Arrays in single precision for the passes of a task, used again, as fresh pages are dear."""

    def __init__(self) -> None:
        self._held: dict[str, np.ndarray] = {}

    def rows(self, name: str, n: int, states: int) -> np.ndarray:
        if name not in self._held or len(self._held[name]) < n:
            self._held[name] = np.empty((max(n, PASS_TOKENS), states), np.float32)
        return self._held[name][:n]


def forward(model: Hmm, data: Ragged, room: Room | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Natural log likelihood of each sequence (in the given order), and with ``room`` the scaled alphas
    and emissions over their scales, tokens x states, which stand there till its next use.

    Probabilities are in single precision with ``room``, else in double; they are scaled anew every
    ``SCALE_EVERY`` steps, and where a sequence ends.
    """
    states, size, kind = len(model.start), len(data.symbols), np.float32 if room else np.float64
    mean = model.emit.mean(1)
    emit, scale = (model.emit / mean[:, None]).astype(kind), mean.take(data.symbols)
    alphas, ratios = (room.rows(x, size, states) if room else None for x in ("alphas", "ratios"))
    live, off, step = data.live.tolist(), data.off.tolist(), model.step.astype(kind)
    last, ones, ends, begin = model.start.astype(kind)[None], np.ones(states, kind), np.sort(data.ends), 0
    while begin < len(live):
        stop = max(begin + 1, int(np.searchsorted(data.off, off[begin] + BLOCK_TOKENS, side="right")) - 1)
        base, top = off[begin], off[stop]
        alpha, ratio = (x[base:top] if room else np.empty((top - base, states), kind) for x in (alphas, ratios))
        emit.take(data.symbols[base:top], 0, out=ratio, mode="clip")
        for t in range(begin, stop):
            lo, hi = off[t] - base, off[t + 1] - base
            now = np.multiply(last[:live[t]] @ step if t else last, ratio[lo:hi], out=alpha[lo:hi])
            if t % SCALE_EVERY == 0:
                c = now @ ones
                now /= c[:, None]
                ratio[lo:hi] /= c[:, None]
                scale[base + lo:base + hi] *= c
            last = now
        done = ends[np.searchsorted(ends, base):np.searchsorted(ends, top)]
        c = alpha[done - base] @ ones
        alpha[done - base] /= c[:, None]
        ratio[done - base] /= c[:, None]
        scale[done] *= c
        begin = stop
    logs = np.zeros(len(data.order))
    logs[data.order] = np.bincount(data.of, np.log(scale), len(data.order))
    return logs, alphas, ratios


def expected_counts(model: Hmm, data: Ragged, place: np.ndarray | None = None, places: int = 0,
                    room: Room | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, steps and emissions of the sequences (the E-step of Baum-Welch), and their log likelihood.

    Emissions are added up by ``place`` (one of ``places`` for each symbol) where it is given, else by symbol.
    Probabilities are in single precision, sums over steps in double.
    """
    if place is None:
        place, places = data.symbols, len(model.emit)
    logs, alpha, ratio = forward(model, data, room or Room())
    states = len(model.start)
    live, off = data.live.tolist(), data.off.tolist()
    steps, backward = np.zeros((states, states)), np.ascontiguousarray(model.step.T, np.float32)
    back = np.ones((live[0], states), np.float32)  # nothing follows a sequence's end, and later steps are shorter
    for t in range(len(live) - 2, -1, -1):
        lo, k = off[t], live[t + 1]
        ahead = ratio[off[t + 1]:off[t + 2]]
        ahead *= back[:k]
        now = alpha[lo:lo + k]
        steps += now.T @ ahead
        now *= np.matmul(ahead, backward, out=back[:k])  # the step to t is counted from what stands at t - 1
    starts = alpha[:live[0]].sum(0, dtype=np.float64)
    emits = np.zeros((states, places))
    block = max(SUM_TOKENS, places)
    for lo in range(0, len(place), block):
        for total, x in zip(emits, np.ascontiguousarray(alpha[lo:lo + block].T, np.float64)):
            total += np.bincount(place[lo:lo + block], x, places)
    return starts, steps * model.step, emits.T, float(logs.sum())


class Packing:
    """Whole numbers and counts as compressed bytes; a task makes one, as its codecs are used again."""

    def __init__(self) -> None:
        self._in, self._out = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def pack(self, symbols: np.ndarray) -> bytes:
        """Whole numbers in 4 bytes, or 8 if one needs them, byte plane by byte plane."""
        kind = np.dtype(np.int32 if not len(symbols) or symbols.max() < 1 << 31 else np.int64)
        planes = symbols.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T
        return bytes([kind.itemsize]) + self._in.compress(planes.tobytes())

    def unpack(self, raw: bytes) -> np.ndarray:
        planes = np.frombuffer(self._out.decompress(memoryview(raw)[1:]), np.uint8).reshape(raw[0], -1)
        return np.ascontiguousarray(planes.T).reshape(-1).view(np.int32 if raw[0] == 4 else np.int64)

    def pack_counts(self, n: np.ndarray) -> bytes:
        """Counts by state in single precision."""
        return self._in.compress(n.astype(np.float32).tobytes())

    def unpack_counts(self, raw: bytes, states: int) -> np.ndarray:
        return np.frombuffer(self._out.decompress(raw), np.float32).reshape(-1, states)


def in_passes(sequences: Iterator[tuple[object, np.ndarray]]) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Sequences, each with a mark, alike in length together, in passes of bounded size."""
    held, size = [], 0

    def passes() -> Iterator[list]:
        held.sort(key=lambda h: -len(h[1]))
        out, n = [], 0
        for h in held:
            if n and n + len(h[1]) > PASS_TOKENS:
                yield out
                out, n = [], 0
            out.append(h)
            n += len(h[1])
        if out:
            yield out

    for h in sequences:
        held.append(h)
        size += len(h[1])
        if size >= 2 * CHUNK_TOKENS:
            yield from passes()
            held, size = [], 0
    yield from passes()


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of ``x``, in order of first use, and the place of each of ``x`` among them."""
    coded = pa.array(x).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def merged(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with the same ``at`` added up."""
    at, place = np.unique(at, return_inverse=True)
    return at, np.stack([np.bincount(place, x, len(at)) for x in n.T], 1)


def columns(at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"at": pa.array(at, pa.int64())}
                           | {f"n{s}": pa.array(np.ascontiguousarray(n[:, s])) for s in range(n.shape[1])})


def in_buckets(at: np.ndarray, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Buckets that have rows, and the places of each one's rows."""
    of = at % buckets
    order = np.argsort(of, kind="stable")
    names, lo = np.unique(of[order], return_index=True)
    return names, np.split(order, lo[1:])


def round_counts(encoded: DataFrame, model: Hmm, buckets: int = 0) -> DataFrame:
    """Expected counts of one round over all sequences of ``encoded``: at, and a double n0, n1, … per state.

    Rows at 0 and above are emissions: of classes, or, with ``buckets``, of symbols. Row -1 holds
    starts, -2 the log likelihood before the round (in n0), -3 and below the steps from a state.
    A task adds up what it sees. Counts of classes are then summed as rows; those of symbols
    travel in buckets and are added up as they arrive, so that a task holds its words once.
    """
    states = len(model.start)
    schema = "at long, " + ", ".join(f"n{s} double" for s in range(states))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing, room, small = Packing(), Room(), np.zeros((states + 2, states))
        at, n = np.zeros(0, np.int64), np.zeros((0, states))

        def out() -> pa.RecordBatch:
            if not buckets:
                return columns(at, n)
            names, parts = in_buckets(at, buckets)
            return pa.record_batch({"bucket": pa.array(names, pa.int64()),
                                    "ats": pa.array([packing.pack(at[p]) for p in parts], pa.binary()),
                                    "ns": pa.array([packing.pack_counts(n[p]) for p in parts], pa.binary())})

        for part in in_passes((None, packing.unpack(x.as_py())) for b in batches for x in b["symbols"]):
            data = Ragged.of_sequences([s for _, s in part])
            symbols = data.symbols
            data.symbols = symbols & CLASS_MASK
            if buckets:
                seen, place = distinct(symbols)
            else:
                seen, place = np.arange(CLASSES), data.symbols
            starts, steps, emits, logs = expected_counts(model, data, place, len(seen), room)
            small[0] += starts
            small[1, 0] += logs
            small[2:] += steps
            at, n = merged(np.concatenate((at, seen)), np.concatenate((n, emits)))
            if len(at) > HELD_WORDS:
                yield out()
                at, n = at[:0], n[:0]
        at, n = np.append(at, -1 - np.arange(states + 2)), np.concatenate((n, small))
        yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing = Packing()
        ats, ns, held, last = [np.zeros(0, np.int64)], [np.zeros((0, states))], 0, 0
        for b in batches:
            for x, y in zip(b["ats"], b["ns"]):
                ats.append(packing.unpack(x.as_py()))
                ns.append(packing.unpack_counts(y.as_py(), states))
                held += len(ats[-1])
                if held > last + HELD_WORDS:
                    ats, ns = ([z] for z in merged(np.concatenate(ats), np.concatenate(ns)))
                    held = last = len(ats[0])
        at, n = merged(np.concatenate(ats), np.concatenate(ns))
        for lo in range(0, len(at), HELD_WORDS):
            yield columns(at[lo:lo + HELD_WORDS], n[lo:lo + HELD_WORDS])

    symbols = encoded.select("symbols")
    if buckets:
        moved = symbols.mapInArrow(count, "bucket long, ats binary, ns binary").repartition(buckets, "bucket")
        return moved.select("ats", "ns").mapInArrow(add, schema)
    return symbols.mapInArrow(count, schema).groupBy("at").agg(*[F.sum(f"n{s}").alias(f"n{s}") for s in range(states)])


def collected(counts: DataFrame, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Starts, steps, emissions by class (of words without their own) and log likelihood out of a round's counts."""
    small, emit = np.zeros((states + 2, states)), np.zeros((CLASSES, states))
    for at, *n in counts.filter(F.col("at") < CLASSES).collect():  # at most one row per class and state, and two more
        if at < 0:
            small[-1 - at] = n
        else:
            emit[at] = n
    return small[0], small[2:], emit, float(small[1, 0])


def fit(encoded: DataFrame, tokens: int) -> Hmm:
    """Baum-Welch over all sequences, with tied emissions, until a round gains less than the tolerance."""
    model, before = Hmm.random(), -np.inf
    while True:
        *counts, now = collected(round_counts(encoded, model), len(model.start))
        model = Hmm.from_counts(*counts)
        if now - before < TOLERANCE * tokens:
            return model
        before = now


@dataclass
class Untied:
    """The chain after the last round, with emissions of classes less their own words.

    ``prior`` is the tied emission of a class over one token of it, ``occupied`` the expected tokens of a state.
    """

    chain: Hmm
    prior: np.ndarray
    occupied: np.ndarray

    @classmethod
    def of(cls, tied: Hmm, start: np.ndarray, step: np.ndarray, rest: np.ndarray, occupied: np.ndarray, totals: Totals) -> Untied:
        prior = tied.emit / (totals.class_tokens + ADD)[:, None]
        model = cls(Hmm.from_counts(start, step, tied.emit), prior, occupied)
        model.chain.emit = model.mixed(rest, prior * (totals.rest_tokens + ADD)[:, None])
        return model

    def mixed(self, counts: np.ndarray, tied: np.ndarray) -> np.ndarray:
        seen = self.occupied > 0
        return (counts / np.where(seen, self.occupied, 1) + TIED * tied) / (seen + TIED)

    def words(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Emissions of words of their own: a word's counts by state add up to its count."""
        return self.mixed(counts, self.prior[at & CLASS_MASK] * counts.sum(1)[:, None])


def untie(encoded: DataFrame, tied: Hmm, totals: Totals) -> tuple[Untied, DataFrame]:
    """The last round: the model, and the table of expected counts by word."""
    counts = keep(round_counts(encoded, tied, totals.chunks), "emissions")
    start, step, rest, _ = collected(counts, len(tied.start))
    names = counts.columns[1:]
    occupied = counts.filter("at >= 0").agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in names]).first()
    return Untied.of(tied, start, step, rest, np.array(occupied), totals), counts.filter(F.col("at") > CLASS_MASK)


# ---- counts and encoding ----

def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of lower-cased texts one after the other, and how many each text has; null has none."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    words = pc.ascii_split_whitespace(pc.if_else(pc.equal(bare, ""), pa.scalar(None, bare.type), bare))
    return words.flatten(), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)


_CHUNKED = "chunk long, _id {kind}, held_out boolean, numbers binary, number int, word string, n_train long"


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in numbers of their chunk's vocabulary, and the vocabularies, as rows of one table.

    A chunk is named by the task attempt that writes it, and only committed attempts are read.
    """
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    kind = dict(rows.dtypes)["_id"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing, words, docs_of, size, room = Packing(), [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = int.from_bytes(os.urandom(8), "little", signed=True)
            coded = pa.chunked_array(words).unify_dictionaries()
            numbers, vocabulary = np.concatenate([c.indices.to_numpy() for c in coded.chunks]), coded.chunk(0).dictionary
            train, lo = np.zeros(len(vocabulary), np.int64), 0
            for ids, sizes in docs_of:
                n, out = len(ids), [held_out(d) for d in ids.to_pylist()]
                ends = lo + np.cumsum(sizes)
                train += np.bincount(numbers[lo:ends[-1]][np.repeat(~np.array(out), sizes)], minlength=len(vocabulary))
                yield pa.record_batch({
                    "chunk": pa.array([chunk] * n), "_id": ids, "held_out": pa.array(out, pa.bool_()),
                    "numbers": pa.array([packing.pack(x) for x in np.split(numbers[lo:ends[-1]], ends[:-1] - lo)], pa.binary()),
                    "number": pa.nulls(n, pa.int32()), "word": pa.nulls(n, pa.string()), "n_train": pa.nulls(n, pa.int64())})
                lo = ends[-1]
            n = len(vocabulary)
            if n:
                yield pa.record_batch({
                    "chunk": pa.array([chunk] * n), "_id": pa.nulls(n, docs_of[0][0].type), "held_out": pa.nulls(n, pa.bool_()),
                    "numbers": pa.nulls(n, pa.binary()), "number": pa.array(np.arange(n, dtype=np.int32)),
                    "word": vocabulary, "n_train": pa.array(train)})

        for batch in sliced(batches):
            got, sizes = split_words(batch["_text"])
            ends, lo = np.concatenate(([0], np.cumsum(sizes))), 0
            while lo < len(sizes):  # a document that fills the chunk is its last
                hi = min(int(np.searchsorted(ends[1:], ends[lo] + CHUNK_TOKENS - size)) + 1, len(sizes))
                words.append(got.slice(ends[lo], ends[hi] - ends[lo]).dictionary_encode())
                docs_of.append((batch["_id"].slice(lo, hi - lo), sizes[lo:hi]))
                size += int(ends[hi] - ends[lo])
                room += words[-1].dictionary.nbytes
                if size >= CHUNK_TOKENS or room >= CHUNK_BYTES:
                    yield from flush()
                    words, docs_of, size, room = [], [], 0, 0
                lo = hi
        if docs_of:
            yield from flush()
        del words[:]
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return keep(rows.mapInArrow(fold, _CHUNKED.format(kind=kind)), "chunks")


@dataclass
class Totals:
    tokens: int
    distinct: int
    train_docs: int
    class_tokens: np.ndarray
    #: Tokens and words of a class without its own words.
    rest_tokens: np.ndarray
    rest_words: np.ndarray
    chunks: int


def encode(chunks: DataFrame) -> tuple[DataFrame, Totals]:
    """Documents as symbols with their base score, and the totals of the corpus.

    chunk, _id, held_out, n_tokens, n_known, base_score, inside (log10 of the rarer words' shares of
    their classes), symbols (packed, the end included), bucket, own; and a row with nulls for each
    chunk and bucket that holds in ``own`` (packed) the chunk's symbols of words of their own.
    """
    vocabulary = chunks.filter("word is not null")
    counts = vocabulary.groupBy("word").agg(F.sum("n_train").alias("c"))
    counts = keep(counts, "word-counts")
    top = keep(counts.filter("c > 0").orderBy(F.desc("c"), "word").limit(OWN_CLASS).select(
        "word", (F.row_number().over(Window.orderBy(F.desc("c"), "word")) - 1).alias("own")), "own-classes")
    shared = F.lit(OWN_CLASS) + F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(SHARED_CLASSES))
    in_class = counts.join(F.broadcast(top), "word", "left").select(  # at most OWN_CLASS rows
        "word", "c", F.coalesce("own", shared).cast("long").alias("cls"))
    frequent = (F.col("cls") >= OWN_CLASS) & (F.col("c") >= MIN_COUNT)
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("c"), "word")).cast("long")
    classed = (in_class.filter(frequent).withColumn("rank", rank)
               .unionByName(in_class.filter(~frequent).withColumn("rank", F.lit(0).cast("long"))))
    rare = F.col("rank") == 0
    per_class = classed.groupBy("cls").agg(
        F.sum("c").alias("tokens"), F.count_if(F.col("c") > 0).alias("words"),
        F.sum(F.when(rare, F.col("c")).otherwise(0)).alias("rest_tokens"), F.count_if(rare & (F.col("c") > 0)).alias("rest_words"))
    sums = np.zeros((4, CLASSES), np.int64)
    for r in per_class.collect():  # at most CLASSES rows
        sums[:, r.cls] = r.tokens, r.words, r.rest_tokens, r.rest_words
    n_chunks, train_docs = chunks.agg(
        F.count_if(F.col("number") == 0), F.count_if(F.col("numbers").isNotNull() & ~F.col("held_out"))).first()
    sums[0, END] = sums[2, END] = train_docs
    totals = Totals(int(sums[0].sum()), int(sums[1].sum()) + (train_docs > 0), train_docs, sums[0], sums[2], sums[3], max(1, n_chunks))
    of_chunks = vocabulary.select("chunk", "number", "word").join(classed, "word").select(
        F.col("chunk").alias("of_chunk"), "number", "c", F.shiftleft("rank", CLASS_BITS).bitwiseOR(F.col("cls")).alias("symbol"))
    kind = dict(chunks.dtypes)["_id"]

    def fold(docs: pa.Table, lookup: pa.Table) -> pa.Table:
        packing, n_words = Packing(), len(lookup)
        c, symbol = np.zeros(n_words + 1, np.int64), np.zeros(n_words + 1, np.int64)
        at = lookup["number"].to_numpy()
        c[at], symbol[at] = lookup["c"].to_numpy(), lookup["symbol"].to_numpy()
        c[-1], symbol[-1] = totals.train_docs, END  # the end follows the last word
        cls = symbol & CLASS_MASK
        base = np.log10((c + ADD) / (totals.tokens + ADD * (totals.distinct + 1)))
        inside = np.log10((c + ADD) / (totals.rest_tokens[cls] + ADD * (totals.rest_words[cls] + 1)))
        inside[(cls < OWN_CLASS) | (cls == END) | (symbol > CLASS_MASK)] = 0.0
        known = c > 0
        cols: dict[str, list] = {x: [] for x in ("n_tokens", "n_known", "base_score", "inside", "symbols")}
        for raw in docs["numbers"]:
            seq = np.append(packing.unpack(raw.as_py()), n_words)
            for x, v in zip(cols, (len(seq), int(known[seq].sum()), float(base[seq].sum()), float(inside[seq].sum()),
                                   packing.pack(symbol[seq]))):
                cols[x].append(v)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        rows = pa.table({"chunk": docs["chunk"], "_id": docs["_id"], "held_out": docs["held_out"]}
                        | {x: pa.array(v, k) for (x, v), k in zip(cols.items(), kinds)})
        own = symbol[symbol > CLASS_MASK]
        names, parts = in_buckets(own, totals.chunks)
        words = pa.table({"chunk": pa.array([docs["chunk"][0].as_py()] * len(names), pa.int64()), "bucket": pa.array(names, pa.int64()),
                          "own": pa.array([packing.pack(own[p]) for p in parts if len(p)], pa.binary())})
        return pa.concat_tables([rows, words], promote_options="default")

    docs = chunks.filter("numbers is not null").select("chunk", "_id", "held_out", "numbers")
    encoded = by_key(docs, "chunk", totals).cogroup(by_key(of_chunks, "of_chunk", totals)).applyInArrow(
        fold, f"chunk long, _id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, inside double, "
              "symbols binary, bucket long, own binary")
    return keep(encoded, "symbols"), totals


def by_key(rows: DataFrame, key: str, totals: Totals) -> GroupedData:
    """Rows grouped by chunk or bucket, in as many partitions as there are chunks, so that a task's share does not grow."""
    return rows.repartition(totals.chunks, key).groupBy(key)


def counts_by_state(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in order and their counts by state out of rows of expected counts."""
    rows = rows.sort_by("at")
    return rows["at"].to_numpy(), np.stack([rows[f"n{s}"].to_numpy() for s in range(STATES)], 1)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of whole texts. A null text is empty: its end is its only
    token. Equal rows give equal rows and count as often as they occur. Without training
    documents all counts are zero and the model is uniform over classes; an empty table gives no rows.
    """
    encoded, totals = encode(chunked(docs, id_col, text_col))
    texts = encoded.filter("symbols is not null")
    train = texts.filter("not held_out")
    if totals.train_docs:
        tied = fit(train, totals.tokens)
    else:
        tied = Hmm.from_counts(np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES)))
    model, by_word = untie(train, tied, totals)
    kind = dict(encoded.dtypes)["_id"]
    asked = encoded.filter("own is not null").select("chunk", "bucket", "own")
    given = by_word.withColumn("of_bucket", F.pmod("at", F.lit(totals.chunks)))

    def look_up(asked: pa.Table, given: pa.Table) -> pa.Table:
        packing = Packing()
        at, n = counts_by_state(given)
        own = asked["own"].to_pylist()
        return pa.table({"of_chunk": asked["chunk"], "ats": pa.array(own, pa.binary()), "ns": pa.array(
            [packing.pack_counts(n[np.searchsorted(at, packing.unpack(x))]) for x in own], pa.binary())})

    of_chunks = by_key(asked, "bucket", totals).cogroup(by_key(given, "of_bucket", totals)).applyInArrow(
        look_up, "of_chunk long, ats binary, ns binary")
    carried = ["_id", "held_out", "n_tokens", "n_known", "base_score"]

    def score(docs: pa.Table, lookup: pa.Table) -> pa.Table:
        packing = Packing()
        at = np.concatenate([np.zeros(0, np.int64), *map(packing.unpack, lookup["ats"].to_pylist())])
        n = np.concatenate([np.zeros((0, STATES)), *(packing.unpack_counts(x, STATES) for x in lookup["ns"].to_pylist())])
        order = np.argsort(at)
        at = at[order]
        chain = Hmm(model.chain.start, model.chain.step, np.concatenate((model.chain.emit, model.words(at, n[order]))))
        found = np.zeros(len(docs))

        def local(raw: bytes) -> np.ndarray:
            symbols = packing.unpack(raw).astype(np.int64)
            own = np.flatnonzero(symbols > CLASS_MASK)
            symbols[own] = CLASSES + np.searchsorted(at, symbols[own])
            return symbols

        for part in in_passes((i, local(x.as_py())) for i, x in enumerate(docs["symbols"])):
            found[[i for i, _ in part]] = forward(chain, Ragged.of_sequences([s for _, s in part]))[0]
        return pa.table({c: docs[c] for c in carried} | {"score": pa.array(found / np.log(10) + docs["inside"].to_numpy())})

    found = by_key(texts.select("chunk", *carried, "inside", "symbols"), "chunk", totals).cogroup(
        by_key(of_chunks, "of_chunk", totals)).applyInArrow(
        score, f"_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known",
                        F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")
