"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Method. A document is a sparse vector x: its words, hashed and with frequencies of length one, its
structure statistics and its metadata (standardised on the training rows). With a weight w_i and a
vector v_i of ``RANK`` numbers for every feature, its score is the logistic function of

    w_0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

and the sum over pairs is taken in linear time as 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2].

The machine is fitted to a bounded sample of the labelled rows (``TRAIN_DOCS``, those with the
least hash of their id, one text an id) by AdaGrad on the logistic loss; it scores every row. Labels,
languages, sources and ids are no features.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.llm.common import arrow_rows

#: Labelled documents that the machine is fitted to, at most.
TRAIN_DOCS = 6000
WORD_BITS = 16
RANK = 8
EPOCHS = 10
BATCH = 64
RATE = 0.05
L2 = 1e-5
SEED = 5
#: Standardised statistics beyond this are cut.
WIDEST = 4.0
#: Rows whose id has this remainder are never learned from.
FOLDS, HELD_OUT = 3, 1

_SYMBOLS = b"#*$%&|<>{}[]()~^_=+\\/@"
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?"
_ASCII = bytes(range(128))
_WORD_END = re.compile(rb"[^0-9A-Za-z\x80-\xff\x20\t-\r](?=[\x20\t-\r]|\Z)")
N_STATS = 16


def statistics(text: str, n_chars: int | None, words: list[bytes], counts: Counter) -> list[float]:
    """Structure statistics and metadata of a text; ``words`` are in lower case."""
    raw = text.encode("utf-8")
    size, n = max(1, len(raw)), max(1, len(words))
    lines = [s for s in raw.split(b"\n") if s.strip()]
    k = max(1, len(lines))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    return [
        math.log1p(len(words)),
        min(sum(map(len, words)) / n, 40.0),
        share(_SYMBOLS),
        share(_UPPER),
        share(_DIGITS),
        share(_MARKS),
        len(raw.translate(None, _ASCII)) / size,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        len(set(zip(words, words[1:]))) / n,
        1 - len(set(lines)) / k,
        math.log1p(len(words) / k),
        sum(s.rstrip()[-1:] in (b".", b"!", b"?") for s in lines) / k,
        len(_WORD_END.findall(raw)) / n,
        math.log1p(max(0, len(text) if n_chars is None else n_chars)),
        float(n_chars is None),
    ]


def features(text: str | None, n_chars: int | None = None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Hashed words with their frequencies (of length one), and the statistics, of a whole text."""
    text = text or ""
    words = text.encode("utf-8").lower().split()
    counts = Counter(words)
    at = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) & ((1 << WORD_BITS) - 1)
    if len(at):
        at, of = np.unique(at, return_inverse=True)
        value = np.bincount(of, np.fromiter(counts.values(), np.float64, len(counts)))
        value /= math.sqrt(float(value @ value))
    else:
        value = np.zeros(0)
    return at.astype(np.int32), value.astype(np.float32), statistics(text, n_chars, words, counts)


@dataclass
class Machine:
    """Features are the hashed words, then the statistics."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def constant(cls, bias: float = 0.0) -> Machine:
        n = (1 << WORD_BITS) + N_STATS
        return cls(bias, np.zeros(n), np.zeros((n, RANK)), np.zeros(N_STATS), np.ones(N_STATS))

    def rows(self, docs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, value and start of each document, all in one list."""
        stats = np.clip((np.array([d[2] for d in docs]) - self.mean) / self.scale, -WIDEST, WIDEST)
        own = np.arange(N_STATS) + (1 << WORD_BITS)
        at = np.concatenate([x for d in docs for x in (d[0], own)])
        value = np.concatenate([x for d, s in zip(docs, stats) for x in (d[1], s)]).astype(np.float64)
        sizes = np.array([len(d[0]) + N_STATS for d in docs])
        return at, value, np.cumsum(sizes) - sizes

    def raw(self, at: np.ndarray, value: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each document, and its sum of factors."""
        vx = self.factors[at] * value[:, None]
        total = np.add.reduceat(vx, start)
        pairs = 0.5 * (total ** 2 - np.add.reduceat(vx * vx, start)).sum(1)
        return self.bias + np.add.reduceat(self.weights[at] * value, start) + pairs, total

    def scores(self, docs: list[tuple]) -> np.ndarray:
        """Chance of label 1 for each document."""
        return _logistic(self.raw(*self.rows(docs))[0]) if docs else np.zeros(0)

    def to_bytes(self) -> bytes:
        parts = ([self.bias], self.weights, self.factors.ravel(), self.mean, self.scale)
        return np.concatenate(parts).astype(np.float64).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Machine:
        v, n = np.frombuffer(data), (1 << WORD_BITS) + N_STATS
        cut = np.split(v, np.cumsum([1, n, n * RANK, N_STATS]))
        return cls(float(cut[0][0]), cut[1], cut[2].reshape(n, RANK), cut[3], cut[4])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gradient(machine: Machine, at, value, start, y) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the mean logistic loss: by the bias, and by the weight and the factors of every entry."""
    odds, total = machine.raw(at, value, start)
    off = (_logistic(odds) - y) / len(y)
    n = np.diff(np.append(start, len(at)))
    each = np.repeat(off, n) * value
    by_factor = each[:, None] * (np.repeat(total, n, 0) - machine.factors[at] * value[:, None])
    return float(off.sum()), each, by_factor


def fit(docs: list[tuple], labels: list[int]) -> Machine:
    """Train on features and labels; with labels of one kind the score is their smoothed share."""
    y = np.array(labels, np.float64)
    odds = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    machine = Machine.constant(odds)
    if len(set(labels)) < 2:
        return machine
    stats = np.array([d[2] for d in docs])
    machine.mean, machine.scale = stats.mean(0), stats.std(0)
    machine.scale[machine.scale < 1e-9] = 1.0
    rng = np.random.default_rng(SEED)
    machine.factors = rng.normal(0, 0.02, machine.factors.shape)
    seen_w, seen_v, seen_b = np.full(len(machine.weights), 1e-8), np.full(machine.factors.shape, 1e-8), 1e-8
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), BATCH):
            part = order[lo:lo + BATCH]
            at, value, start = machine.rows([docs[i] for i in part])
            by_bias, by_weight, by_factor = gradient(machine, at, value, start, y[part])
            touched, of = np.unique(at, return_inverse=True)
            gw = np.bincount(of, by_weight) + L2 * machine.weights[touched]
            gv = np.stack([np.bincount(of, f) for f in by_factor.T], 1) + L2 * machine.factors[touched]
            seen_b += by_bias ** 2
            seen_w[touched] += gw ** 2
            seen_v[touched] += gv ** 2
            machine.bias -= RATE * by_bias / math.sqrt(seen_b)
            machine.weights[touched] -= RATE * gw / np.sqrt(seen_w[touched])
            machine.factors[touched] -= RATE * gv / np.sqrt(seen_v[touched])
    return machine


def held_out(ids: Column) -> Column:
    """Whether a row is never learned from; a null id counts as the empty text."""
    name = F.coalesce(ids.cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % FOLDS == HELD_OUT


def _narrow(docs: DataFrame, id_col: str, text_col: str, chars_col: str) -> DataFrame:
    chars = docs[chars_col].cast("long") if chars_col in docs.columns else F.lit(None).cast("long")
    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"), chars.alias("_chars"))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", chars_col: str = "n_chars") -> Machine:
    """The machine fitted to at most ``limit`` labelled ids that are not held out (labels 1 and 0; others are none).

    Of several labels of an id the least counts, of several texts the least.
    """
    known = labels.select(labels[id_col].alias("_id"), labels[label_col].alias("_good"))
    chosen = (
        known.filter(F.col("_id").isNotNull() & F.col("_good").isin(0, 1) & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.min("_good").alias("_good")).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    )
    of_ids = _narrow(docs, id_col, text_col, chars_col).join(F.broadcast(chosen), "_id").groupBy("_id", "_good").agg(  # at most ``limit`` rows
        F.min(F.struct(F.coalesce("_text", F.lit("")).alias("_text"), "_chars")).alias("d")).select("_good", "d._text", "d._chars")

    def vectors(good, texts, chars):
        rows = [features(t, c) for t, c in zip(texts.to_pylist(), chars.to_pylist())]
        return pa.table({"good": good.cast(pa.int32()), "at": pa.array([a.tobytes() for a, _, _ in rows], pa.binary()),
                         "value": pa.array([v.tobytes() for _, v, _ in rows], pa.binary()),
                         "stats": pa.array([s for _, _, s in rows], pa.list_(pa.float64()))})

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("good", "at", "value", "stats")
        rows = sorted(r for batch in batches for r in zip(*(batch[c].to_pylist() for c in names)))
        vecs = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32), s) for _, a, v, s in rows]
        yield pa.record_batch({"model": pa.array([fit(vecs, [r[0] for r in rows]).to_bytes()], pa.binary())})

    rows = of_ids.mapInArrow(arrow_rows(vectors, ["_good", "_text", "_chars"]), "good int, at binary, value binary, stats array<double>")
    row = rows.repartition(1).mapInArrow(fitted, "model binary").first()  # the bounded sample
    return Machine.from_bytes(row.model) if row else Machine.constant()


def judge(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """One row per document: id, held_out, score (chance of label 1), predicted.

    A null text is empty and has a score like any other; a null (or absent) ``chars_col`` is
    counted from the text. Equal rows give equal rows; an empty table gives none. Without labels
    all scores are 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine.to_bytes())  # one size for all inputs

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine.from_bytes(shared.value)

        def scored(ids, out, texts, chars):
            found = own.scores([features(t, c) for t, c in zip(texts.to_pylist(), chars.to_pylist())])
            return pa.table({"_id": ids, "held_out": out, "score": pa.array(found, pa.float64()),
                             "predicted": pa.array((found >= 0.5).astype(np.int32))})
        yield from arrow_rows(scored, ["_id", "held_out", "_text", "_chars"])(batches)

    rows = _narrow(docs, id_col, text_col, chars_col).withColumn("held_out", held_out(F.col("_id")))
    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(fold, f"_id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("_id", id_col)
