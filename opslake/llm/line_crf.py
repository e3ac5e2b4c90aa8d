"""Quality rules: lines labelled content or boilerplate by a linear-chain CRF.

Method. Every line with a word gets a feature vector; weights, transitions and start scores are
trained by gradient ascent on the conditional likelihood (forward-backward); Viterbi decoding
finds the best label sequence of a document. The share of word characters in content lines
decides whether the document stays.

Training uses a bounded sample of labelled documents (``TRAIN_DOCS``, those with the least hash
of their id): the lines of good documents count as content, those of bad ones as boilerplate.
All else covers every row. Without labelled documents of both kinds all lines are content.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.llm.common import arrow_rows, sliced

#: Labelled documents that the model is fitted to, at most.
TRAIN_DOCS = 2000
#: Training chains are cut after so many lines; decoding takes whole documents.
CHAIN = 64
#: Least share of content for a document to stay.
CONTENT_SHARE = 0.5
MIN_WORDS = 50

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
_SYMBOL_BYTES = SYMBOLS.encode()
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
N_FEATURES = 11


def line_features(raw: bytes, seen_before: bool) -> list[float]:
    """Features of a line with a word."""
    n = len(raw)
    words = raw.split()
    k = len(words)
    return [
        1.0,
        (n - len(raw.translate(None, _SYMBOL_BYTES))) / n,
        (n - len(raw.translate(None, _UPPER))) / n,
        (n - len(raw.translate(None, _DIGITS))) / n,
        raw.count(b"!") / k,
        raw.count(b"|") / k,
        math.log1p(k),
        min(n / k, 40.0),
        len(set(words)) / k,
        float(words[-1][-1:] in (b".", b"?", b"!")),
        float(seen_before),
    ]


def document_lines(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Features and sizes in word bytes of the lines with a word; how many repeat an earlier line."""
    seen: set[bytes] = set()
    rows, sizes, repeats = [], [], 0
    for raw in text.encode("utf-8").split(b"\n"):
        if not raw.strip():
            continue
        again = raw in seen
        repeats += again
        seen.add(raw)
        rows.append(line_features(raw, again))
        sizes.append(len(raw))
    return np.array(rows, np.float64).reshape(-1, N_FEATURES), np.array(sizes, np.float64), repeats


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    first = ids[:-2] * len(index) + ids[1:-1]
    if len(index) > 1 << 20:
        first = np.unique(first, return_inverse=True)[1].astype(np.int64)
    key = first * len(index) + ids[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    covered = np.zeros(n, bool)
    for d in range(3):
        covered[twice + d] = True
    return int(covered.sum())


@dataclass
class Crf:
    """Two states, 0 content and 1 boilerplate; emissions score state 1 against state 0."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))
    weights: np.ndarray = field(default_factory=lambda: -np.eye(N_FEATURES)[0])
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best labels of the lines of a document (Viterbi); content wins ties."""
        if not len(x):
            return np.zeros(0, np.int8)
        score = self.emissions(x).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = float(self.start[0]), float(self.start[1]) + score[0]
        back = []
        for e in score[1:]:
            to0, to1 = a + s00 < b + s10, a + s01 < b + s11
            back.append((to0, to1))
            a, b = (b + s10 if to0 else a + s00), (b + s11 if to1 else a + s01) + e
        labels = [int(b > a)]
        for pair in reversed(back):
            labels.append(int(pair[labels[-1]]))
        return np.array(labels[::-1], np.int8)

    def flat(self) -> list[float]:
        return np.concatenate((self.mean, self.scale, self.weights, self.step.ravel(), self.start)).tolist()

    @classmethod
    def from_flat(cls, values: list[float]) -> Crf:
        v, n = np.array(values), N_FEATURES
        return cls(v[:n], v[n:2 * n], v[2 * n:3 * n], v[3 * n:3 * n + 4].reshape(2, 2), v[3 * n + 4:])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(chains: list[np.ndarray], labels: list[int], rounds: int = 150, l2: float = 1e-3) -> Crf:
    """Train on chains of line features, each with one label for all of its lines."""
    if len(set(labels)) < 2:
        return Crf()
    order = np.argsort([-len(c) for c in chains], kind="stable")
    chains, y = [chains[i] for i in order], np.array([labels[i] for i in order])
    sizes = np.array([len(c) for c in chains])
    flat = np.concatenate(chains)
    mean, scale = flat.mean(0), flat.std(0)
    mean[0], scale[scale < 1e-9] = 0.0, 1.0
    longest = int(sizes[0])
    x = np.zeros((longest, len(chains), N_FEATURES))
    for i, c in enumerate(chains):
        x[:len(c), i] = (c - mean) / scale
    live = [int((sizes > t).sum()) for t in range(longest)]
    params = np.zeros(N_FEATURES + 6)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for r in range(1, rounds + 1):
        w, step, start = params[:N_FEATURES], params[N_FEATURES:-2].reshape(2, 2), params[-2:]
        e = x @ w
        fwd, bwd = np.zeros((longest, len(chains), 2)), np.zeros((longest, len(chains), 2))
        both = np.stack((np.zeros_like(e), e), -1)
        fwd[0] = start + both[0]
        for t in range(1, longest):
            k = live[t]
            fwd[t, :k] = _lse(fwd[t - 1, :k, :, None] + step, 1) + both[t, :k]
        for t in range(longest - 2, -1, -1):
            k = live[t + 1]
            bwd[t, :k] = _lse(step + (both[t + 1, :k] + bwd[t + 1, :k])[:, None, :], 2)
        total = _lse(fwd[0] + bwd[0], 1)
        grad = np.zeros_like(params)
        for t in range(longest):
            k = live[t]
            p = np.exp(fwd[t, :k] + bwd[t, :k] - total[:k, None])
            grad[:N_FEATURES] += (y[:k] - p[:, 1]) @ x[t, :k]
            if t == 0:
                grad[-2:] += np.bincount(y, minlength=2) - p.sum(0)
            else:
                pair = np.exp(fwd[t - 1, :k, :, None] + step + (both[t, :k] + bwd[t, :k])[:, None, :]
                              - total[:k, None, None]).sum(0)
                seen = np.diag(np.bincount(y[:k], minlength=2).astype(float))
                grad[N_FEATURES:-2] += (seen - pair).ravel()
        grad = grad / sizes.sum() - l2 * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        params = params + 0.1 * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.999 ** r)) + 1e-8)
    return Crf(mean, scale, params[:N_FEATURES], params[N_FEATURES:-2].reshape(2, 2), params[-2:])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> Crf:
    """The CRF fitted to at most ``limit`` labelled documents (label 1 good, 0 bad; null is none)."""
    chosen = (
        labels.select(labels[id_col].alias("_id"), labels[label_col].alias("_good"))
        .filter(F.col("_id").isNotNull() & F.col("_good").isin(0, 1))
        .groupBy("_id").agg(F.min("_good").alias("_good"))
        .orderBy(F.xxhash64("_id"), "_id").limit(limit)
    )
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))

    def features(ids, good, texts):
        xs, ys = [], []
        for text, g in zip(texts.to_pylist(), good.to_pylist()):
            x = document_lines(text or "")[0]
            for at in range(0, len(x), CHAIN):
                xs.append(x[at:at + CHAIN].astype(np.float32).tobytes())
                ys.append(1 - g)
        return pa.table({"x": pa.array(xs, pa.binary()), "bad": pa.array(ys, pa.int32())})

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((b, x) for batch in batches for x, b in zip(batch["x"].to_pylist(), batch["bad"].to_pylist()))
        chains = [np.frombuffer(x, np.float32).astype(float).reshape(-1, N_FEATURES) for _, x in rows]
        yield pa.record_batch({"model": pa.array([fit(chains, [b for b, _ in rows]).flat()])})

    chains = texts.join(F.broadcast(chosen), "_id").mapInArrow(  # broadcast: at most ``limit`` rows
        arrow_rows(features, ["_id", "_good", "_text"]), "x binary, bad int")
    row = chains.repartition(1).mapInArrow(fitted, "model array<double>").first()
    return Crf.from_flat(row.model) if row else Crf()


def judge(docs: DataFrame, model: Crf, share: float = CONTENT_SHARE, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per document: id, counts, base_failed, kept, content_share.

    A null text has no words and fails; equal rows give equal rows; texts are read whole;
    an empty table gives no rows.
    """
    def fold(ids, texts):
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        cols: dict[str, list] = {c: [] for c in [*names, "base_failed", "kept", "content_share"]}
        for text in texts.to_pylist():
            text = text or ""
            words = text.encode("utf-8").split()
            x, sizes, repeats = document_lines(text)
            again = repeated_words(words)
            content = model.decode(x) == 0
            part = float(sizes[content].sum() / sizes.sum()) if len(sizes) else 0.0
            failed = len(words) < MIN_WORDS or 100 * again > 50 * len(words)
            values = [len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeats,
                      again, failed, not failed and part >= share, part]
            for c, v in zip(cols, values):
                cols[c].append(v)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        return pa.table({"_id": ids} | {c: pa.array(v, k) for (c, v), k in zip(cols.items(), kinds)})

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(
        arrow_rows(fold, ["_id", "_text"]),
        f"_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, content_share double").withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, model: Crf, share: float = CONTENT_SHARE, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all of their columns."""
    at = docs.columns.index(text_col)

    def stays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            mask = []
            for text in batch.column(at).to_pylist():
                words = (text or "").encode("utf-8").split()
                good = len(words) >= MIN_WORDS and 100 * repeated_words(words) <= 50 * len(words)
                if good:
                    x, sizes, _ = document_lines(text)
                    good = bool(sizes[model.decode(x) == 0].sum() >= share * sizes.sum())
                mask.append(good)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(stays, docs.schema)
