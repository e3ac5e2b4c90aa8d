import collections
import itertools
import math
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash

from opslake.llm import hmm_lm as lm


def _sequences(rng, classes, n=6):
    return [rng.integers(0, classes, rng.integers(1, 5)) for _ in range(n)]


def _paths(m, seq):
    for path in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, x in zip(path, path[1:], seq[1:]):
            p *= m.step[a, b] * m.emit[x, b]
        yield path, p


def test_forward_and_counts_against_all_paths():
    rng = np.random.default_rng(3)
    m = lm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    seqs = _sequences(rng, 5)
    data = lm.Ragged.of_sequences(seqs)
    logs, _, _ = lm.forward(m, data)
    start, step, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s, got in zip(seqs, logs):
        total = sum(p for _, p in _paths(m, s))
        assert math.isclose(got, math.log(total), rel_tol=1e-9)
        for path, p in _paths(m, s):
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                step[a, b] += p / total
            for x, a in zip(s, path):
                emit[x, a] += p / total
    for want, got in zip((start, step, emit), lm.expected_counts(m, data)):
        assert np.allclose(want, got)


def _base(rows):
    words = {i: [*(t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split(), None] for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    counts = collections.Counter(w for i, ws in words.items() if not out[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (out[i], len(ws), sum(counts[w] > 0 for w in ws), n,
                sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in words.items()}


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    return docs.collect(), lm.scores(docs).collect()


def test_base_against_brute_force(scored):
    docs, got = scored
    want = _base([(r.doc_id, r.text) for r in docs])
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        *exact, base = want[r.doc_id]
        assert [r.held_out, r.n_tokens, r.n_known, r.train_tokens] == exact
        assert math.isclose(r.base_score, base, rel_tol=1e-9)


def test_held_out_texts_are_likelier_than_by_single_words(scored):
    _, got = scored
    held = [r for r in got if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert len(held) > 50
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.1
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_probabilities_of_a_small_language_add_up():
    m = lm.Hmm.random(classes=4, states=3)
    total = 0.0
    for n in (1, 2, 3):
        seqs = [np.array(s) for s in itertools.product(range(4), repeat=n)]
        logs, _, _ = lm.forward(m, lm.Ragged.of_sequences(seqs))
        assert math.isclose(np.exp(logs).sum(), 1.0)
        total += np.exp(logs).sum()
    assert math.isclose(total, 3.0)


def test_odd_rows(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "A a b"), (3, "A a b"), (None, "c"), (5, "x " * 30000), (6, "é É")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    for tokens in (lm.CHUNK_TOKENS, 2):
        monkeypatch.setattr(lm, "CHUNK_TOKENS", tokens)
        got = lm.scores(df).collect()
        want = _base([(("" if i is None else i, k), t) for k, (i, t) in enumerate(rows)])
        assert len(got) == len(rows)
        assert sorted(r.n_tokens for r in got) == sorted(v[1] for v in want.values())
        assert all(np.isfinite(r.score) for r in got)
        assert {r.held_out for r in got if r.doc_id is None} == {True}
        again = {(r.doc_id, r.n_tokens, round(r.score, 6)) for r in got}
        assert len([a for a in again if a[0] == 3]) == 1
    assert lm.scores(df.limit(0)).count() == 0
    assert all(np.isfinite(r.score) for r in lm.scores(df.filter("doc_id is null")).collect())


def _by_brute_force(rows):
    """Scores of a whole corpus, and its emissions by word and state: tied rounds, then the untied one, all in memory."""
    words = {i: t.split() for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    c = collections.Counter(w for i, ws in words.items() if not out[i] for w in ws)
    top = {w: k for k, (w, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:lm.OWN_CLASS])}

    def cls(w):
        return top[w] if w in top else lm.OWN_CLASS + xxhash.xxh64(w[-3:], seed=42).intdigest() % lm.SHARED_CLASSES

    def own(w):
        return w not in top and c[w] >= lm.MIN_COUNT

    train = [i for i in words if not out[i]]
    data = lm.Ragged.of_sequences([np.array([*map(cls, words[i]), lm.END]) for i in train])
    tokens = sum(c.values()) + len(train)
    model, before = lm.Hmm.random(), -np.inf
    while True:
        now = lm.forward(model, data)[0].sum()
        model = lm.Hmm.from_counts(*lm.expected_counts(model, data)[:3])
        if now - before < lm.TOLERANCE * tokens:
            break
        before = now
    names = sorted(set(w for ws in words.values() for w in ws))
    number = {w: k for k, w in enumerate(names)} | {None: len(names)}
    classes = np.array([*map(cls, names), lm.END])
    by_word = lm.Ragged.of_sequences([np.array([*map(number.get, words[i]), len(names)]) for i in train])
    start, step, n, _ = lm.expected_counts(lm.Hmm(model.start, model.step, model.emit[classes]), by_word)
    total, emit = n.sum(0), np.zeros((len(names) + 1, lm.STATES))
    for k in range(lm.CLASSES):
        at = np.flatnonzero(classes == k)
        held = [j for j in at if j < len(names) and own(names[j])]
        rest = [j for j in at if j not in held]
        count = {j: c[names[j]] if j < len(names) else len(train) for j in at}
        whole, left = sum(count.values()), sum(count[j] for j in rest)
        for j in held:
            emit[j] = n[j] / total + lm.TIED * model.emit[k] * count[j] / (whole + lm.ADD)
        for j in rest:
            share = 1 if k < lm.OWN_CLASS or k == lm.END else (count[j] + lm.ADD) / (left + lm.ADD * (sum(count[x] > 0 for x in rest) + 1))
            emit[j] = share * (n[rest].sum(0) / total + lm.TIED * model.emit[k] * (left + lm.ADD) / (whole + lm.ADD))
    chain = lm.Hmm.from_counts(start, step, emit)
    chain.emit = emit / (1 + lm.TIED)
    ids = list(words)
    logs, _, _ = lm.forward(chain, lm.Ragged.of_sequences([np.array([*map(number.get, words[i]), len(names)]) for i in ids]))
    return dict(zip(ids, logs / np.log(10))), chain.emit, sum(map(own, c))


def _two_topics(n=900):
    rng = np.random.default_rng(9)
    return [(i, " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, rng.integers(3, 30)), 500) + 500 * (i % 2))) for i in range(n)]


@pytest.mark.parametrize("chunk", [lm.CHUNK_TOKENS, 3000])
def test_scores_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(lm, "OWN_CLASS", 6)
    monkeypatch.setattr(lm, "MIN_COUNT", 8)
    monkeypatch.setattr(lm, "HELD_WORDS", 40)
    rows = _two_topics()
    want, _, n_own = _by_brute_force(rows)
    got = {r.doc_id: r.score for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert n_own > 30 and got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-5) for i in want)


def test_emissions_add_up_and_grow_with_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(lm, "OWN_CLASS", 6)
    monkeypatch.setattr(lm, "MIN_COUNT", 8)
    rows = _two_topics()
    _, emit, _ = _by_brute_force(rows)
    assert (emit.sum(0) < 1 + 1e-9).all() and (emit.sum(0) > 0.9).all()  # the rest is for words never seen
    sizes = []
    for part in (rows[:300], rows):
        encoded, totals = lm.encode(lm.chunked(spark.createDataFrame(part, "doc_id long, text string")))
        train = encoded.filter("symbols is not null and not held_out")
        model, by_word = lm.untie(train, lm.fit(train, totals.tokens), totals)
        n = np.array([r[1:] for r in by_word.collect()])
        at = np.array([r[0] for r in by_word.collect()])
        assert np.allclose(model.chain.emit.sum(0) + model.words(at, n).sum(0), 1)
        sizes.append(len(n))
    assert sizes[1] > 1.5 * sizes[0]


def test_packed_symbols_come_back():
    for x in ([], [0], [5, 70000, 3], [1, 1 << 40]):
        packing = lm.Packing()
        assert packing.unpack(packing.pack(np.array(x, np.int64))).tolist() == x


def test_words_are_split_as_bytes_are():
    texts = ["A a  b", None, "", " \t\n\x0b\x0c\r ", " É é\x1cx\x85y z ", "\nX y\x00 w\n", "ab" * 9 + " ab"]
    words, sizes = lm.split_words(lm.pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert sizes.tolist() == [*map(len, want)]
    assert words.to_pylist() == [w.decode() for ws in want for w in ws]


def test_counts_hold_where_transitions_are_rare():
    rng = np.random.default_rng(4)
    step, emit = np.full((3, 3), 1e-12) + np.eye(3), np.full((3, 3), 1e-11) + np.eye(3)
    m = lm.Hmm(np.ones(3) / 3, step / step.sum(1, keepdims=True), emit / emit.sum(0))
    seqs = [rng.integers(0, 3, n) for n in (1, 2, 40, 41, 300, 300)]  # a rare transition or emission at most steps
    a, total = [], 0.0
    for s in seqs:
        p = m.start
        for t, x in enumerate(s):
            p = (p @ m.step if t else p) * m.emit[x]
            total += math.log(p.sum())
            p = p / p.sum()
        a.append(p)
    data = lm.Ragged.of_sequences(seqs)
    start, step, emit, logs = lm.expected_counts(m, data)
    tokens = sum(map(len, seqs))
    assert math.isclose(logs, total, rel_tol=1e-5) and math.isclose(lm.forward(m, data)[0].sum(), total, rel_tol=1e-9)
    assert math.isclose(start.sum(), len(seqs), rel_tol=1e-5) and math.isclose(emit.sum(), tokens, rel_tol=1e-5)
    assert math.isclose(step.sum(), tokens - len(seqs), rel_tol=1e-5)


def test_a_pass_takes_little_memory_beside_its_room():
    rng = np.random.default_rng(6)
    data = lm.Ragged.of_sequences([rng.integers(0, lm.CLASSES, 400) for _ in range(500)])
    room, m = lm.Room(), lm.Hmm.random()
    want = lm.expected_counts(m, data, room=room)
    tracemalloc.start()
    got = lm.expected_counts(m, data, room=room)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * len(data.symbols)  # a copy of the alphas alone has 64 bytes a token in doubles
    assert all(np.array_equal(x, y) for x, y in zip(want, got))
