import itertools

import brute
import numpy as np
import pytest

from opslake.llm import line_crf


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = labels.filter("doc_id % 3 > 0")
    rows = line_crf.judge(docs, line_crf.train(docs, train)).collect()
    return {r.doc_id: r for r in rows}, {r.doc_id: r.text for r in docs.collect()}, labels.collect()


def test_base_against_brute_force(judged):
    got, texts, _ = judged
    assert set(got) == set(texts)
    for i, r in got.items():
        assert tuple(r)[1:7] == brute.quality(texts[i])


def test_held_out_accuracy(judged):
    got, _, labels = judged
    judgeable = [r for r in labels if r.doc_id % 3 == 0 and not got[r.doc_id].base_failed]
    right = [got[r.doc_id].kept == bool(r.quality) for r in judgeable]
    assert len(right) > 60 and np.mean(right) > 0.97


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(2)
    for n in range(1, 8):
        m = line_crf.Crf(weights=rng.normal(size=line_crf.N_FEATURES), step=rng.normal(size=(2, 2)), start=rng.normal(size=2))
        x = rng.normal(size=(n, line_crf.N_FEATURES))
        e = m.emissions(x)

        def score(y):
            return m.start[y[0]] + sum(e[t] * y[t] for t in range(n)) + sum(m.step[a, b] for a, b in zip(y, y[1:]))

        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert tuple(m.decode(x)) == best


def test_odd_rows(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None, True), (2, "", True), (3, good, True), (3, good, True), (None, "a b " * 60, True), (5, "\n\n", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = line_crf.train(df, labels)
    got = line_crf.judge(df, model).collect()
    assert sorted([(r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in got]) == [
        (0, 120, True, False), (1, 0, True, False), (2, 0, True, False), (3, 80, False, True), (3, 80, False, True),
        (5, 0, True, False)]
    assert [r.doc_id for r in line_crf.keep_good(df, model).collect()] == [3, 3]
    assert line_crf.judge(df.limit(0), model).count() == 0
    assert line_crf.train(df.limit(0), labels.limit(0)).weights[0] == -1
