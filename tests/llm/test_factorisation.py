import zlib

import numpy as np
import pytest

from opslake.llm import factorisation as fm

BASE = "/root/testdata"


def _machine(rng):
    m = fm.Machine.constant(0.3)
    m.weights, m.factors = rng.normal(size=m.weights.shape), rng.normal(size=m.factors.shape)
    m.mean, m.scale = rng.normal(size=fm.N_STATS), 1 + rng.random(fm.N_STATS)
    return m


def test_pairs_by_the_sum_of_squares():
    rng = np.random.default_rng(1)
    m = _machine(rng)
    docs = [fm.features(t, c) for t, c in (("a b c a", 7), ("", None), (None, 3), ("Ünï x\nx x\nÜnï", None))]
    at, value, start = m.rows(docs)
    odds, _ = m.raw(at, value, start)
    for k, (lo, hi) in enumerate(zip(start, [*start[1:], len(at)])):
        i, x = at[lo:hi], value[lo:hi]
        want = m.bias + m.weights[i] @ x + sum(
            (m.factors[i[p]] @ m.factors[i[q]]) * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert odds[k] == pytest.approx(want)
    assert np.allclose(fm.Machine.from_bytes(m.to_bytes()).scores(docs), m.scores(docs))


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    m = _machine(rng)
    m.factors *= 0.1
    docs, y = [fm.features("a b b", 5), fm.features("c", 1)], np.array([1.0, 0.0])
    at, value, start = m.rows(docs)
    loss = lambda: -np.mean(np.where(y == 1, np.log(m.scores(docs)), np.log(1 - m.scores(docs))))
    by_bias, by_weight, by_factor = fm.gradient(m, at, value, start, y)
    for f in np.unique(at):
        for table, got in ((m.weights, by_weight[at == f].sum()), (m.factors[:, 1], by_factor[at == f, 1].sum())):
            before = table[f]
            table[f] = before + 1e-5
            up = loss()
            table[f] = before - 1e-5
            assert got == pytest.approx((up - loss()) / 2e-5, abs=1e-6)
            table[f] = before
    m.bias += 1e-5
    up = loss()
    m.bias -= 2e-5
    assert by_bias == pytest.approx((up - loss()) / 2e-5, abs=1e-6)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{BASE}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = fm.judge(docs, fm.train(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    seen = sorted((r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out and truth.get(r.doc_id) is not None)
    right = sum(p == t for _, t, p in seen) / len(seen)
    share = sum(t for _, t, _ in seen) / len(seen)
    ranks = np.arange(1, len(seen) + 1)[[t == 1 for _, t, _ in seen]]
    good = len(ranks)
    auc = (ranks.sum() - good * (good + 1) / 2) / (good * (len(seen) - good))
    print("accuracy", right, "auc", auc, "share", share)
    assert right > 0.97 > share and auc > 0.98


def test_odd_rows(spark):
    rows = [(i, "good words here " * 20 if i % 2 else "BAD!! $$$ ### " * 20, i) for i in range(60)] + [
        (60, None, None), (61, "", 0), (61, "", 0), (None, "x", 1), (62, "w " * 300000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").selectExpr(
        "*", "'l' as lang", "1 as _id", "2 as _text", "3 as held_out", "4 as score", "5 as _good")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (7, None, 0), (9, 5, 0), (62, 0, 0), (60, 1, 0)],
                                   "doc_id long, quality int, toxic int").selectExpr("*", "1 as _id", "2 as _good")
    machine = fm.train(docs, labels)
    got = fm.judge(docs, machine).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60)
    assert not [r for r in got if r.doc_id is None][0].held_out
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality")
    assert fm.train(docs, flipped).to_bytes() == machine.to_bytes()
    assert {r.score for r in fm.judge(docs, fm.train(docs, labels.limit(0))).collect()} == {0.5}
    assert fm.judge(docs.limit(0), machine).count() == 0
    assert fm.judge(docs.drop("n_chars"), machine).count() == len(rows)
    one = fm.train(docs, labels.filter("quality = 1"))
    assert len({r.score for r in fm.judge(docs, one).collect()}) == 1
