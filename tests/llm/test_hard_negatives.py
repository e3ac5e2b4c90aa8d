import math

import duckdb
import numpy as np
import pytest

from opslake.llm import hard_negatives as hn

BASE = "/root/testdata"


def brute(rows):
    """(anchor, positive, rank, negative, positive score, negative score) by comparing all pairs."""
    taken = []
    for n, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taken.append((i, n, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, n, label, x in taken:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, m, other == label) for j, m, other, y in taken if m != n)
        for ps, j, _, _ in [s for s in scored if s[3]][:5]:
            ok = [s for s in scored if not s[3] and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(i, j, k, s[1], -ps, -s[0]) for k, s in enumerate(ok, 1)]
    return sorted(out)


def _table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("sizes", [(1024, 512), (64, 3)])
def test_given_table_against_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(hn, "SLICE_ROWS", sizes[0])
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", sizes[1])
    table = spark.read.parquet(f"{BASE}/sf0.01/embeddings.parquet")
    got = sorted(map(tuple, hn.mine(table).collect()))
    assert got == brute([(r.vec_id, r.embedding, r.label) for r in table.collect()]) and len(got) > 20


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=d)], int(i % 3)) for i, d in
            enumerate(rng.choice([0, 1, 5, 70, 200], 160))]
    rows += [(50, rows[50][1], 2), (50, rows[50][1], 2), (51, rows[50][1], 0), (100, [0.0] * 5, 1), (None, [1.0], 1),
             (200, None, 1), (201, [1.0], None), (202, [1.0, None], 1), (203, [float("nan")], 1), (204, [float("-inf")], 1),
             (250, [3e4, -3e4], 4), (251, [2e4, 1.0], 4), (252, [1.5e4, 7.0], 5), (-50, [1.0, 2.0], -3), (-49, [1.0], -2)]
    want = brute(rows)
    table = _table(spark, rows).selectExpr("*", "1 as _row", "2 as _id", "3 as x", "4 as score", "5 as code")
    got = sorted(map(tuple, hn.mine(table).collect()))
    assert got == want and any(r[0] == 50 for r in got)
    assert hn.mine(table.limit(0)).count() == 0
    assert hn.mine(_table(spark, [(50, [1e30], 1), (51, [1e30], 1), (52, [1e30], 2)])).count() == 0
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label integer)")
    con.executemany("insert into embeddings values (?, ?, ?)", [list(r) for r in rows])
    assert sorted(con.execute(hn.SQL).fetchall()) == want


def test_intervals_hold_and_filter():
    rng = np.random.default_rng(5)
    for dims, scale in ((64, 256), (64, 3), (100, 1e6), (1, 10)):
        x = np.zeros((400, hn.code_width(dims)))
        x[:, :dims] = np.floor(rng.normal(size=(400, dims)) * scale / math.sqrt(dims))
        x[0], x[1], x[2] = 0, x[3], -x[3]
        a = hn.Anchors(x[:40])
        lo, hi = a.intervals(np.arange(40), *hn.encoded(x))
        exact = x[:40] @ x.T
        assert (lo <= exact).all() and (exact <= hi).all()
        if (dims, scale) == (64, 256):
            assert np.median(hi - lo) < 0.8 * np.median(a.norm) ** 2


def test_rotation_is_an_isometry():
    x = np.random.default_rng(1).normal(size=(20, 128))
    y = hn.rotated(x)
    assert y.shape == (20, 128 * hn.COPIES) and np.allclose((y * y).sum(1), (x * x).sum(1)) and np.allclose(hn.decoded(y), x)


def test_few_pairs_are_scored_and_few_rows_leave_a_slice(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(4000, 64)) * 32)
    a = hn.Anchors(x[:40])
    lo, hi = a.intervals(np.arange(40), *hn.encoded(x))
    assert np.median(hi - lo) < 0.2 * np.median(a.norm) ** 2
    table = spark.createDataFrame([(i, [float(v) for v in y], int(i % 4)) for i, y in enumerate(x / 256)],
                                  "vec_id long, embedding array<float>, label int")
    rows, width = hn.vectors(table)
    whole = rows.toArrow()
    anchors = rows.filter("_id % 50 = 0").select("_row", "_id", "label", "x").toArrow()
    scored = []
    exact = hn._scores
    monkeypatch.setattr(hn, "_scores", lambda r, a, i, j: scored.append(len(i)) or exact(r, a, i, j))
    near = hn._positives_of(whole, anchors, width)
    assert len(near) == 80 * hn.POSITIVES and sum(scored) < 0.2 * 80 * 1000
    scored.clear()
    goals = {}
    for row, score in sorted(zip(near["anchor"].to_pylist(), near["score"].to_pylist()), key=lambda r: -r[1]):
        goals.setdefault(row, []).append(score)
    asked = anchors.append_column("positives", [[goals[r] for r in anchors["_row"].to_pylist()]])
    far = hn._negatives_of(whole, asked, width)
    assert 0 < len(far) <= 80 * hn.POSITIVES * hn.NEGATIVES and sum(scored) < 0.2 * 80 * 3000
