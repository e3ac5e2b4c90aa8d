"""Skew-proof plan helpers give the same rows whatever the chunk size."""

import random

import pytest
from pyspark.sql import functions as F

from opslake.plans import partitioning as pt


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(5)}", i, rng.choice("aab"), rng.choice([None, None, "H"]))
            for i in range(600)]
    return data, spark.createDataFrame(data, "k string, n long, v string, h string").repartition(7)


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("chunk", [1, 3, 50, 100000])
def test_collapse_runs(rows, chunk):
    data, df = rows
    want = set()
    for k, rs in by_key(data).items():
        start, value, n = None, None, 0
        for r in rs:
            if n and r[2] == value:
                n += 1
                continue
            if n:
                want.add((k, start, value, n))
            start, value, n = r[1], r[2], 1
        want.add((k, start, value, n))
    got = {tuple(r) for r in pt.collapse_runs(df, ["k"], "n", "v", chunk).collect()}
    assert got == want


@pytest.mark.parametrize("chunk", [1, 4, 64, 100000])
def test_carry_forward(rows, chunk):
    data, df = rows
    want = set()
    for rs in by_key(data).values():
        last = None
        for r in rs:
            last = f"at{r[1]}" if r[3] else last
            want.add((r[1], last))
    head = F.when(F.col("h").isNotNull(), F.concat(F.lit("at"), F.col("n").cast("string")))
    got = {(r.n, r.seen) for r in pt.carry_forward(df, ["k"], "n", head, "seen", chunk).collect()}
    assert got == want


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_running_index(rows, width):
    data, df = rows
    want = {r[1]: i for rs in by_key(data).values() for i, r in enumerate(rs, 1)}
    got = pt.running_index(df, ["k"], ["n"], F.floor(F.col("n") / width), "at").collect()
    assert {r.n: r["at"] for r in got} == want


def test_last_and_first(rows):
    data, df = rows
    got = {(r.k, r.n) for r in pt.last_per_group(df, ["k"], ["n"], 4).collect()}
    assert got == {(k, r[1]) for k, rs in by_key(data).items() for r in rs[-4:]}
    first = {(r.k, r.n) for r in pt.first_per_key(df, ["k"], F.col("n")).collect()}
    assert first == {(k, rs[0][1]) for k, rs in by_key(data).items()}


def test_last_n_limits_groups_before_the_shuffle(rows):
    plan = pt.last_per_group(rows[1], ["k"], ["n"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[-1] or plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("spread_seconds", [0, 30, 100_000])
def test_no_slice_is_larger_than_asked_for(spark, spread_seconds):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else "calm", i, rng.randrange(spread_seconds + 1)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, seq long, at long").withColumn("ts", F.timestamp_seconds("at"))
    got = pt.balanced_chunks(df, ["k"], ["ts", "seq"], 100).collect()
    want = {}
    for k in ("hot", "calm"):
        for i, (_, seq) in enumerate(sorted((at, seq) for name, seq, at in rows if name == k)):
            want[seq] = i // 100
    assert {r.seq: r.chunk for r in got} == want and all(r.chunks_many for r in got)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_key_filter_loses_nothing_and_lets_few_pass(spark, n):
    df = spark.range(40_000).selectExpr("concat('h', id % 7) as host", "id as seq", "concat('text ', id) as raw")
    wanted = df.filter(F.col("seq") % 80 == 3).limit(n).select("host", "seq")
    got = pt.may_be_wanted(df, wanted, ["host", "seq"])
    assert got.columns == df.columns
    assert got.join(wanted, ["host", "seq"], "left_semi").count() == n <= got.count() <= n + 3_500
    text = got._jdf.queryExecution().executedPlan().toString()
    assert not n or ("BroadcastHashJoin" in text and "SortMergeJoin" not in text)
