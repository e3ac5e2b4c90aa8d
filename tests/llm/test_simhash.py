import random

import brute
import numpy as np
import pytest

from opslake.llm import simhash


def _got(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [brute.simhash(r.text) for r in rows]
    want = brute.classes([r.doc_id for r in rows], fps)
    got = _got(simhash.near_duplicates(docs))
    assert got == {r.doc_id: (f"{f:016x}", want[r.doc_id]) for r, f in zip(rows, fps)}
    stay = simhash.first_of_each(docs)
    assert stay.columns == docs.columns
    assert {r.doc_id for r in stay.collect()} == set(want.values())


@pytest.mark.parametrize("tile", [4, 4096])
def test_links_join_all_close_fingerprints(spark, tile):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:10]:
        for _ in range(40):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(20)
            fps.add(f)
    fps = [int(np.uint64(f).astype(np.int64)) for f in fps]
    want = brute.classes(fps, [f & (1 << 64) - 1 for f in fps])
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), tile)
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    alone = {v: list(want.values()).count(v) for v in set(want.values())}
    assert got == {f: v for f, v in want.items() if alone[v] > 1}


def test_odd_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "a b", 9), (3, "a b", 9), (None, "A  B", 9), (5, "x " * 70000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    ab, x = (f"{brute.simhash(t):016x}" for t in ("a b", "x x x"))
    zero = "0" * 16
    assert got == sorted([(1, zero, 1), (2, zero, 1), (3, ab, 3), (3, ab, 3), (None, ab, 3), (5, x, 5)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r.text or "" for r in simhash.first_of_each(df).collect())[:1] == [""]
    assert simhash.first_of_each(df).count() == 3
