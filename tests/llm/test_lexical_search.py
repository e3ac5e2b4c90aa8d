import collections
import math
import re

import duckdb
import pytest

from opslake.llm import lexical_search as ls

BASE = "/root/testdata"


def _terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    """(item, rank, document, score), every item against every document."""
    bags = [(i, collections.Counter(t), len(t)) for i, x in docs if (t := _terms(x))]
    length, n = sum(b[2] for b in bags), len(bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for at, (i, bag, size) in enumerate(bags):
            m = 75 + 25 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * bag[t] // (1000 * bag[t] + 12 * m))
                    for t in _terms(text) if bag[t])
            if s > 0:
                found.append((-s, i is None, i or 0, at, i))
        out += [(item, k, f[-1], -f[0]) for k, f in enumerate(sorted(found)[:20], 1)]
    return sorted(out, key=str)


def _got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_given_tables_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"{BASE}/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert _got(ls.search(docs, items)) == want and len(want) > 100


@pytest.mark.parametrize("chars", [1 << 22, 40])
def test_odd_texts(spark, monkeypatch, chars):
    monkeypatch.setattr(ls, "BLOCK_CHARS", chars)
    docs = [(i, "Copy of a COPY, naïve Ünï 7") for i in range(90, 40, -1)] + [(i, f"copy {'x ' * (i % 3)}b") for i in range(40)]
    docs += [(100, None), (101, ""), (102, "--- \n"), (None, "rare word"), (None, "rare word"), (5, "rare word"), (5, "rare word"),
             (200, "rare " * 50000 + "word"), (201, "ünï ÜNÏ copy"), (202, "the the the")] + [(i, "the") for i in range(300, 500)]
    items = [(1, "copy of naïve"), (1, "RARE word word"), (2, None), (3, ""), (4, "nowhere"), (5, "the"), (6, "Ünï ÜNÏ x"), (7, "b copy copy")]
    want = brute(docs, items)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as _row", "2 as n", "3 as bag", "4 as class")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as _row", "2 as item", "3 as doc_id")
    assert _got(ls.search(d, q)) == want
    assert not ls.search(d.limit(0), q).collect() and not ls.search(d, q.limit(0)).collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [list(r) for r in docs])
    con.executemany("insert into benchmark values (?, ?)", [list(r) for r in items])
    assert sorted(con.execute(ls.SQL).fetchall(), key=str) == want


def test_copies_are_scored_once(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'Alpha beta', concat('alpha ', id)) as text")
    items = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "item_id long, text string")
    got = _got(ls.search(docs, items))
    assert [g[2] for g in sorted(got) if g[0] == 2] == list(range(0, 60, 3))
    assert got == brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
