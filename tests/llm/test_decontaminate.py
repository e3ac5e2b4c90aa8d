import random

import brute

from opslake.llm import decontaminate as dc


def test_edited_passages_against_full_alignment(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abcdef gh", k=n))
    items = [(i, text(rng.choice([20, 60, 90, 150]))) for i in range(8)]
    docs = []
    for d in range(60):
        _, t = rng.choice(items)
        cut = list(t)
        for _ in range(rng.randrange(0, len(t) // 6)):
            p = rng.randrange(len(cut))
            cut[p:p + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        docs.append((d, text(rng.randrange(60)) + "".join(cut).upper() + text(rng.randrange(60))))
    want = {}
    for d, t in docs:
        for i, item in items:
            edits = brute.semiglobal(item, t.lower())
            if edits <= dc.edit_budget(len(item)):
                want[d, i] = edits
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chars in (dc.BLOCK_CHARS, 200):
        rows = dc.contamination(df, bench, block_chars=chars).collect()
        best = {}
        for r in rows:
            best[r.doc_id, r.item_id] = min(r.edits, best.get((r.doc_id, r.item_id), r.edits))
        assert best == want
        lookup = dict(docs), dict(items)
        for r in rows:
            assert brute.edit_distance(lookup[1][r.item_id], lookup[0][r.doc_id][r.start:r.end].lower()) == r.edits
        dirty = {d for d, _ in want}
        assert {r.doc_id for r in dc.clean_documents(df, bench, block_chars=chars).collect()} == {d for d, _ in docs} - dirty
    assert 0 < len(want) < 60 * 8 and any(want.values())


def test_given_tables(spark):
    base = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in dc.contamination(docs, bench).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    exact = {(d, r.item_id) for r in bench.collect() for d, t in texts.items() if r.text in t}
    assert exact and exact <= got
    items = {r.item_id: r.text.lower().replace("\n", " ") for r in bench.collect()}
    for d, i in got - exact:
        assert brute.semiglobal(items[i], texts[d].lower().replace("\n", " ")) <= dc.edit_budget(len(items[i]))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "xx abc yy", 7), (3, "xx abc yy", 7), (None, "tiny ABC", 7)],
                                 "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "abc"), (4, "no such words are here")], "item_id long, text string")
    got = sorted([(r.doc_id or 0, r.item_id, r.edits, r.start, r.end) for r in dc.contamination(docs, bench).collect()])
    assert got == [(0, None, 0, 5, 8), (3, None, 0, 3, 6), (3, None, 0, 3, 6)]
    assert dc.contamination(docs.limit(0), bench).count() == 0 and dc.contamination(docs, bench.limit(0)).count() == 0
    assert dc.clean_documents(docs, bench).count() == 2 and dc.clean_documents(docs, bench.limit(0)).count() == 5


def test_every_region_of_an_item(spark):
    rng = random.Random(2)
    item = "".join(rng.choices("abcdefghij ", k=80))
    near = item[:40] + "zz" + item[42:]
    fill = "".join(rng.choices("klmnop ", k=500))
    text = f"{item} {fill} {item}{item} {fill} {near} tiny tinytiny"
    df = spark.createDataFrame([(1, text), (2, fill)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (6, "tiny"), (7, item)], "item_id long, text string")
    got = sorted((r.item_id, r.edits, r.start, r.end) for r in dc.contamination(df, bench).collect())
    at = [i for i in range(len(text)) if text.startswith(item, i)]
    whole = [(0, i, i + 80) for i in at] + [(2, text.index(near), text.index(near) + 80)]
    tiny = [(6, 0, i, i + 4) for i in range(len(text)) if text.startswith("tiny", i)]
    assert got == sorted([(n, *r) for n in (5, 7) for r in whole] + tiny) and len(at) == 3


def test_regions_apart():
    assert dc.apart([(1, 0, 10), (0, 5, 15), (2, 15, 20), (0, 5, 15), (3, 14, 16), (1, 30, 31)]) == [(0, 5, 15), (2, 15, 20), (1, 30, 31)]
