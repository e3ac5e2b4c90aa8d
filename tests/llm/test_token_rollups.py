from opslake.llm import token_rollups as tr


def _rows(df):
    return sorted([tuple(r[c] for c in (*tr.KEYS, "n_docs", "n_tokens", "n_chars")) for r in df.collect()], key=str)


def _docs(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, lang string, text string, n_tokens int")


def _counted(spark, rows):
    return tr.counted(_docs(spark, rows), ["words-1"])


def test_batches_are_idempotent(spark, tmp_path):
    path, t = f"{tmp_path}/r", ["words-1"]
    docs = _counted(spark, [(1, "a", "en", "one two"), (2, "a", "en", "three"), (3, None, "fr", None)])
    tr.commit(tr.inserts(docs, t), path, "b1")
    first = _rows(tr.totals(spark, path))
    assert first == sorted([("a", "en", "words-1", 2, 3, 12), (None, "fr", "words-1", 1, 0, 0)], key=str)
    tr.commit(tr.inserts(docs, t), path, "b1")
    assert _rows(tr.totals(spark, path)) == first
    tr.commit(tr.revisions(docs.filter("doc_id = 2"), _counted(spark, [(2, "a", "en", "three four five")]), t), path, "b2")
    tr.commit(tr.deletes(docs.filter("doc_id = 3"), t), path, "b3")
    after = [("a", "en", "words-1", 2, 5, 22)]
    assert _rows(tr.totals(spark, path)) == after
    tr.compact(spark, path, "c1", ["b1", "b2"])
    assert _rows(tr.totals(spark, path)) == after
    tr.commit(tr.inserts(docs, t), path, "b1")
    tr.commit(tr.deletes(docs.filter("doc_id = 3"), t), path, "b3")
    assert _rows(tr.totals(spark, path)) == after


def test_odd_rows(spark, tmp_path):
    docs = _docs(spark, [(1, "a", "en", " x, y "), (2, "a", "en", " x, y "), (None, "b", None, None), (4, "b", "en", ""), (5, "a", "en", "z " * 70000)])
    got = _rows(tr.maintained(docs, f"{tmp_path}/r"))
    assert got == sorted([
        ("a", "en", "words-1", 2, 70002, 140003), ("a", "en", "marks-2", 2, 70003, 140003), ("b", None, "words-1", 1, 0, 0),
        ("b", None, "marks-2", 1, 0, 0), ("b", "en", "words-1", 1, 0, 0), ("b", "en", "marks-2", 1, 0, 0)], key=str)
    assert tr.maintained(docs.limit(0), f"{tmp_path}/e").count() == 0
