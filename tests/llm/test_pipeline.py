import re

import brute
import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from opslake.llm import decontaminate, line_crf

BASE = "/root/testdata/sf0.01"


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    model = line_crf.train(docs, spark.read.parquet(f"{BASE}/labels.parquet"))
    left = {}
    for r in sorted(docs.collect()):
        good = not brute.quality(r.text)[-1]
        x, sizes, _ = line_crf.document_lines(r.text or "")
        if good and sizes[model.decode(x) == 0].sum() >= 0.5 * sizes.sum():
            left[r.doc_id] = r.text
    ids = list(left)
    group = brute.classes(ids, [brute.simhash(left[i]) for i in ids])
    left = {i: left[i] for i in ids if group[i] == i}
    items = [r.text for r in spark.read.parquet(f"{BASE}/benchmark.parquet").collect()]
    exact = [i for i, t in left.items() if any(x in t for x in items)]
    assert exact
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, BASE).collect()}
    near = {i for i in set(left) - set(got) if i not in exact}
    assert set(got) <= set(left) and not set(exact) & set(got) and len(near) < 3
    for i in near:
        found = list(decontaminate.search(decontaminate.Items(list(enumerate(items))), [left[i]]))
        assert found and brute.semiglobal(items[found[0][1]].lower(), left[i].lower()) == found[0][2]
    n_secrets = 0
    for i, r in got.items():
        text = left[i]
        for kind in (0, 1, 2):
            pattern, g, least = [
                (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
                ("AKIA[A-Z0-9]+", 0, 18), ("[0-9a-f]+", 0, 16)][kind]
            new = re.sub(pattern, lambda m, g=g, least=least: "<SECRET>" if len(m[g]) >= least else m[0], text, flags=re.ASCII)
            n_secrets += new != text
            text = new
        assert list(r.token_ids) == library.encode(text, add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)
    assert n_secrets


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0)],
                                 spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "bpe_encoding"]
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, BASE).columns == docs.columns
        assert corpus_pipeline.bpe_encoding(spark, rows, BASE).count() == rows.count()
    assert corpus_pipeline.near_duplicates(spark, docs, BASE).count() == 1


def test_stages_leave_other_columns_alone(spark):
    text = "é password=abcdefghijklmnop " + " ".join(f"w{i}" for i in range(60))
    names = ["doc_id", "text", "n_chars", "_ROW", "_hit", "_id", "_text", "blob", "print", "fp", "component_id", "fingerprint"]
    rows = [(i, text if i < 3 else f"{text} {'x ' * 40 * i}", 7, *[f"{c}{i}" for c in names[3:]]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in names[3:]))
    first = {r.doc_id: tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, BASE).collect()}
    assert first and all(first[i] == rows[i] for i in first) and not {1, 2} & set(first)
    out = corpus_pipeline.secret_scans(spark, docs, BASE)
    assert out.columns == names
    for r in out.collect():
        assert tuple(r)[3:] == rows[r.doc_id][3:] and r.text.startswith("é <SECRET> ") and r.n_chars == len(r.text)
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, BASE)
    assert sorted(map(tuple, clean.collect())) == rows
