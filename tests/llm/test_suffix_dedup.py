import hashlib
import random

import brute
import numpy as np
import pytest

from opslake.llm import suffix_dedup as sd


def _check(df, texts_of, **options):
    rows = df.collect()
    want = brute.repeats([r.text for r in rows])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(df, **options).collect()), key=str)
    assert got == sorted(((r.doc_id, n, gone, spans, hashlib.sha256(k).hexdigest())
                          for r, (n, gone, spans, k) in zip(rows, want)), key=str)
    return want


def test_suffix_order_against_plain_sort():
    rng = random.Random(4)
    for alphabet, n in (("a", 300), ("ab", 700), ("abcde", 2000), ("ab", 3)):
        text = np.frombuffer("".join(rng.choices(alphabet, k=n)).encode() + b"\xff", np.uint8)
        raw = bytes(text)
        wanted = np.array([rng.random() < 0.6 for _ in text])
        order = sd.sorted_suffixes(text, wanted)
        assert sorted(order) == np.flatnonzero(wanted).tolist()
        heads = [raw[i:i + 200] for i in order]
        assert heads == sorted(heads)
        reach = sd.common_prefix_reaches(text, order)
        full = [len(a) == 200 and a == b for a, b in zip(heads[1:], heads)]
        assert [r for r, h in zip(reach[1:], heads[1:]) if len(h) == 200] == [f for f, h in zip(full, heads[1:]) if len(h) == 200]


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = _check(docs, None)
    assert sum(w[1] for w in want)


@pytest.mark.parametrize("group_bytes", [sd.GROUP_BYTES, 300])
def test_planted_repeats(spark, group_bytes, monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdefghij é\n", k=n))
    passage, block = word(260), word(199)
    rows = [(i, word(rng.randrange(80)) + passage + word(rng.randrange(80))) for i in range(25)]
    rows += [(100, None), (101, ""), (102, "x" * 5000), (103, "abc" * 400), (104, block), (105, block), (106, word(900)),
             (None, passage), (107, passage * 2), (108, "short"), (109, ("y" * 150 + "z") * 3), (106, "q" * 201)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, data int")
    _check(df, None, group_bytes=group_bytes)


def test_tiles_do_not_change_the_result(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 6000).astype(np.uint8)
    data[3000:4500] = 97
    ends = np.array([2500, 2600, 6000])
    whole = sd.stretches(data, ends)
    monkeypatch.setattr(sd, "TILE_BYTES", 700)
    cut = sd.stretches(data, ends)
    for a, b in zip(whole[:4], cut[:4]):
        assert (a == b).all()
    assert (~whole[4] | cut[4]).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sd.remove_repeats(df).count() == 0
