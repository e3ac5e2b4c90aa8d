import hashlib
import random
import time

import brute
from hypothesis import given, settings
from hypothesis import strategies as st

from opslake.llm import pii


def _base(text):
    return [s for s in pii.spans(text) if s[0] in pii.BASE]


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        want = brute.pii(text or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]
    assert sum(r.n_email for r in got.values()) and sum(r.n_ip for r in got.values())


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a.@+-0123459 ()%é\n", max_size=60))
def test_any_text(text):
    assert _base(text) == brute.pii(text)


def test_long_and_dense_texts():
    rng = random.Random(1)
    for chars in ("1. ", "1-", "@a.", "+1 ", "255.", "4 "):
        text = "".join(rng.choices(chars, k=20000))
        assert _base(text) == brute.pii(text)
    card = "4242 4242 4242 4242"
    assert _base(card) == [("card", 0, 19)]
    assert _base("0000255.1.1.001") == [("ip", 0, 15)]


def test_added_kinds_and_mask():
    text = "IBAN: DE89 3704 0044 0532 0130 00 then acct 12345678, ftp://me:pw@h.example.org"
    extra = {text[a:b] for k, a, b in pii.spans(text) if k not in pii.BASE}
    assert extra == {"DE89 3704 0044 0532 0130 00", "12345678", "me:pw"}
    assert pii.masked("to a@b.co now") == "to <EMAIL> now"
    assert not pii.spans("no such account was found, an acct of the day, accounts 123, accountant 12345678, a/c 12345")
    for cue in ("Account number: ", "ACCOUNT NO ", "account no.: ", "Acct#", "aCCt  :  ", "A/C ", "account\tNumber .", "account", "IBAN nr "):
        assert pii.spans(f"my {cue}12345678.") == [("account", 3 + len(cue), 11 + len(cue))], cue
    assert pii.spans("Iban: DE89370400440532013000") == [("account", 6, 28)]
    long = "p" * 5000
    assert pii.spans(f"{'s' * 90}://user:{long}@h") == [("login", 93, 98 + 5000)]
    assert not pii.spans("1://user:pw@h") and not pii.spans("http://user@h") and not pii.spans("http://a/b:c@d")
    assert pii.spans("account " + "1" * 34) == [("account", 8, 42)] and not pii.spans("account " + "1" * 35)


def test_added_kinds_take_linear_time():
    for part in ("acct1", "account no ", "a://b:", "a/c::", "iban ", "x://y:z@"):
        began = time.process_time()
        pii.spans(part * 40_000)
        assert time.process_time() - began < 8


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (2, "", 1), (3, "é a@b.c", 1), (3, "é a@b.c", 1)],
                               "doc_id long, text string, spans int")
    got = sorted([(r.doc_id or 0, r.n_email, r.spans) for r in pii.find(df).collect()])
    assert got == [(0, 0, ""), (2, 0, ""), (3, 1, "email:2:7"), (3, 1, "email:2:7")]
    assert pii.find(df.limit(0)).count() == 0
