import gzip
import hashlib

import pytest

from opslake.llm import warc


def _want(pages):
    first = {}
    for p in sorted(pages, key=lambda r: r.page_id):
        first.setdefault(p.html or "", p.page_id)
    out = {}
    for p in pages:
        body = (p.html or "").encode()
        again = len(body) >= 100 and first[p.html or ""] != p.page_id
        out[p.page_id] = (len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response",
                          first[p.html] if again else None)
    return out


def test_whole_table_against_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(pages.union(pages.selectExpr("page_id + 100000", "url", "html"))).collect()}
    rows = pages.union(pages.selectExpr("page_id + 100000", "url", "html")).collect()
    assert got == _want(rows)


def test_payloads_come_back_whole(spark, tmp_path):
    nasty = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5
    rows = [(1, "http://a/\r\nX: y", nasty, 0), (2, None, nasty, 0), (3, "u", None, 0), (4, "u", "", 0), (5, "u", "short", 0),
            (6, "u", "short", 0), (7, "u", "é🙂\r\n" * 40000, 0), (8, "u", "\r\n\r\n", 0)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, digest int")
    path = warc.write(df, f"{tmp_path}/w")
    got = {r.page: r for r in warc.read(spark, path, payloads=True).collect()}
    assert {k: r.body for k, r in got.items()} == {1: nasty, 2: "", 3: "", 4: "", 5: "short", 6: "short", 7: rows[6][2], 8: "\r\n\r\n"}
    assert got[2].type == "revisit" and got[2].refers_id == got[1].record_id and got[1].url == "http://a/ X: y"
    out = {r.page_id: tuple(r)[1:] for r in warc.resolved(warc.read(spark, path)).collect()}
    assert out[2] == (len(nasty), hashlib.sha256(nasty.encode()).hexdigest(), "revisit", 1)


def test_repeated_rows_null_ids_and_empty(spark):
    body = "y" * 100
    df = spark.createDataFrame([(2, "u", body), (2, "u", body), (None, "v", body), (1, "w", "z" * 99), (3, "w", "z" * 99)],
                               "page_id long, url string, html string")
    got = sorted([(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()], key=str)
    assert got == sorted([(2, "response", None), (2, "revisit", 2), (None, "revisit", 2), (1, "response", None), (3, "response", None)], key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_reader_takes_members_and_plain_files():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    for packed in (one * 3, gzip.compress(one * 3), gzip.compress(one) * 3):
        got = list(warc.parse(warc._unpacked(packed, 7)))
        assert [b for _, b in got] == [b"abcd"] * 3
    for cut in (one[:-8], one[:20], b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(iter([cut])))
    assert list(warc.parse(iter([]))) == []
