"""Log triage predicates and history."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from opslake.operators import history, logs


@pytest.mark.parametrize(("text", "has"), [
    ("", False), ("   \n\t  ", False), ("-- No entries --", False), ("-- no entries --", False),
    ("No journal files were found.", False), ("[12345.678] kernel: error", True),
    ("-- No entries --\n[12345.678] nginx[42]: error starting", True), ("plain text", True)])
def test_journal_content(values, text, has):
    assert values(logs.journal_has_content, [text]) == [has]


def test_error_words(values):
    lines = ["all good", "Connection REFUSED", "OOM killer", "perr", "debug only"]
    assert values(logs.is_error_line, lines) == [False, True, True, True, False]


def test_exit_codes(values):
    errors = values(logs.exit_code_error, ["1", " 137 ", "0", "256", "-1", "abc", ""])
    assert [bool(e) for e in errors] == [False, False, True, True, True, True, True]
    labels = values(lambda c: logs.exit_code_label(c.cast("int")), ["137", "150", "3", "126"])
    assert labels == ["killed by SIGKILL — likely OOM killer", "terminated by signal 22", "nonzero exit",
                      "permission denied or command not executable"]


def journal(spark, rows):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(h, s, i, base + dt.timedelta(minutes=i), p, f"m{i}", f"m{i}", c) for i, (h, s, p, c) in enumerate(rows)],
        "host string, service string, seq long, ts timestamp_ntz, priority int, message string, raw string, exit_code int")


def test_service_falls_back_to_all_lines(spark):
    rows = [("a", "nginx", 6, None)] * 5 + [("b", "nginx", 6, None)] * 3 + [("b", "nginx", 3, None)] * 2 + [("b", "sshd", 3, None)]
    got = {(r.host, r.seq) for r in logs.service_logs(journal(spark, rows), "nginx", 3).collect()}
    assert got == {("a", 2), ("a", 3), ("a", 4), ("b", 8), ("b", 9)}


def test_filtered_or_all(spark):
    df = spark.createDataFrame([("f", 1, "ok"), ("f", 2, "error x"), ("g", 3, "ok"), ("g", 4, "fine")], "g string, n int, line string")
    got = {r.n for r in logs.filtered_or_all(df, ["g"], logs.is_error_line(F.col("line"))).collect()}
    assert got == {2, 3, 4}


def test_failure_context_equals_brute_force(spark):
    rows = [("h", "hot" if i % 3 else "cold", 6, 1 if i % 11 == 0 else None) for i in range(200)]
    df = journal(spark, rows)
    got = {(r.failure_seq, r.line_seq, r.lines_before) for r in logs.failure_context(df, 7).collect()}
    want = set()
    for service in ("hot", "cold"):
        mine = [i for i, r in enumerate(rows) if r[1] == service]
        for at, i in enumerate(mine):
            if rows[i][3]:
                want |= {(i, mine[j], at - j) for j in range(max(0, at - 6), at + 1)}
    assert got == want


def test_arguments_are_checked(spark):
    with pytest.raises(ValueError):
        logs.boot_diff(journal(spark, []), 0, 0)
    with pytest.raises(ValueError):
        logs.context_logs(journal(spark, []), ["one"])
    assert [logs.line_limit(n, "file") for n in (None, 0, -3, 7)] == [100, 100, 100, 7]


@pytest.mark.parametrize(("command", "result", "want"), [
    ("explain", {"issues": [{"what": " High CPU ", "why": "x"}]}, "High CPU"),
    ("explain", {"issues": []}, "no issues detected"), ("explain", {"issues": None}, "no issues detected"),
    ("explain", {}, "no issues detected"), ("why", {"summary": "OOM"}, "OOM"), ("audit", {"summary": "3 files"}, "3 files"),
    ("status", {"overview": "healthy", "anomalies": []}, "healthy"), ("status", {"summary": "smooth"}, "smooth"),
    ("doctor", {"issues": [{"title": "nginx down"}]}, "nginx down"), ("doctor", {"summary": "look"}, "look"),
    ("doctor", {"issues": None}, "no issues detected"), ("doctor", {"issues": []}, "no issues detected"),
    ("unknown", {"a": 1}, '{"a": 1}'), ("why", {"summary": ""}, '{"summary": ""}')])
def test_summary(spark, command, result, want):
    df = spark.createDataFrame([(command, json.dumps(result))], "c string, r string")
    assert df.select(history.summary(F.col("c"), F.col("r"))).head()[0] == want


def test_long_and_broken_results_are_cut(spark):
    df = spark.createDataFrame([("explain", "x" * 100), ("other", "y" * 80)], "c string, r string")
    got = [r[0] for r in df.select(history.summary(F.col("c"), F.col("r"))).collect()]
    assert got == ["x" * 80 + "...", "y" * 80]


@pytest.mark.parametrize(("text", "hours"), [("24h", 24), ("30m", 0.5), ("1h30m", 1.5), ("7d", 168), ("1.5h", 1.5)])
def test_since(text, hours):
    assert history.parse_since(text) == dt.timedelta(hours=hours)


@pytest.mark.parametrize("text", ["", "7", "-2d", "xd", "3w", "h"])
def test_bad_since(text):
    with pytest.raises(ValueError):
        history.parse_since(text)


def test_entries_and_retention(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", i, base + dt.timedelta(hours=i), "why" if i % 2 else "audit", "{}") for i in range(30)]
    df = spark.createDataFrame(rows, "host string, seq long, ts timestamp_ntz, command string, result string")
    as_of = base + dt.timedelta(hours=29)
    assert [r.seq for r in history.entries(df, as_of, "why", "5h").collect()] == [25, 27, 29]
    assert [r.seq for r in history.entries(df, as_of, limit=3).collect()] == [27, 28, 29]
    assert history.entries(df, as_of, limit=0).count() == 30
    quiet = df.limit(1).withColumn("host", F.lit("quiet")).withColumn("seq", F.lit(-5).cast("long"))
    path = str(tmp_path / "a")
    assert history.load(spark, path).count() == 0
    history.append(df.unionByName(quiet), path, "one")
    assert history.retain_newest(spark, path, 4) == 1
    assert sorted(r.seq for r in history.load(spark, path).collect()) == [-5, 26, 27, 28, 29]


def _parts(path):
    return {str(p.relative_to(path)) for p in path.rglob("entries/**/*.parquet")}


def test_batches_replace_themselves_and_retention_rewrites_few(spark, tmp_path):
    path = str(tmp_path)
    rows = lambda host, seqs: spark.createDataFrame([
        (host, i, dt.datetime(2024, 1, 1), "why" if i % 2 else "audit", "{}") for i in seqs], history.ENTRY)
    seqs = lambda: sorted((r.host, r.seq) for r in history.load(spark, path).collect())
    history.append(rows("a", range(5)), path, "d1")
    history.append(rows("a", range(5, 10)).unionByName(rows("b", range(2))), path, "d2")
    history.append(rows("a", [77]), path, "d3")
    for _ in range(2):
        history.append(rows("a", range(10, 15)), path, "d3")
    assert seqs() == [("a", i) for i in range(15)] + [("b", 0), ("b", 1)]
    before = _parts(tmp_path)
    # d1 falls out whole, d2 in part, d3 not at all
    assert history.retain_newest(spark, path, 7) == 2
    assert seqs() == [("a", i) for i in range(8, 15)] + [("b", 0), ("b", 1)]
    new = _parts(tmp_path) - before
    assert new and all("batch=d2" in p for p in new)
    assert history.retain_newest(spark, path, 7) == 0 and _parts(tmp_path) - before == new
    history.append(rows("c", [1]), path, "d1")
    history.append(rows("c", []), path, "d2")
    assert seqs() == [("a", i) for i in range(10, 15)] + [("c", 1)]
    # entries whose write did not finish are not seen, and the next attempt replaces them
    rows("x", [1]).write.partitionBy("command").parquet(f"{path}/entries/batch=d4/form=0")
    assert ("x", 1) not in seqs()
    history.append(rows("y", [2]), path, "d4")
    assert ("x", 1) not in seqs() and ("y", 2) in seqs()
