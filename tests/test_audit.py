"""Snapshot diffs on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opslake.operators import audit

SETS = "host string, snapshot_id int, item string"
FILES = "host string, snapshot_id int, path string, mtime long, size long"
PERMS = "host string, snapshot_id int, path string, mode string, owner string, grp string"
PKGS = "host string, snapshot_id int, line_no long, line string"


def test_sets_ignore_repeats(spark):
    df = spark.createDataFrame([("h", 1, "a"), ("h", 1, "a"), ("h", 1, "b"), ("h", 2, "b"), ("h", 2, "c"), ("h", 2, "c")], SETS)
    assert {tuple(r) for r in audit.diff_sets(df).collect()} == {("h", "removed", "a"), ("h", "added", "c")}


def test_files(spark):
    df = spark.createDataFrame([
        ("h", 1, "/same", 1, 1), ("h", 2, "/same", 1, 1), ("h", 1, "/gone", 1, 1), ("h", 2, "/new", 1, 1),
        ("h", 1, "/m", 1, 1), ("h", 2, "/m", 2, 1), ("h", 1, "/s", 1, 1), ("h", 2, "/s", 1, 9)], FILES)
    got = {(r.change, r.path, r.old_mtime, r.new_size) for r in audit.diff_files(df).collect()}
    assert got == {("removed", "/gone", 1, None), ("added", "/new", None, 1), ("modified", "/m", 1, 1), ("modified", "/s", 1, 9)}


def test_last_duplicate_file_wins(spark):
    df = spark.createDataFrame([("h", 1, "/a", 1, 1, 1), ("h", 1, "/a", 5, 5, 2), ("h", 2, "/a", 5, 5, 3)], FILES + ", n int")
    assert audit.diff_files(df, order="n").count() == 0


def test_permissions_report_only_known_paths(spark):
    df = spark.createDataFrame([
        ("h", 1, "/a", "0644", "root", "root"), ("h", 2, "/a", "0777", "bob", "root"),
        ("h", 2, "/new", "0777", "root", "root"), ("h", 1, "/b", "0644", "root", "root"), ("h", 2, "/b", "0644", "root", "root")], PERMS)
    rows = audit.diff_permissions(df).withColumn("detail", audit.permission_detail()).collect()
    assert [(r.path, r.detail) for r in rows] == [("/a", "mode 0644→0777, owner root→bob")]


def test_packages(spark):
    df = spark.createDataFrame([
        ("h", 1, 1, "keep 1"), ("h", 2, 1, "keep 1"), ("h", 1, 2, "up 1.0 beta"), ("h", 2, 2, " up 2.0 beta "),
        ("h", 1, 3, "bare"), ("h", 2, 4, "new 3"), ("h", 1, 5, "dup 1"), ("h", 1, 6, "dup 2"), ("h", 2, 5, "dup 2"),
        ("h", 1, 7, "  ")], PKGS)
    got = {(r.change, r["item"], r.old_version, r.new_version) for r in audit.diff_packages(df).collect()}
    assert got == {("updated", "up", "1.0 beta", "2.0 beta"), ("removed", "bare ", None, None), ("added", "new 3", None, None)}


def _feed(spark, files):
    empty = lambda schema: spark.createDataFrame([], schema)
    return audit.change_feed(empty(SETS), spark.createDataFrame(files, FILES), empty(PERMS), empty(PKGS), empty(SETS), empty(SETS))


def test_feed_is_empty_for_equal_snapshots_and_mirrors(spark):
    same = [("h", s, f"/f{i}", 1, 1) for s in (1, 2) for i in range(5)]
    assert _feed(spark, same).count() == 0
    rows = [("h", 1, "/a", 1, 1), ("h", 2, "/b", 1, 1), ("h", 1, "/c", 1, 1), ("h", 2, "/c", 2, 1)]
    swap = [(h, 3 - s, p, m, z) for h, s, p, m, z in rows]
    one = {(r.change, r["item"]) for r in _feed(spark, rows).collect()}
    two = {(r.change, r["item"]) for r in _feed(spark, swap).collect()}
    turn = {"added": "removed", "removed": "added", "modified": "modified"}
    assert two == {(turn[c], i) for c, i in one}


def test_totals_fill_zeros_and_capping_counts_the_rest(spark):
    feed = _feed(spark, [("h", 2, f"/f{i:03}", 1, 1) for i in range(47)])
    totals = {(r.host, r.category, r.change): r.n for r in audit.change_totals(feed, spark.createDataFrame([("h",), ("quiet",)], "host string")).collect()}
    assert totals["h", "file", "added"] == 47 and totals["(all)", "(all)", "(all)"] == 47
    assert totals["quiet", "(all)", "(all)"] == 0 and totals["h", "user", "removed"] == 0
    capped = audit.capped_feed(feed).collect()
    assert len(capped) == 20 and {r.more for r in capped} == {27} and max(r.text for r in capped) == "/f019"


@pytest.mark.parametrize(("seconds", "text"), [
    (0, "just now"), (59, "just now"), (60, "1m"), (14_700, "4h 5m"), (7200, "2h"), (183_600, "2d 3h"), (172_800 + 300, "2d")])
def test_age(spark, seconds, text):
    assert spark.range(1).select(audit.age_text(F.lit(seconds))).head()[0] == text


def test_severity(spark):
    rows = [("port", "opened", "tcp 0.0.0.0:80", None, None, None), ("port", "opened", "tcp 0.0.0.0:8080", None, None, None),
            ("permission", "changed", "/x", "0755", "4755", "bob"), ("permission", "changed", "/x", "0644", "0666", "root"),
            ("permission", "changed", "/x", "0644", "0640", "root"), ("user", "added", "eve", None, None, None),
            ("package", "updated", "p", None, None, None)]
    df = spark.createDataFrame(rows, "category string, change string, item string, old_mode string, new_mode string, new_owner string")
    got = [r[0] for r in df.select(audit.change_severity()).collect()]
    assert got == ["critical", "warning", "critical", "critical", "warning", "critical", "info"]


def test_scope_and_dirs(spark):
    df = spark.createDataFrame([("/etc/a",), ("/etcx/a",), ("/etc/1/2/3/4/5",), ("/etc/1/2/3/4/5/6",), ("/usr/local/bin/x",), ("/opt/x",)], "path string")
    assert {r[0] for r in audit.in_scope(df).collect()} == {"/etc/a", "/etc/1/2/3/4/5", "/usr/local/bin/x"}
    assert audit.parse_dirs(" /a, ,/b ") == ["/a", "/b"] and audit.parse_dirs("  ") == []


def test_listing_skips_bad_rows(spark):
    lines = ["1718064000.9 12 /etc/a b", "x 12 /etc/c", "1 y /etc/d", "1 2", ""]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [tuple(r) for r in audit.parse_listing(df).collect()] == [(1718064000, 12, "/etc/a b")]


def test_baseline_versions(spark, tmp_path):
    path = str(tmp_path / "b")
    with pytest.raises(audit.MissingBaseline):
        audit.read_baseline(spark, path)
    audit.write_baseline(spark.createDataFrame([("h", 1)], "host string, n int"), path)
    assert [tuple(r) for r in audit.read_baseline(spark, path).collect()] == [("h", 1)]
    with pytest.raises(audit.IncompatibleBaseline):
        audit.read_baseline(spark, path, version=2)


def test_failed_category_stays_visible(spark):
    rows = spark.createDataFrame([("h", "files", "/a")], "host string, category string, entry string")
    errors = spark.createDataFrame([("h", "ports", "ss: gone")], "host string, category string, error string")
    got = {r.category: (r.entries, r.status, r.error) for r in audit.build_snapshot(rows, errors).collect()}
    assert got["ports"] == (0, "failed", "ss: gone") and got["files"] == (1, "collected", "") and got["users"][1] == "empty"
    assert len(got) == 6


def test_age_against_given_time(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "t timestamp_ntz")
    at = F.lit(dt.datetime(2024, 1, 1, 1)).cast("timestamp_ntz")
    assert df.select(audit.baseline_age(F.col("t"), at)).head()[0] == 3600


def test_snapshots_in_a_row_equal_the_pairs(spark):
    sets = lambda n: spark.createDataFrame([("h", s, f"i{k}") for s in (1, 2, 5) for k in range(n) if (k * s) % 3], SETS)
    files = spark.createDataFrame([("h", s, f"/f{k}", k * (s if k % 4 == 0 else 1), 1) for s in (1, 2, 5) for k in range(20) if (k + s) % 5], FILES)
    perms = spark.createDataFrame([("h", s, f"/f{k}", "0777" if (k + s) % 3 == 0 else "0644", "u" if s == 2 else "root", "g")
                                   for s in (1, 2, 5) for k in range(12) if k % 7 != s for _ in range(1 + k % 3)]
                                  + [("h", 2, "/f1", "0600", "x", "g")], PERMS)
    pkgs = spark.createDataFrame([("h", s, k, f"p{k % 6} {k * s}" if k % 5 else "bare") for s in (1, 2, 5) for k in range(1, 14) if k % 4 != s], PKGS)
    tables = [sets(9), files, perms, pkgs, sets(7), sets(5)]
    got = audit.change_feeds(*tables, [1, 2, 5])
    for old, new in ((1, 2), (2, 5)):
        part = sorted(map(str, got.filter((got.old_snapshot == old) & (got.new_snapshot == new)).drop("old_snapshot", "new_snapshot").collect()))
        pair = audit.change_feed(*tables, old, new)
        assert part == sorted(map(str, pair.collect())) and len(part) > 20
        singly = {
            "service": audit.diff_sets(tables[0], old, new), "file": audit.diff_files(files, old, new),
            "permission": audit.diff_permissions(perms, old, new), "package": audit.diff_packages(pkgs, old, new),
            "port": audit.diff_sets(tables[4], old, new, "opened", "closed"), "user": audit.diff_sets(tables[5], old, new)}
        for category, df in singly.items():
            named = df.withColumnRenamed("path", "item")
            mine = pair.filter(pair.category == category).select(*[c for c in named.columns])
            assert sorted(map(str, mine.collect())) == sorted(map(str, named.collect())), category
    with pytest.raises(ValueError, match="two snapshots"):
        audit.change_feeds(*tables, [1])
