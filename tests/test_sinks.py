"""Epoch books: seeds go in once, replays change nothing, late rows are kept and counted."""

import datetime as dt

from opslake.operators import batching
from opslake.streaming import sinks

START = dt.datetime(2024, 1, 1)
SCHEMA = "host string, seq long, ts timestamp"


def _rows(spark, *seqs):
    return spark.createDataFrame([("h", s, START + dt.timedelta(hours=s)) for s in seqs], SCHEMA)


def _folder(tmp_path):
    (tmp_path / "in").mkdir()
    return str(tmp_path / "in")


def _seen(df, mark):
    return sorted((r.seq, r[mark]) for r in df.collect())


def test_seed_goes_in_once_over_restarts(spark, tmp_path):
    src, seed = _folder(tmp_path), batching.seed_lines(_rows(spark, *range(10)), ["host"], 3)
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    want = [(7, True), (8, True), (9, True)]
    for k in range(3):
        _rows(spark, 10 + k).write.mode("append").parquet(src)
        got = sinks.run_into(stream, sinks.EpochTable(str(tmp_path / "run"), seed))
        want.append((10 + k, False))
        assert _seen(got, "seeded") == want
    assert _seen(sinks.run_into(stream, sinks.EpochTable(str(tmp_path / "run"), seed)), "seeded") == want


def test_a_replayed_epoch_changes_nothing(spark, tmp_path):
    table, schema = sinks.EpochTable(str(tmp_path / "t"), _rows(spark, 1, 2)), _rows(spark, 1).schema
    assert table.read(spark, schema).count() == 0
    for epoch, seqs in ((0, (3,)), (0, (3,)), (1, (4, 5)), (0, (3,)), (1, (4, 5))):
        table(_rows(spark, *seqs), epoch)
    assert _seen(table.read(spark, schema), "seeded") == [(1, True), (2, True), (3, False), (4, False), (5, False)]
    # a write of the seed that did not finish is done again
    other = sinks.EpochTable(str(tmp_path / "o"), _rows(spark, 1, 2))
    _rows(spark, 99).write.parquet(f"{tmp_path}/o/rows/epoch=-1")
    other(_rows(spark, 3), 0)
    assert _seen(other.read(spark, schema), "seeded") == [(1, True), (2, True), (3, False)]


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    schema = _rows(spark, 1).schema
    router = sinks.LateRouter(str(tmp_path / "t"), 2 * 3600)
    assert router.read(spark, schema).count() == 0 and router.books(spark).count() == 0
    nothing = _rows(spark, 1).filter("false")
    for epoch, rows in enumerate((_rows(spark, 5, 1), _rows(spark, 3, 2, 9), nothing, _rows(spark, 6, 7, 8))):
        router(rows, epoch)
    untimed = spark.createDataFrame([("h", 50, None)], SCHEMA)
    router(untimed, 4)
    want = [(1, False), (2, True), (3, False), (5, False), (6, True), (7, False), (8, False), (9, False), (50, False)]
    assert _seen(router.read(spark, schema), "late") == want
    books = lambda: sorted((r.epoch, r.on_time, r.late) for r in router.books(spark).collect())
    assert books() == [(0, 2, 0), (1, 2, 1), (2, 0, 0), (3, 2, 1), (4, 1, 0)]
    router(_rows(spark, 3, 2, 9), 1)  # replayed: its watermark is that of the epochs before it
    assert _seen(router.read(spark, schema), "late") == want and books()[1] == (1, 2, 1)


def test_late_rows_over_restarts(spark, tmp_path):
    src = _folder(tmp_path)
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    for seqs in ((10,), (20, 3), (5, 19)):
        _rows(spark, *seqs).write.mode("append").parquet(src)
        got = sinks.run_into(stream, sinks.LateRouter(str(tmp_path / "run"), 3600))
    assert _seen(got, "late") == [(3, True), (5, True), (10, False), (19, False), (20, False)]
