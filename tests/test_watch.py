"""Alert batching: sliced, whole, and streamed runs agree with a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opslake.operators import batching
from opslake.streaming import watch

START = dt.datetime(2024, 1, 1)


def loop(rows, max_lines, silence):
    """Reference fold over one ordered stream: list of batches of (seq, alert)."""
    batches, last = [[]], None
    for seq, ts, alert in rows:
        b = batches[-1]
        if len(b) >= max_lines or (any(a for _, a in b) and (ts - last).total_seconds() >= silence):
            batches.append([])
        batches[-1].append((seq, alert))
        last = ts
    return batches


def stream_of(seed, n, keys=3):
    rng = random.Random(seed)
    at = START
    rows = []
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice([0, 0.4, 1, 2.9, 3, 3.1, 40, 200]))
        key = "hot" if rng.random() < 0.6 else f"s{rng.randrange(keys)}"
        rows.append(("h", key, i, at, rng.random() < 0.15))
    return rows


@pytest.mark.parametrize(("chunk", "max_lines"), [(10, 5), (40, 5), (40, 50), (10_000, 5), (25, 1)])
def test_batches_do_not_depend_on_slices(spark, chunk, max_lines):
    rows = stream_of(11, 900)
    df = spark.createDataFrame(rows, "host string, service string, seq long, ts timestamp, alert boolean")
    got = {}
    for r in batching.number_batches(df, ["host", "service"], F.col("alert"), max_lines, 3.0, chunk).collect():
        got[r.service, r.seq] = r.batch_no
    want = {}
    for service in {r[1] for r in rows}:
        mine = [(r[2], r[3], r[4]) for r in rows if r[1] == service]
        for no, batch in enumerate(loop(mine, max_lines, 3.0), 1):
            want.update({(service, seq): no for seq, _ in batch})
    assert got == want


def test_batch_rules(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [("h", "a", 1, at(0), False), ("h", "a", 2, at(60), False),   # no alert: silence does not flush
            ("h", "a", 3, at(61), True), ("h", "a", 4, at(64), False),   # alert then 3 s: flushed
            ("h", "b", 5, at(0), False)]                                  # never an alert: dropped
    df = spark.createDataFrame(rows, "host string, service string, seq long, ts timestamp, alert boolean")
    got = batching.alert_batches(df, ["host", "service"], F.col("alert"), 50, 3.0).collect()
    assert [(r.service, r.n_lines, r.n_alerts, r.reason) for r in got] == [("a", 3, 1, "silence")]


def test_seed_defaults(spark):
    rows = [("h", i, START + dt.timedelta(seconds=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "host string, seq long, ts timestamp")
    counts = [batching.seed_lines(df, ["host"], n).count() for n in (0, -5, 7)]
    assert counts == [20, 20, 7]


@pytest.mark.parametrize("delay", [0, 50])
def test_streamed_batches_match_the_batch_form(spark, tmp_path, delay):
    rows = [(h, s, seq, ts, f"<{'ERROR' if a else 'INFO'}> line {seq // 2}", a) for h, s, seq, ts, a in stream_of(5, 300)]
    schema = "host string, service string, seq long, ts timestamp, tagged string, alert boolean"
    src = str(tmp_path / "in")
    # rows reach the stream up to ``delay`` seconds after later ones, within the allowed lateness
    rng = random.Random(9)
    arrived = sorted(rows, key=lambda r: r[3] + dt.timedelta(seconds=rng.random() * delay))
    for i in range(0, len(rows), 60):
        spark.createDataFrame(arrived[i:i + 60], schema).coalesce(1).write.mode("append").parquet(src)
    df = spark.createDataFrame(rows, schema)
    watch.end_markers(df, rows[-1][3]).coalesce(1).write.mode("append").parquet(src)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = watch.run_available(watch.batch_alert_stream(stream, 10, 3.0), str(tmp_path / "run")).collect()
    want = batching.alert_batches(df, ["host", "service"], F.col("alert"), 10, 3.0).collect()
    pick = lambda rs: {(r.service, r.batch_no, r.n_lines, r.n_alerts, r.first_seq, r.last_seq) for r in rs}
    assert pick(got) == pick(want)
    assert {r.reason for r in got} == {"full", "silence"} | {r.reason for r in want if r.reason == "shutdown"}
    texts = {(r.service, r.batch_no): r.text for r in batching.alert_batch_texts(
        df, ["host", "service"], F.col("alert"), "tagged", 10, 3.0).collect()}
    assert {(r.service, r.batch_no): r.text for r in got} == texts


def test_late_rows_are_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "ts timestamp, event_type string"
    for rows in ([(START + dt.timedelta(hours=10), "error")], [(START + dt.timedelta(hours=20), "error")],
                 [(START, "error")], [(START + dt.timedelta(hours=40), "view")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    counts = watch.tumbling_alerts(stream, "1 hour", F.col("event_type") == "error", "1 hour")
    q = (counts.writeStream.outputMode("append").trigger(availableNow=True).format("parquet")
         .option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).start())
    q.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    assert dropped == 1
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n_alerts")).head()[0] == 2


def test_seed_goes_before_the_first_micro_batch(spark, tmp_path):
    seen = []
    seed = spark.createDataFrame([("old",)], "line string")
    handle = watch.with_seed(seed, lambda df, epoch: seen.append((epoch, sorted(r[0] for r in df.collect()))))
    new = spark.createDataFrame([("new",)], "line string")
    handle(new, 0)
    handle(new, 1)
    assert seen == [(0, ["new", "old"]), (1, ["new"])]


def test_a_million_rows_of_a_key_in_one_micro_batch(spark, tmp_path):
    rows = spark.range(1_000_000).selectExpr(
        "'h' as host", "'hot' as service", "id as seq", "timestamp_millis(1704067200000 + id * 10 + if(id % 1000 >= 500, 4000, 0)) as ts",
        "concat('<ERROR> line ', id) as tagged", "id % 900 = 0 as alert")
    src = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(src)
    last = rows.agg(F.max("ts")).head()[0]
    watch.end_markers(rows, last).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    got = watch.run_available(watch.batch_alert_stream(stream, 50, 3.0), str(tmp_path / "run"))
    want = batching.alert_batches(rows, ["host", "service"], F.col("alert"), 50, 3.0)
    cols = ["batch_no", "n_lines", "n_alerts", "first_seq", "last_seq", "reason"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert got.count() > 1000
