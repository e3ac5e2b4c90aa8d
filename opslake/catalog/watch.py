"""Live watch queries, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.catalog import duck
from opslake.catalog.base import query, table
from opslake.catalog.fixtures import VIEWS, SparkDialect, oracle, view
from opslake.functions.redact import actionable, sanitise_line
from opslake.functions.text import once
from opslake.operators import batching
from opslake.plans.partitioning import spread
from opslake.plans.session import scratch_path
from opslake.sources.follow import follow_files
from opslake.streaming import sinks, watch

WINDOW_SECONDS = 6 * 3600


def event_stream(spark, sf_dir) -> DataFrame:
    """``events`` as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return follow_files(spark, f"{sf_dir}/events*.parquet", schema)


class _StreamDialect(SparkDialect):
    def t(self, name: str) -> str:
        return f"stream_{name}"


def journal_stream(spark, sf_dir) -> DataFrame:
    feed = event_stream(spark, sf_dir)
    cores = spark.sparkContext.defaultParallelism
    if table(spark, sf_dir, "events").rdd.getNumPartitions() < cores:  # one small file; a real feed has splits enough
        feed = feed.repartition(cores)
    feed.createOrReplaceTempView("stream_events")
    return spark.sql(VIEWS["journal"](_StreamDialect(sf_dir)))


def _classified(spark, sf_dir) -> DataFrame:
    rows = spread(view(spark, sf_dir, "journal").select("seq", "ts", "host", "service", "raw"))
    return once(rows, "tagged", sanitise_line(F.col("raw"))).drop("raw").filter("tagged <> ''")


@query("stream_classified", oracle(
    f"select seq, host, service, {duck.sanitise_line('raw')} as tagged from journal", "journal"))
def stream_classified(spark, sf_dir):
    lines = watch.classify_stream(journal_stream(spark, sf_dir).select("seq", "host", "service", "raw"))
    return watch.run_available(lines.select("seq", "host", "service", "tagged"), scratch_path(spark, "classified"))


@query("watch_seed", oracle("""
select seq, ts, host, service, raw from (select *, row_number() over (partition by host, service order by ts desc, seq desc) as rn
from journal) t where rn <= 20""", "journal"))
def watch_seed(spark, sf_dir):
    return batching.seed_lines(
        view(spark, sf_dir, "journal").select("seq", "ts", "host", "service", "raw"), ["host", "service"])


_BATCHED = f"""
tagged as (select seq, ts, host, service, {duck.sanitise_line('raw')} as tagged from journal),
lines as (select *, starts_with(tagged, '<ERROR>') or starts_with(tagged, '<WARN>') as alert,
    row_number() over (partition by host, service order by ts, seq) as i from tagged),
walk as (
  select seq, ts, host, service, tagged, alert, i, 1 as batch_no, 1 as n, alert as has_alert from lines where i = 1
  union all
  select l.seq, l.ts, l.host, l.service, l.tagged, l.alert, l.i,
    case when flush then w.batch_no + 1 else w.batch_no end, case when flush then 1 else w.n + 1 end,
    case when flush then l.alert else w.has_alert or l.alert end
  from lines l join (select *, i + 1 as next_i from walk) w on l.host = w.host and l.service = w.service and l.i = w.next_i,
  lateral (select w.n >= 50 or (w.has_alert and l.ts - w.ts >= interval '{WINDOW_SECONDS}' second) as flush) f)"""


@query("alert_batches", oracle(f"""
with {_BATCHED},
b as (select host, service, batch_no, count(*) as n_lines, count(*) filter (where alert) as n_alerts,
    min(seq) as first_seq, max(seq) as last_seq from walk group by host, service, batch_no)
select host, service, cast(batch_no as bigint) as batch_no, n_lines, n_alerts, first_seq, last_seq,
  case when n_lines >= 50 then 'full' when batch_no = final then 'shutdown' else 'silence' end as reason
from (select *, max(batch_no) over (partition by host, service) as final from b) x where n_alerts > 0""",
    "journal", recursive=True))
def alert_batches(spark, sf_dir):
    return batching.alert_batches(
        _classified(spark, sf_dir), ["host", "service"], actionable(F.col("tagged")), 50, WINDOW_SECONDS)


@query("alert_batch_text", oracle(f"""
with {_BATCHED},
runs as (select *, case when lag(tagged) over (partition by host, service, batch_no order by i) = tagged then 0 else 1 end as fresh from walk),
r as (select *, sum(fresh) over (partition by host, service, batch_no order by i) as run from runs),
c as (select host, service, batch_no, run, tagged, count(*) as n, bool_or(alert) as alert from r group by all)
select host, service, cast(batch_no as bigint) as batch_no,
  string_agg(tagged || case when n > 1 then ' [x' || n || ']' else '' end, chr(10) order by run) as text
from c group by host, service, batch_no having bool_or(alert)""", "journal", recursive=True))
def alert_batch_text(spark, sf_dir):
    return batching.alert_batch_texts(
        _classified(spark, sf_dir), ["host", "service"], actionable(F.col("tagged")), "tagged", 50, WINDOW_SECONDS)


def _stream_events(spark, sf_dir) -> DataFrame:
    """The events, and one row far behind the last that lets the watermark close every window but its own."""
    events = event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp"), "user_id", "event_type")
    last = table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("ts"))
    path = scratch_path(spark, "end")
    last.select((F.col("ts") + F.expr("interval 3 days")).alias("ts"), F.lit(-1).cast("long").alias("user_id"),
                F.lit("").alias("event_type")).write.parquet(path)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(path))


def _plain_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


_ALERT = "event_type in ('error', 'purchase')"


@query("alerts_tumbling", oracle(f"""
select w as window_start, w + interval '6' hour as window_end, count(*) as n_lines, count(*) filter (where {_ALERT}) as n_alerts
from (select *, time_bucket(interval '6' hour, ts, timestamp '1970-01-01') as w from events) e group by w"""))
def alerts_tumbling(spark, sf_dir):
    counts = watch.tumbling_alerts(_stream_events(spark, sf_dir), "6 hours", F.expr(_ALERT))
    return _plain_times(watch.run_available(counts, scratch_path(spark, "tumbling")))


@query("alerts_sliding", oracle(f"""
select w as window_start, w + interval '6' hour as window_end, count(*) as n_lines, count(*) filter (where {_ALERT}) as n_alerts
from (select *, time_bucket(interval '2' hour, ts, timestamp '1970-01-01') - k * interval '2' hour as w
  from events cross join (select unnest(range(0, 3)) as k) s) e group by w"""))
def alerts_sliding(spark, sf_dir):
    counts = watch.sliding_alerts(_stream_events(spark, sf_dir), "6 hours", "2 hours", F.expr(_ALERT))
    return _plain_times(watch.run_available(counts, scratch_path(spark, "sliding")))


@query("alerts_sessions", oracle(f"""
select user_id, min(ts) as window_start, max(ts) + interval '6' hour as window_end, count(*) as n_lines,
  count(*) filter (where {_ALERT}) as n_alerts from (
  select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from (
    select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval '6' hour then 0 else 1 end as fresh
    from events) a) b group by user_id, s"""))
def alerts_sessions(spark, sf_dir):
    counts = watch.session_alerts(_stream_events(spark, sf_dir), "6 hours", "user_id", F.expr(_ALERT))
    return _plain_times(watch.run_available(counts, scratch_path(spark, "sessions")))


@query("stream_alert_batches", oracle(f"""
with {_BATCHED},
b as (select host, service, batch_no, count(*) as n_lines, count(*) filter (where alert) as n_alerts,
    min(seq) as first_seq, max(seq) as last_seq from walk group by host, service, batch_no),
f as (select *, max(batch_no) over (partition by host, service) as final from b),
runs as (select *, case when lag(tagged) over (partition by host, service, batch_no order by i) = tagged then 0 else 1 end as fresh from walk),
r as (select *, sum(fresh) over (partition by host, service, batch_no order by i) as run from runs),
c as (select host, service, batch_no, run, tagged, count(*) as n from r group by all),
t as (select host, service, batch_no, string_agg(tagged || case when n > 1 then ' [x' || n || ']' else '' end, chr(10) order by run) as text
  from c group by host, service, batch_no)
select host, service, cast(batch_no as bigint) as batch_no, n_lines, n_alerts, first_seq, last_seq,
  case when n_lines >= 50 then 'full' when batch_no = final then 'shutdown' else 'silence' end as reason, text
from f join t using (host, service, batch_no) where n_alerts > 0""", "journal", recursive=True))
def stream_alert_batches(spark, sf_dir):
    journal = view(spark, sf_dir, "journal").select("seq", "ts", "host", "service", "raw")
    stream = journal_stream(spark, sf_dir).select(*journal.columns)
    as_alerts = lambda df: df.select(
        "host", "service", "seq", F.col("ts").cast("timestamp").alias("ts"), "tagged", actionable(F.col("tagged")).alias("alert"))
    # the end of the feed: a file of end markers, which the stream reads as one more source
    path = scratch_path(spark, "markers")
    last = journal.agg(F.max("ts")).first()[0]
    markers = watch.end_markers(journal, last)
    markers.write.parquet(path)
    ends = spark.readStream.schema(markers.schema).parquet(path)
    batches = watch.batch_alert_stream(
        as_alerts(watch.classify_stream(stream)).unionByName(ends), 50, WINDOW_SECONDS)
    return watch.run_available(batches, scratch_path(spark, "batches"))


FOLLOW_FROM = "2024-01-21 00:00:00"


@query("stream_seeded", oracle(f"""
select seq, host, service, {duck.sanitise_line('raw')} as tagged, ts < timestamp '{FOLLOW_FROM}' as seeded from (
  select *, row_number() over (partition by host, service, ts < timestamp '{FOLLOW_FROM}' order by ts desc, seq desc) as rn from journal) t
where rn <= 20 or ts >= timestamp '{FOLLOW_FROM}'""", "journal"))
def stream_seeded(spark, sf_dir):
    start, columns = F.lit(FOLLOW_FROM).cast("timestamp_ntz"), ["seq", "ts", "host", "service", "raw"]
    history = view(spark, sf_dir, "journal").select(columns).filter(F.col("ts") < start)
    feed = journal_stream(spark, sf_dir).select(columns).filter(F.col("ts") >= start)
    classified = lambda df: watch.classify_stream(df).select("seq", "host", "service", "tagged")
    sink = sinks.EpochTable(scratch_path(spark, "seeded"), classified(batching.seed_lines(history, ["host", "service"])))
    return sinks.run_into(classified(feed), sink).drop("epoch")


#: Events arrive every eight days, a tenth of them eight days later; a day late is late.
ARRIVALS = 6
_ARRIVAL = f"least(greatest({{day}} // 8 + case when event_id % 10 = 0 then 1 else 0 end, 0), {ARRIVALS - 1})"


@query("late_rows", f"""
with arrived as (select *, {_ARRIVAL.format(day="date_diff('day', date '2024-01-01', cast(ts as date))")} as b from events),
latest as (select b, max(ts) as hi from arrived group by b),
marks as (select a.b, max(l.hi) - interval '1' day as mark from (select distinct b from arrived) a join latest l on l.b < a.b group by a.b)
select cast(ts as date) as day, count(*) filter (where not coalesce(ts < mark, false)) as on_time, count(*) filter (where ts < mark) as late
from arrived left join marks using (b) group by all""")
def late_rows(spark, sf_dir):
    path = scratch_path(spark, "late")
    arrival = F.expr(_ARRIVAL.format(day="datediff(ts, date'2024-01-01')").replace("//", "div"))
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    events.withColumn("b", arrival).write.partitionBy("b").parquet(f"{path}/arrivals")
    arrived = spark.read.schema("event_id long, ts timestamp, b int").parquet(f"{path}/arrivals")
    arrived.drop("b").filter("false").write.parquet(f"{path}/feed")
    feed = spark.readStream.schema("event_id long, ts timestamp").parquet(f"{path}/feed")
    router = sinks.LateRouter(f"{path}/run", 24 * 3600)
    for b in range(ARRIVALS):  # what has arrived since the stream last ran
        arrived.filter(F.col("b") == b).drop("b").write.mode("append").parquet(f"{path}/feed")
        rows = sinks.run_into(feed, router)
    return rows.groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late"))
