"""History queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from opslake.catalog.base import query
from opslake.catalog.duck import trim
from opslake.catalog.fixtures import oracle, view
from opslake.operators import history
from opslake.plans.session import scratch_path

AS_OF = datetime.datetime(1998, 8, 1)


@query("history_retention", oracle(
    "select host, seq, ts, command, result from history qualify row_number() over (partition by host order by seq desc) <= 1000", "history"))
def history_retention(spark, sf_dir):
    path = scratch_path(spark, "history")
    rows = view(spark, sf_dir, "history")
    history.append(rows.filter("command = 'audit'"), path, "audits")
    history.append(rows.filter("command = 'why'"), path, "rest")
    for _ in range(2):  # a batch that comes again replaces itself
        history.append(rows.filter("command <> 'audit'"), path, "rest")
    history.retain_newest(spark, path)
    return history.load(spark, path)


@query("history_by_command", oracle("select * from history where command = 'audit'", "history"))
def history_by_command(spark, sf_dir):
    return history.entries(view(spark, sf_dir, "history"), AS_OF, "audit", limit=0)


@query("history_since", oracle(
    "select * from history where ts > timestamp '1998-08-01' - interval '90' day", "history"))
def history_since(spark, sf_dir):
    return history.entries(view(spark, sf_dir, "history"), AS_OF, since="90d", limit=0)


@query("history_last", oracle("""
select * from history where command = 'why' and ts > timestamp '1998-08-01' - interval '720' hour
qualify row_number() over (partition by host order by seq desc) <= 10""", "history"))
def history_last(spark, sf_dir):
    return history.entries(view(spark, sf_dir, "history"), AS_OF, "why", "720h")


_J = "(case when json_valid(result) then result end)"


def _field(path: str) -> str:
    return f"json_extract_string({_J}, '{path}')"


# 80 bytes, with a character that is cut in two replaced by one mark
_HEAD = r"""decode(from_hex(regexp_replace(regexp_replace(left(hex(encode(result)), 160), '^((?:..)*)C3$', '\1EFBFBD'), '$', '')))"""

_SUMMARY = f"""
case when command = 'explain' and json_valid(result) then coalesce({trim(_field('$.issues[0].what'))}, 'no issues detected')
  when command in ('why', 'audit') and {_field('$.summary')} <> '' then {trim(_field('$.summary'))}
  when command = 'status' and {_field('$.overview')} <> '' then {trim(_field('$.overview'))}
  when command = 'status' and {_field('$.summary')} <> '' then {trim(_field('$.summary'))}
  when command = 'doctor' and list_contains(json_keys({_J}), 'issues') then
    coalesce(nullif({trim(_field('$.issues[0].title'))}, ''), 'no issues detected')
  when command = 'doctor' and {_field('$.summary')} <> '' then {trim(_field('$.summary'))}
  when strlen(result) > 80 then {_HEAD} || '...' else result end"""


@query("history_summaries", oracle(f"select host, seq, command, {_SUMMARY} as summary from history", "history"))
def history_summaries(spark, sf_dir):
    return view(spark, sf_dir, "history").select(
        "host", "seq", "command", history.summary(F.col("command"), F.col("result")).alias("summary"))


@query("history_recurring", oracle(f"""
select host, command, summary, count(*) as n, min(ts) as first_seen, max(ts) as last_seen
from (select *, {_SUMMARY} as summary from history) h group by host, command, summary having count(*) > 1""", "history"))
def history_recurring(spark, sf_dir):
    rows = view(spark, sf_dir, "history")
    return history.recurring(rows.withColumn("summary", history.summary(F.col("command"), F.col("result"))))


@query("history_trend", oracle("""
select host, command, day, n, n - coalesce(lag(n) over (partition by host, command order by day), 0) as change
from (select host, command, cast(ts as date) as day, count(*) as n from history group by all) d""", "history"))
def history_trend(spark, sf_dir):
    return history.trend(view(spark, sf_dir, "history"))


@query("status_counts", oracle("""
select host, count(*) filter (where severity = 'failed') as critical, count(*) filter (where severity <> 'failed') as warnings
from anomalies group by host""", "anomalies"))
def status_counts(spark, sf_dir):
    return history.status_counts(view(spark, sf_dir, "anomalies"), "host")
