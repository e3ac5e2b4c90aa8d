"""Log triage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.catalog import duck
from opslake.catalog.base import query, table
from opslake.catalog.fixtures import oracle, view
from opslake.functions.redact import sanitise_line
from opslake.operators import logs
from opslake.plans.partitioning import last_per_group, spread
from opslake.plans.session import scratch_path
from opslake.sources.captures import capture_lines as to_lines
from opslake.sources.captures import read_log_files, write_log_files

SINCE, UNTIL = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
COLUMNS = ["seq", "ts", "host", "service", "boot", "priority", "raw"]


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _tiered(tier: str, where: str, keys: str, n: int) -> str:
    return f"""
select * exclude (tier, best, rn) from (
  select *, min(tier) over (partition by {keys}) as best,
    row_number() over (partition by {keys}, tier order by ts desc, seq desc) as rn
  from (select {', '.join(COLUMNS)}, {tier} as tier from journal where {where}) t) r
where tier = best and rn <= {n}"""


@query("log_scan_service", oracle(_tiered(
    "case when priority <= 3 then 0 else 1 end",
    f"service = 'nginx' and ts >= timestamp '{SINCE}' and ts <= timestamp '{UNTIL}'", "host", 50), "journal"))
def log_scan_service(spark, sf_dir):
    return logs.service_logs(
        view(spark, sf_dir, "journal"), "nginx", None, _at(SINCE), _at(UNTIL)).select(*COLUMNS)


@query("log_scan_boot", oracle(_tiered(
    "case when priority <= 3 then 0 else 1 end", "boot = -1", "host", 80), "journal"))
def log_scan_boot(spark, sf_dir):
    return logs.boot_logs(view(spark, sf_dir, "journal"), -1).select(*COLUMNS)


@query("dmesg_tiered", oracle(_tiered(
    "case when priority in (3, 4) then 0 when regexp_matches(lower(message), "
    "'error|err|warn|fail|panic|oops|segfault|oom|crit|bug') then 1 else 2 end",
    "service = 'kernel'", "host", 60), "journal"))
def dmesg_tiered(spark, sf_dir):
    return logs.kernel_logs(view(spark, sf_dir, "journal")).select(*COLUMNS)


@query("file_tail_filtered", oracle("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line,
    unnest(range(len(string_split(text, chr(10))))) as line_no from (
      select doc_id, case when ends_with(text, chr(10)) then left(text, len(text) - 1) else text end as text
      from documents) d),
last as (select * from (select *, row_number() over (partition by doc_id order by line_no desc) as rn,
    regexp_matches(lower(line), 'error|err|warn|fatal|crit|fail|panic|exception|denied|refused|timeout|traceback|segfault|oom') as hit
  from l) t where rn <= 100)
select doc_id, cast(line_no as integer) as line_no, line from (
  select *, bool_or(hit) over (partition by doc_id) as any_hit from last) x where hit or not any_hit"""))
def file_tail_filtered(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return logs.tail_filtered(logs.file_lines(docs, "doc_id", "text"), ["doc_id"])


@query("file_tail_of_logs", oracle("""
with l as (select source, doc_id, unnest(string_split(text, chr(10))) as line,
    unnest(range(len(string_split(text, chr(10))))) as line_no from (
      select source, doc_id, case when ends_with(text, chr(10)) then left(text, len(text) - 1) else text end as text
      from documents) d),
last as (select * from (select *, row_number() over (partition by source order by doc_id desc, line_no desc) as rn,
    regexp_matches(lower(line), 'error|err|warn|fatal|crit|fail|panic|exception|denied|refused|timeout|traceback|segfault|oom') as hit
  from l) t where rn <= 100)
select source, line, count(*) as n from (
  select *, bool_or(hit) over (partition by source) as any_hit from last) x where hit or not any_hit group by all"""))
def file_tail_of_logs(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("source", "doc_id", "text"))
    lines = logs.file_lines(docs.withColumn("key", F.struct("source", "doc_id")), "key", "text")
    path = scratch_path(spark, "logs")
    write_log_files(lines.select("key.source", "key.doc_id", "line_no", "line"), path, "source", ["doc_id", "line_no"])
    found = read_log_files(spark, path, "\n").withColumn("at", F.struct("file", "line_at"))
    return logs.tail_filtered(found, ["source"], "at").groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))


@query("empty_journals", oracle(f"""
select host, count(*) as journals, cast(count(*) filter (where not has) as bigint) as empty_journals from (
  select host, t <> '' and not ((contains(t, '-- No entries --') or contains(t, '-- no entries --')
      or contains(t, 'No journal files were found.'))
    and not len(list_filter(string_split(t, chr(10)), lambda l: starts_with({duck.trim('l')}, '[') or contains(l, ']:'))) > 0) as has
  from (select host, {duck.trim('text')} as t from journal_groups) a) b
group by host""", "journal_groups"))
def empty_journals(spark, sf_dir):
    return logs.count_empty_journals(view(spark, sf_dir, "journal_groups"), "text", "host")


@query("capture_lines", oracle(f"""
select * from (select host, cmd, capture_id, cast(unnest(range(len(string_split(output, chr(10))))) as integer) as line_no,
  {duck.trim("unnest(string_split(output, chr(10)))")} as line from captures) t where line <> ''""", "captures"))
def capture_lines(spark, sf_dir):
    return to_lines(view(spark, sf_dir, "captures"), ["host", "cmd", "capture_id"])


_WORDS = "error|err|warn|fatal|crit|fail|panic|exception|denied|refused|timeout|traceback|segfault|oom"


@query("error_lines", oracle(
    f"select seq, host, service, raw from journal where regexp_matches(lower(raw), '{_WORDS}')", "journal"))
def error_lines(spark, sf_dir):
    return view(spark, sf_dir, "journal").filter(logs.is_error_line(F.col("raw"))).select(
        "seq", "host", "service", "raw")


@query("errors_or_all", oracle(f"""
select seq, host, service, day, raw from (
  select *, bool_or(hit) over (partition by host, service, day) as any_hit from (
    select seq, host, service, cast(ts as date) as day, raw, regexp_matches(lower(raw), '{_WORDS}') as hit from journal) t) x
where hit or not any_hit""", "journal"))
def errors_or_all(spark, sf_dir):
    rows = view(spark, sf_dir, "journal").select(
        "seq", "host", "service", F.to_date("ts").alias("day"), "raw")
    return logs.filtered_or_all(rows, ["host", "service", "day"], logs.is_error_line(F.col("raw")))


@query("last_n_lines", oracle("""
select seq, ts, host, service, raw from (
  select *, row_number() over (partition by host, service order by ts desc, seq desc) as rn from journal) t
where rn <= 50""", "journal"))
def last_n_lines(spark, sf_dir):
    rows = view(spark, sf_dir, "journal").select("seq", "ts", "host", "service", "raw")
    return last_per_group(rows, ["host", "service"], logs.ORDER, logs.line_limit(0, "service")).orderBy(
        "host", "service", "ts", "seq")


@query("log_time_range", oracle(f"""
select seq, ts, host, service, raw from journal
where ts >= timestamp '{SINCE}' and ts <= timestamp '{UNTIL}'""", "journal"))
def log_time_range(spark, sf_dir):
    return logs.in_time_range(view(spark, sf_dir, "journal"), _at(SINCE), _at(UNTIL)).select(
        "seq", "ts", "host", "service", "raw")


SERVICES = ["sshd", "cron", "nginx"]
C_SINCE, C_UNTIL = "2024-01-05 00:00:00", "2024-01-05 06:00:00"


@query("context_digest", oracle(f"""
with picked as ({_tiered("case when priority <= 3 then 0 else 1 end",
    f"service in ('sshd', 'cron', 'nginx') and ts >= timestamp '{C_SINCE}' and ts <= timestamp '{C_UNTIL}'",
    "host, service", 50)}),
sections as (select host, service, case service when 'sshd' then 0 when 'cron' then 1 else 2 end as position,
    '--- ' || service || ' ---' || chr(10) || {duck.trim("string_agg(raw, chr(10) order by ts, seq)")} as part
  from picked group by host, service)
select host, string_agg(part, chr(10) order by position) as digest from sections group by host""", "journal"))
def context_digest(spark, sf_dir):
    return logs.context_digest(
        view(spark, sf_dir, "journal"), SERVICES, None, _at(C_SINCE), _at(C_UNTIL))


@query("context_missing", oracle(f"""
select host, service from (select distinct host from journal) h cross join (values ('sshd'), ('cron'), ('nginx')) s(service)
where not exists (select 1 from journal j where j.host = h.host and j.service = s.service
  and ts >= timestamp '{C_SINCE}' and ts <= timestamp '{C_UNTIL}')""", "journal"))
def context_missing(spark, sf_dir):
    return logs.context_missing(view(spark, sf_dir, "journal"), SERVICES, _at(C_SINCE), _at(C_UNTIL))


@query("boot_diff", oracle(f"""
with t as (select host, boot, {duck.sanitise_line('raw')} as template from journal where boot in (-1, 0)),
c as (select host, template, count(*) filter (where boot = -1) as from_n, count(*) filter (where boot = 0) as to_n,
    regexp_extract(template, '^<([A-Z]+)>', 1) as severity from t group by host, template)
select host, severity, template, from_n, to_n,
  case when from_n = 0 then 'new' when to_n = 0 then 'gone' else 'frequency' end as difference
from c where severity in ('ERROR', 'WARN') and from_n <> to_n
  and host in (select host from t where boot = -1) and host in (select host from t where boot = 0)""", "journal"))
def boot_diff(spark, sf_dir):
    return logs.boot_diff(spread(view(spark, sf_dir, "journal")), -1, 0)


@query("failure_context", oracle("""
with n as (select *, row_number() over (partition by host, service order by ts, seq) as at from journal)
select f.host, f.service, f.seq as failure_seq, f.exit_code, l.seq as line_seq, f.at - l.at as lines_before, l.raw
from n f join n l on f.host = l.host and f.service = l.service and l.at <= f.at and l.at > f.at - 50
where f.exit_code is not null""", "journal"))
def failure_context(spark, sf_dir):
    return logs.failure_context(view(spark, sf_dir, "journal"))


_CODE = ("case seq % 9 when 0 then '0' when 1 then '300' when 2 then 'abc' when 3 then '-4' "
         "else ' ' || coalesce(exit_code, seq % 256) || ' ' end")


@query("exit_code_labels", oracle(f"""
select seq, code_text, case when code is null then 'invalid exit code "' || code_text || '": must be an integer between 1 and 255'
    when code = 0 then 'exit code 0 means success — there is nothing to explain'
    when code < 1 or code > 255 then 'exit code ' || code || ' is out of range: valid exit codes are 1–255' else '' end as error,
  case when code between 1 and 255 then case code when 1 then 'generic error' when 2 then 'misuse of shell built-in or bad argument'
    when 126 then 'permission denied or command not executable' when 127 then 'command not found' when 128 then 'invalid exit argument'
    when 130 then 'terminated by SIGINT (Ctrl-C)' when 137 then 'killed by SIGKILL — likely OOM killer'
    when 139 then 'segmentation fault (SIGSEGV)' when 143 then 'terminated by SIGTERM'
    else case when code > 128 then 'terminated by signal ' || (code - 128) else 'nonzero exit' end end else '' end as label
from (select seq, code_text, try_cast(trim(code_text) as bigint) as code from (select seq, {_CODE} as code_text from journal) a) b""", "journal"))
def exit_code_labels(spark, sf_dir):
    rows = view(spark, sf_dir, "journal").selectExpr("seq", f"{_CODE} as code_text")
    code = F.trim("code_text").try_cast("bigint")
    error = logs.exit_code_error(F.col("code_text"))
    return rows.select("seq", "code_text", error.alias("error"),
                       F.when(error == "", logs.exit_code_label(code)).otherwise("").alias("label"))


@query("severity_pivot", oracle("select host, service, " + ", ".join(
    f"count(*) filter (where sev = '{s}') as n_{s.lower()}" for s in logs.SEVERITIES) + f"""
from (select host, service, regexp_extract({duck.sanitise_line('raw')}, '^<([A-Z]+)>', 1) as sev from journal) t
group by host, service""", "journal"))
def severity_pivot(spark, sf_dir):
    return logs.severity_pivot(
        spread(view(spark, sf_dir, "journal").select("host", "service", "raw")), ["host", "service"])


@query("healthy_logs", oracle(f"""
select host, service, hour, count(*) as n_lines, not bool_or(sev in ('ERROR', 'WARN')
  or (sev in ('TRANSACTION', 'SCRIPTLET') and regexp_matches(lower(tagged), 'fail|error'))) as healthy
from (select *, regexp_extract(tagged, '^<([A-Z]+)>', 1) as sev from (
  select host, service, date_trunc('hour', ts) as hour, {duck.sanitise_line('raw')} as tagged from journal) a) t
group by host, service, hour""", "journal"))
def healthy_logs(spark, sf_dir):
    rows = spread(view(spark, sf_dir, "journal")).select(
        "host", "service", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        sanitise_line(F.col("raw")).alias("tagged"))
    return logs.healthy_groups(rows, ["host", "service", "hour"], "tagged")
