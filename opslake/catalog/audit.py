"""Snapshot audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.catalog import duck
from opslake.catalog.base import query
from opslake.catalog.fixtures import oracle, view
from opslake.operators import audit
from opslake.plans.session import scratch_path

SNAPSHOT = ["services", "files", "perms", "packages", "ports", "users"]
AS_OF = "2024-01-03 04:05:06"


def _sets(name: str, added: str, removed: str) -> str:
    return f"""
select host, case when max(case when snapshot_id = 2 then 1 else 0 end) = 1 then '{added}' else '{removed}' end as change, item
from {name} group by host, item having count(distinct snapshot_id) = 1"""


_FILES = """
select coalesce(o.host, n.host) as host,
  case when o.path is null then 'added' when n.path is null then 'removed' else 'modified' end as change,
  coalesce(o.path, n.path) as path, o.mtime as old_mtime, n.mtime as new_mtime, o.size as old_size, n.size as new_size
from (select * from files where snapshot_id = 1) o full outer join (select * from files where snapshot_id = 2) n
  on o.host = n.host and o.path = n.path
where o.path is null or n.path is null or o.mtime <> n.mtime or o.size <> n.size"""

_PERMS = """
select n.host, n.path, o.mode as old_mode, o.owner as old_owner, o.grp as old_grp,
  n.mode as new_mode, n.owner as new_owner, n.grp as new_grp
from perms n join perms o on n.host = o.host and n.path = o.path and n.snapshot_id = 2 and o.snapshot_id = 1
where o.mode <> n.mode or o.owner <> n.owner or o.grp <> n.grp"""

_PKG = """
with pk as (select host, snapshot_id, split_part(line, ' ', 1) as name,
    case when contains(line, ' ') then substr(line, strpos(line, ' ') + 1) else '' end as version, line_no from packages),
lastp as (select * from (select *, row_number() over (partition by host, snapshot_id, name order by line_no desc) as rn from pk) t where rn = 1)
select coalesce(o.host, n.host) as host,
  case when o.name is null then 'added' when n.name is null then 'removed' else 'updated' end as change,
  case when o.name is null then n.name || ' ' || n.version when n.name is null then o.name || ' ' || o.version else o.name end as item,
  case when o.name is not null and n.name is not null then o.version end as old_version,
  case when o.name is not null and n.name is not null then n.version end as new_version
from (select * from lastp where snapshot_id = 1) o full outer join (select * from lastp where snapshot_id = 2) n
  on o.host = n.host and o.name = n.name
where o.name is null or n.name is null or o.version <> n.version"""


def _set_query(name: str, source: str, added: str = "added", removed: str = "removed"):
    @query(name, oracle(_sets(source, added, removed), source))
    def run(spark, sf_dir):
        return audit.diff_sets(view(spark, sf_dir, source), added=added, removed=removed)


_set_query("diff_services", "services")
_set_query("diff_ports", "ports", "opened", "closed")
_set_query("diff_users", "users")


@query("diff_files", oracle(_FILES, "files"))
def diff_files(spark, sf_dir):
    return audit.diff_files(view(spark, sf_dir, "files"))


_DETAIL = """array_to_string(list_filter([
  case when old_mode <> new_mode then 'mode ' || old_mode || '→' || new_mode end,
  case when old_owner <> new_owner then 'owner ' || old_owner || '→' || new_owner end,
  case when old_grp <> new_grp then 'group ' || old_grp || '→' || new_grp end], lambda x: x is not null), ', ')"""


@query("diff_permissions", oracle(f"select *, {_DETAIL} as detail from ({_PERMS}) p", "perms"))
def diff_permissions(spark, sf_dir):
    return audit.diff_permissions(view(spark, sf_dir, "perms")).withColumn("detail", audit.permission_detail())


@query("diff_packages", oracle(_PKG, "packages"))
def diff_packages(spark, sf_dir):
    return audit.diff_packages(view(spark, sf_dir, "packages"))


def feed(spark, sf_dir):
    return audit.change_feed(*[view(spark, sf_dir, n) for n in SNAPSHOT])


def _feed_part(category: str, sql: str, given: dict[str, str]) -> str:
    cols = []
    for c, t in audit.FEED_COLUMNS.items():
        kind = "varchar" if t == "string" else "bigint"
        value = {"host": "host", "category": f"'{category}'"}.get(c, given.get(c))
        cols.append(f"{value or f'cast(null as {kind})'} as {c}")
    return f"select {', '.join(cols)} from ({sql}) f"


_SAME = {"change": "change", "item": "item"}
_FEED = "feed as (" + " union all ".join([
    _feed_part("service", _sets("services", "added", "removed"), _SAME),
    _feed_part("file", _FILES, {"change": "change", "item": "path", **{
        c: c for c in ("old_mtime", "new_mtime", "old_size", "new_size")}}),
    _feed_part("permission", _PERMS, {"change": "'changed'", "item": "path", **{
        c: c for c in ("old_mode", "new_mode", "old_owner", "new_owner", "old_grp", "new_grp")}}),
    _feed_part("package", _PKG, {**_SAME, "old_version": "old_version", "new_version": "new_version"}),
    _feed_part("port", _sets("ports", "opened", "closed"), _SAME),
    _feed_part("user", _sets("users", "added", "removed"), _SAME),
]) + ")"


@query("change_feed", oracle(f"with {_FEED} select * from feed", *SNAPSHOT))
def change_feed(spark, sf_dir):
    return feed(spark, sf_dir)


_GRID = ", ".join(f"('{c}', '{k}')" for c, k in audit.CHANGES)


@query("change_totals", oracle(f"""
with {_FEED}, hosts as (select distinct host from files),
counted as (select host, category, change, 1 as n from feed
  union all select host, category, change, 0 from hosts cross join (values {_GRID}) g(category, change))
select coalesce(host, '(all)') as host, coalesce(category, '(all)') as category, coalesce(change, '(all)') as change,
  cast(sum(n) as bigint) as n from counted group by rollup (host, category, change)""", *SNAPSHOT))
def change_totals(spark, sf_dir):
    hosts = view(spark, sf_dir, "files").select("host").distinct()
    return audit.change_totals(feed(spark, sf_dir), hosts)


_TEXT = f"""case when change = 'modified' then item || '  (size: ' || old_size || ' → ' || new_size || ' bytes, mtime changed: '
    || case when old_mtime <> new_mtime then 'true' else 'false' end || ')'
  when category = 'permission' then item || '  (' || {_DETAIL} || ')'
  when change = 'updated' then item || '  (' || old_version || ' → ' || new_version || ')' else item end"""


@query("change_feed_capped", oracle(f"""
with {_FEED}, t as (select host, category, change, item, {_TEXT} as text from feed),
r as (select *, row_number() over (partition by host, category, change order by item, text) as rn,
    count(*) over (partition by host, category, change) as total from t)
select host, category, change, cast(rn as integer) as shown_no, text, greatest(total - 20, 0) as more from r where rn <= 20""", *SNAPSHOT))
def change_feed_capped(spark, sf_dir):
    return audit.capped_feed(feed(spark, sf_dir))


@query("change_severity", oracle(f"""
with {_FEED}
select host, category, change, item, case
  when category = 'port' and change = 'opened' and try_cast(regexp_extract(item, ':(\\d+)$', 1) as int) < 1024 then 'critical'
  when category = 'permission' and old_mode <> new_mode and (regexp_matches(new_mode, '^[0-7]*[4-7][0-7][0-7][0-7]$')
    or (regexp_matches(new_mode, '[2367]$') and new_owner = 'root')) then 'critical'
  when category = 'user' and change = 'added' then 'critical'
  when category = 'permission' or (category = 'port' and change = 'opened') or (category = 'file' and change in ('modified', 'removed'))
    or (category = 'service' and change = 'removed') or category = 'user' then 'warning' else 'info' end as severity
from feed""", *SNAPSHOT))
def change_severity(spark, sf_dir):
    return feed(spark, sf_dir).select(
        "host", "category", "change", "item", audit.change_severity().alias("severity"))


@query("sanitised_changes", oracle(
    f"with {_FEED} select " + ", ".join(
        f"{duck.sanitise_line(c)} as {c}" if c in audit.SANITISED_COLUMNS else c for c in audit.FEED_COLUMNS)
    + " from feed", *SNAPSHOT))
def sanitised_changes(spark, sf_dir):
    return audit.sanitised_changes(feed(spark, sf_dir))


@query("baseline_age", oracle(f"""
select host, version, age_seconds, case when m <= 0 then 'just now' else array_to_string(list_filter([
    case when m // 1440 > 0 then (m // 1440) || 'd' end, case when m // 60 % 24 > 0 then (m // 60 % 24) || 'h' end,
    case when m % 60 > 0 and m // 1440 = 0 then (m % 60) || 'm' end], lambda x: x is not null), ' ') end as age
from (select host, version, age_seconds, cast(floor(age_seconds / 60) as bigint) as m from (
  select host, version, date_diff('second', created_at, timestamp '{AS_OF}') as age_seconds from snapshot_meta) a) b""", "snapshot_meta"))
def baseline_age(spark, sf_dir):
    age = audit.baseline_age(F.col("created_at"), F.lit(AS_OF).cast("timestamp_ntz"))
    return view(spark, sf_dir, "snapshot_meta").select(
        "host", "version", age.alias("age_seconds"), audit.age_text(age).alias("age"))


def _rows_sql(snapshot: int) -> str:
    cols = {"services": ("services", "item"), "files": ("files", "path"), "permissions": ("perms", "path"),
            "ports": ("ports", "item"), "packages": ("packages", "line"), "users": ("users", "item")}
    return " union all ".join(
        f"select host, '{c}' as category, {col} as entry from {t} where snapshot_id = {snapshot}"
        for c, (t, col) in cols.items())


def _rows(spark, sf_dir, snapshot: int):
    return audit.snapshot_rows(*[view(spark, sf_dir, n) for n in SNAPSHOT], snapshot)


@query("snapshot_build", oracle(f"""
with r as ({_rows_sql(2)}),
c as (select host, category, count(*) as entries from r group by host, category),
h as (select host from r union select host from collection_errors)
select h.host, k.category, coalesce(c.entries, 0) as entries, coalesce(e.error, '') as error,
  case when e.error is not null then 'failed' when c.entries is null then 'empty' else 'collected' end as status
from h cross join (values ('services'), ('files'), ('permissions'), ('ports'), ('packages'), ('users')) k(category)
left join c on c.host = h.host and c.category = k.category
left join collection_errors e on e.host = h.host and e.category = k.category""", *SNAPSHOT, "collection_errors"))
def snapshot_build(spark, sf_dir):
    return audit.build_snapshot(_rows(spark, sf_dir, 2), view(spark, sf_dir, "collection_errors"))


@query("baseline_counts", oracle(
    f"with r as ({_rows_sql(1)}) select host, " + ", ".join(
        f"count(*) filter (where category = '{c}') as {c}" for c in audit.CATEGORIES)
    + " from r group by host", *SNAPSHOT))
def baseline_counts(spark, sf_dir):
    return audit.baseline_counts(_rows(spark, sf_dir, 1))


@query("diff_files_scoped", oracle("""
with roots as (select unnest(['/etc/app1', '/etc/app2', '/etc/app30', '/usr']) as root), scoped as (
  select * from files f where exists (select 1 from roots where starts_with(f.path, root || '/')
    and len(string_split(substr(f.path, len(root) + 2), '/')) <= 5))
""" + _FILES.replace("from files", "from scoped"), "files"))
def diff_files_scoped(spark, sf_dir):
    files = audit.in_scope(view(spark, sf_dir, "files"), ["/etc/app1", "/etc/app2", "/etc/app30", "/usr"])
    return audit.diff_files(files)


@query("parse_file_listing", oracle("""
select host, line_no, cast(trunc(try_cast(split_part(line, ' ', 1) as double)) as bigint) as mtime,
  try_cast(split_part(line, ' ', 2) as bigint) as size, substr(line, len(split_part(line, ' ', 1)) + len(split_part(line, ' ', 2)) + 3) as path
from listing where len(string_split(line, ' ')) >= 3 and try_cast(split_part(line, ' ', 1) as double) is not null
  and try_cast(split_part(line, ' ', 2) as bigint) is not null""", "listing"))
def parse_file_listing(spark, sf_dir):
    return audit.parse_listing(view(spark, sf_dir, "listing"))


@query("baseline_roundtrip", oracle(
    "select host, path, mtime, size from files where snapshot_id = 1", "files"))
def baseline_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "baseline")
    audit.write_baseline(view(spark, sf_dir, "files").filter("snapshot_id = 1").drop("snapshot_id"), path)
    return audit.read_baseline(spark, path)
