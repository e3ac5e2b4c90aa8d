"""Fleet inventory queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from opslake.catalog.base import query
from opslake.catalog.duck import trim
from opslake.catalog.fixtures import oracle, view
from opslake.operators import digests
from opslake.operators.inventory import crons, firewall, hosts, mounts, ports, process, timers, updates
from opslake.plans.partitioning import spread


def _lines(spark, sf_dir, name: str):
    return spread(view(spark, sf_dir, name))


def _f(line: str = "line") -> str:
    return f"list_filter(regexp_split_to_array({line}, '\\s+'), lambda x: x <> '')"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


# --- ports --------------------------------------------------------------------------

_PORTS = f"""ports as (select host, proto as protocol, local, process from (
  select *, row_number() over (partition by host, proto, local order by line_no) as rn from (
    select host, proto, line_no, f[4] as local, case when len(f) >= 6 and regexp_extract(f[6], '\\("([^"]+)",pid=(\\d+)', 1) <> ''
      then regexp_extract(f[6], '\\("([^"]+)",pid=(\\d+)', 1) || ' (pid ' || regexp_extract(f[6], '\\("([^"]+)",pid=(\\d+)', 2) || ')' else '' end as process
    from (select *, {_f()} as f from ss) a where len(f) >= 4 and f[4] <> '*') b) c where rn = 1)"""
_SPLIT = """split as (select *, regexp_extract(local, '^(.*):[^:]*$', 1) as address,
  try_cast(nullif(regexp_extract(local, ':([0-9]+)$', 1), '') as integer) as port from ports)"""
_OUTSIDE = "not regexp_matches(address, '^(127\\.|\\[::1\\])')"


def _ports(spark, sf_dir):
    return ports.inventory(_lines(spark, sf_dir, "ss"))


@query("ports_inventory", oracle(f"with {_PORTS} select * from ports", "ss"))
def ports_inventory(spark, sf_dir):
    return _ports(spark, sf_dir).orderBy("host", "protocol", "local")


_EXPOSED = f"""exposed as (select host, protocol, local, port, process, finding,
  case when finding like 'persistent%' then 'info' else 'warning' end as severity from (
  select *, case when address in ('0.0.0.0', '[::]', '*') and port in {_in(ports.SENSITIVE_PORTS)} then 'sensitive port on all interfaces'
    when name <> '' and ((port = 22 and name <> 'sshd') or (port in (80, 443) and name not in ('nginx', 'apache2', 'httpd')))
      then 'unexpected process on a standard port'
    when address in ('0.0.0.0', '[::]', '*') and port >= 32768 then 'persistent listener on a high port' end as finding
  from (select *, regexp_extract(process, '^(.*) \\(pid \\d+\\)$', 1) as name from split where {_OUTSIDE}) s) t where finding is not null)"""


@query("port_exposure", oracle(f"with {_PORTS}, {_SPLIT}, {_EXPOSED} select * from exposed", "ss"))
def port_exposure(spark, sf_dir):
    return ports.exposure(_ports(spark, sf_dir))


@query("port_finding_counts", oracle(f"""
with {_PORTS}, {_SPLIT}, {_EXPOSED} select host, count(*) filter (where severity = 'warning') as warnings,
  count(*) filter (where severity <> 'warning') as info from exposed group by host""", "ss"))
def port_finding_counts(spark, sf_dir):
    return ports.finding_counts(ports.exposure(_ports(spark, sf_dir)))


@query("ports_digest", oracle(f"""
with {_PORTS}, hosts as (select distinct host from ss),
n as (select host, row_number() over (partition by host order by protocol, local) as number,
    protocol || '  ' || local || '  — ' || case when process <> '' then process else '(process unknown)' end as line from ports),
p as (select host, (number - 1) // 1000 as page, string_agg(line, chr(10) order by number) as digest from n group by all)
select hosts.host, coalesce(page, 0) as page, coalesce(digest, '(no listening ports found)') as digest from hosts left join p on p.host = hosts.host""", "ss"))
def ports_digest(spark, sf_dir):
    all_hosts = _lines(spark, sf_dir, "ss").select("host").distinct()
    bucket = F.struct("protocol", F.substring("local", 1, 9).alias("prefix"))  # joined texts would sort tcp6 before tcp
    return digests.paged_digest(_ports(spark, sf_dir), all_hosts, ["protocol", "local"], bucket,
                                ports.digest_line(), "(no listening ports found)")


# --- firewall -----------------------------------------------------------------------

_COLS = ", ".join(firewall.RULE_COLUMNS)
_FIREWALLD = f"""
select host, backend, line_no, cast(i - 1 as integer) as item, zone as chain, case when kind = 'rich-rules' then 'RULE' else 'ALLOW' end as action,
  case when kind = 'ports' then case when contains(v, '/') then regexp_extract(v, '^[^/]*/(.*)$', 1) else 'tcp' end else '' end as protocol,
  case when kind = 'ports' then split_part(v, '/', 1) else '' end as port,
  case kind when 'ports' then 'any' when 'sources' then v else '' end as source,
  case kind when 'services' then 'service: ' || v when 'sources' then 'trusted source' when 'rich-rules' then 'rich rule: ' || v else '' end as comment, '' as match
from (select host, backend, zone, line_no, kind, unnest(vs) as v, unnest(range(1, len(vs) + 1)) as i from (
  select *, case when kind = 'rich-rules' then list_filter([trim(rest)], lambda x: x <> '') else {_f('rest')} end as vs from (
    select *, regexp_extract(trim(line), '^(ports|services|sources|rich-rules):(.*)$', 1) as kind,
      regexp_extract(trim(line), '^(ports|services|sources|rich-rules):(.*)$', 2) as rest
    from fw_lines where backend = 'firewalld') a where kind <> '') b) c"""
_UFW = f"""
select host, backend, line_no, 0 as item, '' as chain,
  f[a + 1] || case when f[a + 2] in ('IN', 'OUT') then ' ' || f[a + 2] else '' end as action,
  regexp_extract(f[a], '^[^/]*/(.*)$', 1) as protocol, split_part(f[a], '/', 1) as port,
  coalesce(list_filter(f, lambda x: x = 'Anywhere' or contains(x, '.') or contains(x, ':'))[-1], '') as source,
  coalesce(trim(array_to_string(f[list_filter(range(a + 1, len(f) + 1), lambda i: starts_with(f[i], '('))[1]:], ' '), '()'), '') as comment, '' as match
from (select *, list_filter(range(1, len(f) + 1), lambda i: contains(f[i], '/'))[1] as a from (
  select *, {_f('trim(line)')} as f from fw_lines where backend = 'ufw' and trim(line) <> ''
    and not starts_with(trim(line), 'Status:') and not starts_with(trim(line), 'To')) x where len(f) >= 4) y
where a is not null and a < len(f)"""
_NFT = f"""
select host, backend, line_no, 0 as item, coalesce(chain_name, '') as chain, upper(f[-1]) as action,
  case when contains(t, 'tcp ') then 'tcp' when contains(t, 'udp ') then 'udp' else 'all' end as protocol,
  case when contains(t, 'dport ' || chr(123)) then replace(replace(trim(regexp_extract(t, 'dport ' || chr(92) || chr(123) || '([^' || chr(125) || ']*)', 1)), ', ', ','), ' ', ',')
    when contains(t, 'dport ') then f[list_position(f, 'dport') + 1] else '' end as port, '' as source, '' as comment, array_to_string(f[:-2], ' ') as match
from (select *, trim(line) as t, {_f('trim(line)')} as f,
    last_value(case when starts_with(trim(line), 'chain ') then ({_f('trim(line)')})[2] end ignore nulls) over (partition by host order by line_no) as chain_name
  from fw_lines where backend = 'nftables') x
where not starts_with(t, 'chain ') and (t in ('drop', 'accept') or {' or '.join(f"starts_with(t, '{s}')" for s in firewall.NFT_STARTS)})"""
_IPT = f"""
select host, backend, line_no, 0 as item, chain_name as chain,
  case when header then upper(regexp_extract(t, '\\(policy (.*)\\)$', 1)) else f[1] end as action,
  case when header then '' when f[2] = '0' then 'all' else f[2] end as protocol,
  case when header then '' else coalesce(substr(list_filter(f, lambda x: starts_with(x, 'dpt:'))[-1], 5), '') end as port,
  case when header then '' else f[4] end as source, case when header then 'default policy' else '' end as comment,
  case when header then '' else array_to_string(f[6:], ' ') end as match
from (select *, trim(line) as t, {_f('trim(line)')} as f, starts_with(trim(line), 'Chain ') as header,
    last_value(case when starts_with(trim(line), 'Chain ') then ({_f('trim(line)')})[2] end ignore nulls) over (partition by host order by line_no) as chain_name
  from fw_lines where backend = 'iptables') x
where (header and contains(t, '(policy ')) or (not header and not starts_with(t, 'target') and not starts_with(t, 'pkts')
  and len(f) >= 4 and chain_name is not null)"""


def _backend(name: str, sql: str, parse):
    @query(name, oracle(sql, "fw_lines"))
    def run(spark, sf_dir):
        return parse(_lines(spark, sf_dir, "fw_lines"))


_backend("fw_rules_firewalld", _FIREWALLD, firewall.firewalld_rules)
_backend("fw_rules_ufw", _UFW, firewall.ufw_rules)
_backend("fw_rules_nft", _NFT, firewall.nft_rules)
_backend("fw_rules_iptables", _IPT, firewall.iptables_rules)

_RULES = "rules as (" + " union all ".join(f"select {_COLS} from ({q}) r" for q in (_FIREWALLD, _UFW, _NFT, _IPT)) + ")"


def _rules(spark, sf_dir):
    return firewall.all_rules(_lines(spark, sf_dir, "fw_lines"))


@query("fw_read_status", oracle(f"""
with {_RULES} select r.host, r.backend, r.warning, coalesce(n, 0) as rules,
  case when r.backend = '' then 'none' when warning <> '' and coalesce(n, 0) = 0 then 'failed' when warning <> '' then 'partial'
    when coalesce(n, 0) = 0 then 'empty' else 'ok' end as read_status
from fw_reads r left join (select host, count(*) as n from rules group by host) c on c.host = r.host""", "fw_lines", "fw_reads"))
def fw_read_status(spark, sf_dir):
    return firewall.read_status(view(spark, sf_dir, "fw_reads"), _rules(spark, sf_dir))


_NUMBERED = "list_transform(string_split(ports, ','), lambda p: case p " + " ".join(
    f"when '{k}' then '{v}'" for k, v in firewall.SERVICE_PORTS.items()) + " else p end)"
_RANGED = f"""ported as (select *, case when port <> '' then port
    when regexp_matches(match, 'multiport dports [^ ]+') then regexp_extract(match, 'multiport dports ([^ ]+)', 1)
    else regexp_extract(match, 'dpts:([0-9]+:[0-9]+)', 1) end as ports from rules),
ranged as (select *, len(list_filter({_NUMBERED}, lambda p: p <> '' and not regexp_matches(p, '^[0-9]+([-:][0-9]+)?$'))) as unknown,
  case when ports <> '' then list_transform(list_filter({_NUMBERED}, lambda p: regexp_matches(p, '^[0-9]+([-:][0-9]+)?$')),
    lambda p: [cast(regexp_extract(p, '^([0-9]+)', 1) as integer), cast(regexp_extract(p, '([0-9]+)$', 1) as integer)]) else [] end as rs from ported)"""
_ALLOW = "(action like 'ALLOW%' or action = 'ACCEPT')"
_ANY = f"source in {_in(firewall.ANY_SOURCE)}"
# The rules of inbound chains with the ports they decide, in their order; the default policy comes last.
_DECIDING = f"""{_RANGED}, services(name, number) as (values {', '.join(f"('{k}', {v})" for k, v in firewall.SERVICE_PORTS.items())}),
judged as (select *, {_ALLOW} as allow, comment = 'default policy' as policy,
    regexp_matches(action, '^(DROP|REJECT|DENY)') as closed, {_ANY} and (case when backend = 'nftables' then match = '' or regexp_matches(match, '^(tcp|udp) dport ([0-9a-z-]+|\\{{[^\\}}]*\\}})$')
      else trim(regexp_replace(match, '(tcp|udp|dpts?:[0-9:]+|multiport dports [^ ]+|reject-with [^ ]+)', '', 'g')) = '' end) as unlimited
  from ranged where upper(chain) not in ('OUTPUT', 'FORWARD') and action not like '% OUT'),
bounded as (
  select host, chain, protocol, policy, line_no, item, allow, r[1] as lo, r[2] as hi from (
    select *, unnest(rs) as r from judged where not policy and (allow or (closed and unlimited))) a
  union all select host, chain, protocol, policy, line_no, item, allow, 0, 65535 from judged
    where (policy and upper(chain) = 'INPUT' and (allow or closed))
      or (not policy and ports = '' and unlimited and (closed or (allow and backend = 'nftables' and match = '')))
  union all select host, chain, protocol, policy, line_no, item, allow, number, number from judged join services on comment = 'service: ' || name where allow),
deciding as (select host, chain, p as protocol, row_number() over (partition by host order by policy, line_no, item) as place, policy, allow, lo, hi
  from bounded join (values ('tcp', 'tcp'), ('udp', 'udp'), ('', 'tcp'), ('', 'udp'), ('all', 'tcp'), ('all', 'udp'), ('6', 'tcp'), ('17', 'udp')) v(q, p) on protocol = q),
listening as (select distinct host, protocol, port from split where {_OUTSIDE} and port is not null)"""


@query("fw_unprotected_listeners", oracle(f"""
with {_PORTS}, {_SPLIT}, {_RULES}, {_DECIDING},
decided as (select l.host, l.protocol, l.port, d.chain, arg_min(allow, place) as open
  from listening l join deciding d on d.host = l.host and d.protocol = l.protocol and l.port between d.lo and d.hi group by all)
select host, protocol, port from listening l where host in (select host from rules) and not exists (
  select 1 from decided d where d.host = l.host and d.protocol = l.protocol and d.port = l.port and open)""", "ss", "fw_lines"))
def fw_unprotected_listeners(spark, sf_dir):
    # listeners that ss shows twice are one anyway
    heard = ports.parse(view(spark, sf_dir, "ss"))
    return firewall.unprotected_listeners(heard, firewall.all_rules(view(spark, sf_dir, "fw_lines")))


@query("fw_stale_rules", oracle(f"""
with {_PORTS}, {_SPLIT}, {_RULES}, {_DECIDING},
cuts as (select distinct host, protocol, chain, unnest([lo, hi + 1]) as start from deciding),
spans as (select *, lead(start) over (partition by host, protocol, chain order by start) - 1 as stop from cuts),
firsts as (select s.host, s.protocol, s.chain, s.start, s.stop, min(place) as place, arg_min(allow and not policy, place) as open
  from spans s join deciding d on d.host = s.host and d.protocol = s.protocol and d.chain = s.chain and s.start between d.lo and d.hi group by all),
islands as (select *, start - sum(stop - start + 1) over (partition by host, protocol, chain, place order by start) + (stop - start + 1) as island
  from firsts where open),
open as (select distinct host, protocol, lo, hi from (select host, protocol, chain, place, island, min(start) as lo, max(stop) as hi from islands group by all) i)
select host, protocol, lo, hi from open o where not exists (
  select 1 from listening l where o.host = l.host and o.protocol = l.protocol and l.port between o.lo and o.hi)""", "ss", "fw_lines"))
def fw_stale_rules(spark, sf_dir):
    return firewall.stale_rules(ports.parse(view(spark, sf_dir, "ss")), firewall.all_rules(view(spark, sf_dir, "fw_lines")))


def _cover(known) -> str:
    return "(" + " or ".join(f"len(list_filter(rs, lambda r: r[1] <= {p} and r[2] >= {p})) > 0" for p in known) + ")"


@query("fw_findings", oracle(f"""
with {_RULES}, {_RANGED}
select {_COLS}, finding, case when finding in ('all ports open to any source', 'management port open to any source') then 'critical'
  when finding in ('rich rule to review', 'port name not known') then 'info' else 'warning' end as severity from (
  select *, case when comment = 'default policy' then case when action = 'ACCEPT' and chain in ('INPUT', 'FORWARD') then 'default policy accepts' end
    when action = 'RULE' then 'rich rule to review'
    when {_ALLOW} and chain <> 'OUTPUT' and {_ANY} and {_cover([1])} and {_cover([65535])} then 'all ports open to any source'
    when {_ALLOW} and chain <> 'OUTPUT' and {_ANY} and backend = 'iptables' and port = '' and protocol = 'all' and match = '' then 'everything accepted, perhaps on one interface'
    when {_ALLOW} and chain <> 'OUTPUT' and {_ANY} and backend = 'iptables' and port = '' and protocol in ('tcp', '6', 'udp', '17') and match = '' then 'whole protocol accepted, perhaps on one interface'
    when {_ALLOW} and chain <> 'OUTPUT' and {_ANY} and {_cover(firewall.MANAGEMENT_PORTS)} then 'management port open to any source'
    when {_ALLOW} and chain <> 'OUTPUT' and {_ANY} and {_cover(firewall.CRITICAL_PORTS)} then 'critical service open to any source'
    when regexp_matches(action, '^(DROP|REJECT|DENY)') and ({_cover(firewall.MANAGEMENT_PORTS)} or {_cover(firewall.CRITICAL_PORTS)}) then 'service blocked'
    when unknown > 0 then 'port name not known' end as finding
  from ranged) x where finding is not null""", "fw_lines"))
def fw_findings(spark, sf_dir):
    return firewall.findings(_rules(spark, sf_dir))


# --- mounts -------------------------------------------------------------------------

_MOUNTS = f"""mnt as (select host, device, mountpoint, fstype, options from (
  select *, row_number() over (partition by host, mountpoint order by line_no) as rn from (
    select host, line_no, f[1] as device, replace(f[2], chr(92) || '040', ' ') as mountpoint, f[3] as fstype, f[4] as options
    from (select *, {_f('trim(line)')} as f from mounts where trim(line) <> '' and not starts_with(trim(line), '#')) a where len(f) >= 4) b) c where rn = 1)"""


def _human(c: str) -> str:
    n = f"try_cast({c} as bigint)"
    return (f"case when {n} is null or {n} < 0 then {c} when {n} >= 1048576 then printf('%.1fG', {n} / 1048576.0) "
            f"when {n} >= 1024 then printf('%.1fM', {n} / 1024.0) else {n} || 'K' end")


_PSEUDO = f"fstype in {_in(mounts.PSEUDO_TYPES)}"
_NFS = f"fstype in {_in(mounts.NFS_TYPES)}"
_USAGE = f"""usage as (select * from (select *, row_number() over (partition by host, mountpoint order by line_no desc) as rn from (
    select host, line_no, f[6] as mountpoint, {_human('f[2]')} as size, {_human('f[3]')} as used, {_human('f[4]')} as avail, f[5] as use_percent
    from (select *, {_f()} as f from df_lines) a where len(f) >= 6 and f[1] <> 'Filesystem') b) c where rn = 1),
mu as (select m.*, {', '.join(f"case when {_PSEUDO} or {_NFS} then '' else coalesce(u.{c}, '') end as {c}" for c in ('size', 'used', 'avail', 'use_percent'))}
  from mnt m left join usage u on u.host = m.host and u.mountpoint = m.mountpoint),
mp as (select mu.*, {_NFS} and coalesce(p.stale, false) as stale from mu left join (
  select host, device, bool_or(stale) as stale from nfs_probes group by all) p on p.host = mu.host and p.device = mu.device)"""


def _mounts(spark, sf_dir):
    return mounts.mount_table(view(spark, sf_dir, "mounts"))


def _probed(spark, sf_dir, table=None):
    table = _mounts(spark, sf_dir) if table is None else table
    used = mounts.with_usage(table, mounts.usage_table(view(spark, sf_dir, "df_lines")))
    return mounts.with_probe(used, view(spark, sf_dir, "nfs_probes"))


@query("mounts_dedup", oracle(f"with {_MOUNTS} select * from mnt", "mounts"))
def mounts_dedup(spark, sf_dir):
    return _mounts(spark, sf_dir)


@query("mount_usage", oracle(f"with {_MOUNTS}, {_USAGE} select * from mu", "mounts", "df_lines", "nfs_probes"))
def mount_usage(spark, sf_dir):
    return mounts.with_usage(_mounts(spark, sf_dir), mounts.usage_table(view(spark, sf_dir, "df_lines")))


@query("mount_kind_counts", oracle(f"""
with {_MOUNTS}, {_USAGE} select host, count(*) as total, count(*) filter (where not {_PSEUDO}) as "real",
  count(*) filter (where {_NFS}) as nfs, count(*) filter (where {_NFS} and stale) as stale_nfs from mp group by host""",
    "mounts", "df_lines", "nfs_probes"))
def mount_kind_counts(spark, sf_dir):
    return mounts.kind_counts(mounts.with_probe(_mounts(spark, sf_dir), view(spark, sf_dir, "nfs_probes")))


@query("pseudo_fs_summary", oracle(f"""
with {_MOUNTS}, c as (select host, fstype, count(*) as n from mnt where {_PSEUDO} group by all)
select host, string_agg(fstype || '×' || n, ', ' order by fstype) as pseudo_filesystems from c group by host""", "mounts"))
def pseudo_fs_summary(spark, sf_dir):
    return mounts.pseudo_summary(_mounts(spark, sf_dir))


@query("mount_findings", oracle(f"""
with {_MOUNTS}, {_USAGE}, x as (select *, try_cast(nullif(regexp_extract(use_percent, '^([0-9]+)%$', 1), '') as integer) as pct from mp where not {_PSEUDO})
select host, mountpoint, 'critical' as severity, 'disk almost full' as finding from x where pct >= 95
union all select host, mountpoint, 'warning', 'disk filling up' from x where pct >= 85 and pct < 95
union all select host, mountpoint, 'critical', 'network mount is stale' from x where stale
union all select host, mountpoint, 'warning', 'mounted read-only' from x where list_contains(string_split(options, ','), 'ro') and not regexp_matches(mountpoint, '^/(boot|sys)(/|$)')
union all select host, mountpoint, 'warning', 'remounts read-only on errors' from x where list_contains(string_split(options, ','), 'errors=remount-ro')""",
    "mounts", "df_lines", "nfs_probes"))
def mount_findings(spark, sf_dir):
    return mounts.findings(_probed(spark, sf_dir))


# --- timers -------------------------------------------------------------------------

def _last(key: str) -> str:
    return f"coalesce(arg_max(case when k = '{key}' then v end, case when k = '{key}' then line_no end), '') as \"{key}\""


def _usec(c: str) -> str:
    n = f"case when regexp_matches({c}, '^[0-9]+$') then try_cast({c} as bigint) end"
    return f"case when {n} > 0 then make_timestamp({n}) end"


_KV = "trim(split_part(line, '=', 1)) as k, trim(substr(line, strpos(line, '=') + 1)) as v"
_TIMERS = f"""kv as (select host, unit, line_no, {_KV} from timer_lines where strpos(line, '=') > 1),
w as (select host, unit, {', '.join(_last(p) for p in timers.PROPERTIES)} from kv group by host, unit),
sr as (select host, unit as activates, max(v) as res from (select host, unit, {_KV} from service_lines where strpos(line, '=') > 1) s where k = 'Result' group by all),
t as (select host, case when "Id" = '' then unit else "Id" end as unit, coalesce(({_f('"Triggers"')})[1], '') as activates,
    coalesce({_usec('"NextElapseUSecRealtime"')}, {_usec('"NextElapseUSecMonotonic"')}) as next_run, {_usec('"LastTriggerUSec"')} as last_run,
    "Result" as result, "ActiveState" as active_state from w),
tt as (select t.host, t.unit, t.activates, next_run, last_run, case when result = '' and t.activates <> '' then coalesce(res, '') else result end as last_result, active_state
  from t left join sr on sr.host = t.host and sr.activates = t.activates)"""


def _timers(spark, sf_dir):
    return timers.inventory(_lines(spark, sf_dir, "timer_lines"), _lines(spark, sf_dir, "service_lines"))


@query("timers_inventory", oracle(f"with {_TIMERS} select * from tt", "timer_lines", "service_lines"))
def timers_inventory(spark, sf_dir):
    return _timers(spark, sf_dir)


@query("timer_status", oracle(f"""
with {_TIMERS} select host, unit, case when last_result not in ('', 'success') then 'failed'
  when last_run is null and next_run is not null then 'warning' when last_run < timestamp '2024-07-20' - interval '30' day then 'warning' else 'ok' end as status
from tt""", "timer_lines", "service_lines"))
def timer_status(spark, sf_dir):
    as_of = datetime.datetime(2024, 7, 20)
    return _timers(spark, sf_dir).select("host", "unit", timers.status(as_of).alias("status"))


# --- crons --------------------------------------------------------------------------

_CRONS = f"""jobs as (
  select host, source, line_no, sched as schedule, usr as "user", cmd as command from (
    select host, source, line_no,
      case when macro and system_format and len(f) >= 3 then f[1] when macro and not system_format and rest <> '' then split_part(t, ' ', 1)
        when not macro and len(f) >= (case when system_format then 7 else 6 end) then array_to_string(f[1:5], ' ') end as sched,
      case when not system_format then '' when macro then coalesce(f[2], '') else coalesce(f[6], '') end as usr,
      case when macro then case when system_format then array_to_string(f[3:], ' ') else rest end
        when system_format then array_to_string(f[7:], ' ') else array_to_string(f[6:], ' ') end as cmd
    from (select *, trim(line) as t, starts_with(trim(line), '@') as macro, {_f('trim(line)')} as f, trim(regexp_extract(trim(line), '^[^ ]* (.*)$', 1)) as rest from cron_lines) a
    where not (starts_with(source, '/etc/cron.d/') and regexp_matches(source, '(~|\\.dpkg-old|\\.dpkg-dist|\\.rpmsave|\\.rpmnew)$'))
      and t <> '' and not starts_with(t, '#') and not regexp_matches(t, '^[^= \\t]+=')) b where sched is not null)"""


def _crons(spark, sf_dir):
    return crons.parse(_lines(spark, sf_dir, "cron_lines"))


@query("crons_inventory", oracle(f"with {_CRONS} select * from jobs", "cron_lines"))
def crons_inventory(spark, sf_dir):
    return _crons(spark, sf_dir)


_LOGINS = """logins as (select host, p[1] as name from (select host, string_split(trim(line), ':') as p from passwd
  where trim(line) <> '' and not starts_with(trim(line), '#')) a where len(p) >= 7 and p[1] <> ''
  and not regexp_matches(p[7], '(nologin|false|sync|shutdown|halt)$'))"""


@query("user_crons_login_only", oracle(f"""
with {_CRONS}, {_LOGINS} select * from jobs j where exists (select 1 from logins l where l.host = j.host and j.source = 'user:' || l.name)""",
    "cron_lines", "passwd"))
def user_crons_login_only(spark, sf_dir):
    return crons.of_login_users(_crons(spark, sf_dir), _lines(spark, sf_dir, "passwd"))


_CRON_STATUS = r"""case when not regexp_matches(schedule, '^(@[a-z]+|[0-9A-Za-z*/,-]+( [0-9A-Za-z*/,-]+){4})$') then 'failed'
  when regexp_matches(command, '(curl|wget)\b[^|]*\|\s*(ba|z|da)?sh\b') or schedule = '* * * * *'
    or regexp_matches(command, '(>|tee )\s*/(etc|boot|usr|bin|sbin)/') then 'warning' else 'ok' end"""


@query("cron_status", oracle(f"with {_CRONS} select host, source, line_no, {_CRON_STATUS} as status from jobs", "cron_lines"))
def cron_status(spark, sf_dir):
    return _crons(spark, sf_dir).select("host", "source", "line_no", crons.status().alias("status"))


@query("cron_status_counts", oracle(
    f"with {_CRONS} select host, {_CRON_STATUS} as status, count(*) as n from jobs group by all", "cron_lines"))
def cron_status_counts(spark, sf_dir):
    return crons.status_counts(_crons(spark, sf_dir))


# --- updates ------------------------------------------------------------------------

def _reboot(p: str) -> str:
    p = f"lower({p})"
    tests = [f"starts_with({p}, '{s}')" for s in updates.REBOOT_PREFIXES] + [f"contains({p}, '{s}')" for s in updates.REBOOT_PARTS]
    return f"({p} in {_in(updates.REBOOT_NAMES)} or {' or '.join(tests)})"


_UPDATES = f"""up as (
  select host, manager, line_no, split_part(f[1], '/', 1) as package,
    trim(regexp_extract(array_to_string(f[3:], ' '), 'upgradable from:.([^\\]]*)\\]', 1)) as installed, f[2] as available,
    contains(t, 'security') or contains(t, '~deb') as security, {_reboot("split_part(f[1], '/', 1)")} as reboot
  from parsed where manager = 'apt' and len(f) >= 2 and not contains(t, 'Listing...')
  union all
  select host, manager, line_no, regexp_extract(f[1], '^(.*)\\.[^.]*$', 1), '', f[2], contains(lower(t), 'security'),
    {_reboot("regexp_extract(f[1], '^(.*)" + chr(92) + ".[^.]*$', 1)")}
  from parsed where manager = 'dnf' and len(f) = 3 and contains(f[1], '.')
  union all
  select host, manager, line_no, f[1], f[2], case when len(f) >= 4 and f[3] = '->' then rtrim(f[4], '-') else '' end, false, {_reboot('f[1]')}
  from parsed where manager = 'pacman' and len(f) >= 3
  union all
  select host, manager, line_no, t, '', '', false, false from parsed where manager = 'apk' and t <> '')"""
_PARSED = f"parsed as (select *, trim(line) as t, {_f('trim(line)')} as f from update_lines)"
_WITH_RPM = f"""rpm as (select host, f[1] as package, arg_max(f[2], line_no) as version from (select *, {_f()} as f from rpm_lines) a where len(f) = 2 group by all),
ui as (select u.host, u.manager, u.line_no, u.package, case when u.manager = 'dnf' then coalesce(r.version, '') else u.installed end as installed,
  u.available, u.security, u.reboot from up u left join rpm r on r.host = u.host and r.package = u.package)"""


def _updates(spark, sf_dir):
    return updates.parse(_lines(spark, sf_dir, "update_lines"))


def _with_rpm(spark, sf_dir):
    return updates.with_installed(_updates(spark, sf_dir), _lines(spark, sf_dir, "rpm_lines"))


@query("updates_inventory", oracle(f"with {_PARSED}, {_UPDATES} select * from up", "update_lines"))
def updates_inventory(spark, sf_dir):
    return _updates(spark, sf_dir)


@query("updates_installed", oracle(f"with {_PARSED}, {_UPDATES}, {_WITH_RPM} select * from ui", "update_lines", "rpm_lines"))
def updates_installed(spark, sf_dir):
    return _with_rpm(spark, sf_dir)


@query("updates_security_only", oracle(
    f"with {_PARSED}, {_UPDATES}, {_WITH_RPM} select * from ui where security", "update_lines", "rpm_lines"))
def updates_security_only(spark, sf_dir):
    return _with_rpm(spark, sf_dir).filter("security")


_LEAD = "try_cast(nullif(regexp_extract({c}, '^(?:\\d+:)?(\\d+)', 1), '') as bigint)"


@query("update_category_counts", oracle(f"""
with {_PARSED}, {_UPDATES}, {_WITH_RPM}, c as (select host, reboot, case when security then 'security'
  when {_LEAD.format(c='installed')} is null or {_LEAD.format(c='available')} is null then 'unknown'
  when {_LEAD.format(c='available')} > {_LEAD.format(c='installed')} then 'major' else 'minor' end as category from ui)
select host, {', '.join(f"count(*) filter (where category = '{c}') as {c}" for c in ('security', 'major', 'minor', 'unknown'))},
  count(*) filter (where reboot) as reboot from c group by host""", "update_lines", "rpm_lines"))
def update_category_counts(spark, sf_dir):
    return updates.category_counts(_with_rpm(spark, sf_dir))


@query("updates_digest", oracle(f"""
with {_PARSED}, {_UPDATES}, {_WITH_RPM}, hosts as (select distinct host from passwd union select 'quiet-host' as host),
n as (select *, row_number() over (partition by host order by line_no) as number from ui),
p as (select host, (number - 1) // 1000 as page, string_agg(number || '. ' || package || case when security then ' [SECURITY]' else '' end
    || case when reboot then ' [REBOOT]' else '' end || '  installed: ' || case when installed = '' then '(unknown)' else installed end
    || ' -> available: ' || available, chr(10) order by number) as digest from n group by all)
select hosts.host, coalesce(page, 0) as page, coalesce({trim('digest')}, '(no pending updates)') as digest from hosts left join p on p.host = hosts.host""",
    "update_lines", "rpm_lines", "passwd"))
def updates_digest(spark, sf_dir):
    all_hosts = _lines(spark, sf_dir, "passwd").select("host").union(spark.sql("select 'quiet-host' as host")).distinct()
    bucket = F.floor(F.col("line_no") / 4096)
    return digests.paged_digest(_with_rpm(spark, sf_dir), all_hosts, ["line_no"], bucket,
                                updates.digest_line(), "(no pending updates)")


# --- processes ----------------------------------------------------------------------

def _pkey(key: str) -> str:
    return f"coalesce(arg_max(case when k = '{key}' then v end, case when k = '{key}' then line_no end), '')"


@query("process_facts", oracle(f"""
select host, pid, {_pkey('Name')} as name, {_pkey('State')} as state, {_pkey('VmRSS')} as rss, {_pkey('Threads')} as threads,
  coalesce(({_f(_pkey('Uid'))})[1], '') as uid
from (select host, pid, line_no, split_part(line, ':', 1) as k, {trim("substr(line, strpos(line, ':') + 1)")} as v
  from proc_status where contains(line, ':')) kv where k in {_in(process.STATUS_KEYS)} group by host, pid""", "proc_status"))
def process_facts(spark, sf_dir):
    return process.facts(_lines(spark, sf_dir, "proc_status"))


@query("process_fds", oracle("""
select host, pid, case when starts_with(target, 'socket:[') then 'socket (anonymous)' when starts_with(target, 'pipe:[') then 'pipe (anonymous)'
  else target end as label, min(fd) as first_fd from proc_fds group by all""", "proc_fds"))
def process_fds(spark, sf_dir):
    return process.open_files(_lines(spark, sf_dir, "proc_fds"))


def _address(c: str) -> str:
    a, port = f"split_part({c}, ':', 1)", f"cast('0x' || split_part({c}, ':', 2) as bigint) % 65536"
    byte = lambda i: f"cast('0x' || substr({a}, {i}, 2) as integer)"
    v6 = " || ':' || ".join(
        f"lower(substr({a}, {w + 6}, 2) || substr({a}, {w + 4}, 2)) || ':' || lower(substr({a}, {w + 2}, 2) || substr({a}, {w}, 2))"
        for w in (1, 9, 17, 25))
    return (f"case when regexp_matches({c}, '^[0-9A-Fa-f]{{8}}:') then {byte(7)} || '.' || {byte(5)} || '.' || {byte(3)} || '.' || {byte(1)} || ':' || {port} "
            f"when regexp_matches({c}, '^[0-9A-Fa-f]{{32}}:') then '[' || {v6} || ']:' || {port} else {c} end")


_STATE = "case upper(f[4]) " + " ".join(f"when '{k}' then '{v}'" for k, v in process.TCP_STATES.items()) + " else 'state-' || f[4] end"
_TCP = f"""s as (select host, pid, line_no, state, local, case when remote in ('0.0.0.0:0', '[::]:0') then '' else remote end as remote from (
  select host, pid, line_no, {_STATE} as state, {_address('f[2]')} as local, {_address('f[3]')} as remote
  from (select *, {_f('trim(line)')} as f from proc_tcp) a where len(f) >= 4) b)"""


@query("tcp_sockets", oracle(f"""
with {_TCP} select *, 'tcp  ' || state || '  local=' || local || case when remote <> '' then '  remote=' || remote else '' end as summary from s""", "proc_tcp"))
def tcp_sockets(spark, sf_dir):
    return process.tcp_sockets(_lines(spark, sf_dir, "proc_tcp"))


@query("tcp_state_counts", oracle(f"with {_TCP} select host, state, count(*) as n from s group by all", "proc_tcp"))
def tcp_state_counts(spark, sf_dir):
    return process.tcp_state_counts(process.tcp_sockets(_lines(spark, sf_dir, "proc_tcp")))


@query("top_processes", oracle(f"""
select host, pid, cast(cpu as varchar) as cpu, command, cast(rn as integer) as rank from (
  select *, row_number() over (partition by host order by cpu desc, pid) as rn from (
    select host, pid, cast(f[3] as decimal(10, 1)) as cpu, array_to_string(f[11:], ' ') as command from (select *, {_f()} as f from ps) a where len(f) >= 11) b) c
where rn <= 15""", "ps"))
def top_processes(spark, sf_dir):
    return process.top_processes(_lines(spark, sf_dir, "ps")).withColumn("cpu", F.col("cpu").cast("string"))


# --- hosts --------------------------------------------------------------------------

def _okey(key: str) -> str:
    return f"coalesce(arg_max(case when k = '{key}' then v end, case when k = '{key}' then line_no end), '')"


_ENV = f"""env as (select host, {_okey('ID')} as distro_id, {_okey('ID_LIKE')} as distro_like, {_okey('VERSION_ID')} as distro_version,
  {_okey('PRETTY_NAME')} as pretty_name from (select host, line_no, k, case when len(v) >= 2 and ((v like '"%"') or (v like '''%''')) then substr(v, 2, len(v) - 2) else v end as v
    from (select host, line_no, split_part(trim(line), '=', 1) as k, trim(substr(trim(line), strpos(trim(line), '=') + 1)) as v from os_release
      where not starts_with(trim(line), '#') and strpos(trim(line), '=') > 1) a) kv where k in {_in(hosts.OS_KEYS)} group by host)"""


@query("host_env", oracle(f"with {_ENV} select * from env", "os_release"))
def host_env(spark, sf_dir):
    return hosts.environment(_lines(spark, sf_dir, "os_release"))


_MGR = ", ".join(f"('{i}', '{m}')" for m, ids in hosts.PACKAGE_MANAGERS.items() for i in ids)


@query("host_pkg_manager", oracle(f"""
with {_ENV}, known(id, mgr) as (values {_MGR}), w as (select host, distro_id, unnest(list_concat([distro_id], {_f('distro_like')})) as word,
    unnest(range(1 + len({_f('distro_like')}))) as pos from env)
select w.host, distro_id, coalesce(arg_min(mgr, pos), '') as package_manager from w left join known on known.id = word group by w.host, distro_id""", "os_release"))
def host_pkg_manager(spark, sf_dir):
    env = hosts.environment(_lines(spark, sf_dir, "os_release"))
    return env.select("host", "distro_id", hosts.package_manager(
        F.col("distro_id"), F.col("distro_like")).alias("package_manager"))


def _unit(c: str) -> str:
    for u in "GMK":
        c = f"regexp_replace({c}, '(\\d){u}i\\b', '\\1{u}', 'g')"
    return f"regexp_replace({c}, '(\\d+)\\.0([GMK])', '\\1\\2', 'g')"


@query("host_memory", oracle(f"""
select host, coalesce(max(case when f[1] = 'Mem:' and len(f) >= 7 then {_unit('f[3]')} || ' / ' || {_unit('f[2]')} || '  (' || {_unit('f[7]')} || ' free)' end), '(none)') as memory,
  coalesce(max(case when f[1] = 'Swap:' and len(f) >= 3 then case when f[3] in ('0B', '0') then 'inactive' else {_unit('f[3]')} || ' / ' || {_unit('f[2]')} end end), '') as swap
from (select *, {_f()} as f from host_text where kind = 'free') a group by host""", "host_text"))
def host_memory(spark, sf_dir):
    return hosts.memory(view(spark, sf_dir, "host_text").filter("kind = 'free'"))


@query("host_disks", oracle(f"""
select host, device, size, used, use_percent, mountpoint from (
  select host, f[1] as device, {_unit('f[2]')} as size, {_unit('f[3]')} as used, f[5] as use_percent, f[6] as mountpoint,
    row_number() over (partition by host, f[1] order by line_no) as rn
  from (select *, {_f()} as f from host_text where kind = 'df') a where len(f) >= 6 and starts_with(f[1], '/dev/')) b where rn = 1""", "host_text"))
def host_disks(spark, sf_dir):
    return hosts.disks(view(spark, sf_dir, "host_text").filter("kind = 'df'"))


@query("host_uptime", oracle(
    r"select host, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^up ', ''), '(\d+)\s+days?', '\1d', 'g'), "
    r"'(\d+)\s+hours?', '\1h', 'g'), '(\d+)\s+minutes?', '\1m', 'g'), ',', '') as uptime from host_text where kind = 'uptime'", "host_text"))
def host_uptime(spark, sf_dir):
    return view(spark, sf_dir, "host_text").filter("kind = 'uptime'").select(
        "host", hosts.uptime(F.col("line")).alias("uptime"))


@query("host_insights", oracle("""
select h.host, coalesce(n, 0) as failed_services, e.host is not null as recent_errors from (select distinct host from host_text) h
left join (select host, count(*) as n from host_text where kind = 'failed' group by host) f on f.host = h.host
left join (select distinct host from host_text where kind = 'errors') e on e.host = h.host""", "host_text"))
def host_insights(spark, sf_dir):
    rows = view(spark, sf_dir, "host_text")
    return hosts.insights(rows.select("host").distinct(), rows.filter("kind = 'failed'"), rows.filter("kind = 'errors'"))


# --- digests ------------------------------------------------------------------------

@query("crons_digest", oracle(f"""
with {_CRONS}, hosts as (select distinct host from cron_lines),
n as (select *, row_number() over (partition by host order by line_no) as number from jobs),
p as (select host, (number - 1) // 1000 as page, string_agg('source:   ' || source || chr(10) || 'schedule: ' || schedule
    || case when "user" <> '' then chr(10) || 'user:     ' || "user" else '' end || chr(10) || 'command:  ' || command || chr(10), chr(10) order by number) as digest from n group by all)
select hosts.host, coalesce(page, 0) as page, coalesce({trim('digest')}, '(no cron jobs found)') as digest from hosts left join p on p.host = hosts.host""", "cron_lines"))
def crons_digest(spark, sf_dir):
    all_hosts = view(spark, sf_dir, "cron_lines").select("host").distinct()
    return digests.paged_digest(_crons(spark, sf_dir), all_hosts, ["line_no"], F.floor(F.col("line_no") / 4096),
                                crons.digest_line(), "(no cron jobs found)")


@query("timers_digest", oracle(f"""
with {_TIMERS}, n as (select *, row_number() over (partition by host order by unit) as number from tt),
shown as (select *, coalesce(strftime(last_run, '%Y-%m-%d %H:%M:%S UTC'), 'never') as l, coalesce(strftime(next_run, '%Y-%m-%d %H:%M:%S UTC'), 'never') as x from n)
select host, (number - 1) // 1000 as page, {trim("""string_agg('unit:         ' || unit || chr(10) || 'activates:    ' || case when activates = '' then '(unknown)' else activates end
    || chr(10) || 'active_state: ' || active_state || chr(10) || 'last_run:     ' || l || chr(10) || 'next_run:     ' || x
    || case when last_result <> '' then chr(10) || 'last_result:  ' || last_result else '' end || chr(10), chr(10) order by number)""")} as digest
from shown group by host, page""", "timer_lines", "service_lines"))
def timers_digest(spark, sf_dir):
    all_hosts = view(spark, sf_dir, "timer_lines").select("host").distinct()
    return digests.paged_digest(_timers(spark, sf_dir), all_hosts, ["unit"], F.substring("unit", 1, 3),
                                timers.digest_line(), "(no systemd timers found)")


@query("mounts_digest", oracle(f"""
with {_MOUNTS.replace("mnt as (select host,", "mnt as (select line_no, host,")}, {_USAGE},
n as (select *, row_number() over (partition by host order by line_no) as number from mp where not {_PSEUDO}),
t as (select host, number, 'device:      ' || device || chr(10) || 'mountpoint:  ' || mountpoint || chr(10) || 'fstype:      ' || fstype || chr(10) || 'options:     ' || options
  || case when size <> '' then chr(10) || 'size:        ' || size || chr(10) || 'used:        ' || used || '  (' || use_percent || ')' || chr(10) || 'available:   ' || avail else '' end
  || case when {_NFS} then case when stale then chr(10) || 'nfs_status:  STALE' else chr(10) || 'nfs_status:  responsive' end else '' end || chr(10) as line from n),
p as (select host, (number - 1) // 1000 as page, {trim("string_agg(line, chr(10) order by number)")} as digest from t group by all)
select h.host, coalesce(page, 0) as page, coalesce(digest, '(no mount entries found)') as digest from (select distinct host from mounts) h left join p on p.host = h.host""",
    "mounts", "df_lines", "nfs_probes"))
def mounts_digest(spark, sf_dir):
    all_hosts = view(spark, sf_dir, "mounts").select("host").distinct()
    table = mounts.mount_table(view(spark, sf_dir, "mounts"), keep_line_no=True)
    rows = _probed(spark, sf_dir, table).filter(~mounts.is_pseudo(F.col("fstype")))
    return digests.paged_digest(rows, all_hosts, ["line_no"], F.floor(F.col("line_no") / 4096),
                                mounts.digest_line(), "(no mount entries found)")


@query("fw_digest", oracle(f"""
with {_RULES}, n as (select *, row_number() over (partition by host order by line_no, item) as number from rules),
t as (select host, number, '  rule_' || number || ':' || chr(10) || array_to_string(list_filter([case when chain <> '' then '    chain:    ' || chain end,
    case when action <> '' then '    action:   ' || action end, case when protocol <> '' then '    protocol: ' || protocol end,
    case when port <> '' then '    port:     ' || port end, case when source <> '' then '    source:   ' || source end,
    case when comment <> '' then '    comment:  ' || comment end], lambda x: x is not null), chr(10)) as line from n),
p as (select host, (number - 1) // 1000 as page, {trim("string_agg(line, chr(10) order by number)")} as digest from t group by all)
select r.host, coalesce(page, 0) as page, coalesce(digest, 'rules: (none collected)') as digest from fw_reads r left join p on p.host = r.host""",
    "fw_lines", "fw_reads"))
def fw_digest(spark, sf_dir):
    all_hosts = view(spark, sf_dir, "fw_reads").select("host")
    return digests.paged_digest(_rules(spark, sf_dir), all_hosts, ["line_no", "item"], F.floor(F.col("line_no") / 4096),
                                firewall.digest_line(), "rules: (none collected)")


@query("process_digest", oracle(f"""
with {_TCP}, h as (select distinct host from proc_tcp),
n as (select host, pid, line_no, 'pid ' || pid || '  tcp  ' || state || '  local=' || local || case when remote <> '' then '  remote=' || remote else '' end as line,
  row_number() over (partition by host order by pid, line_no) as number from s)
select host, (number - 1) // 1000 as page, {trim("string_agg(line, chr(10) order by number)")} as digest from n group by host, page""", "proc_tcp"))
def process_digest(spark, sf_dir):
    lines = _lines(spark, sf_dir, "proc_tcp")
    rows = process.tcp_sockets(lines)
    return digests.paged_digest(
        rows, lines.select("host").distinct(), ["pid", "line_no"], F.col("pid"),
        F.concat(F.lit("pid "), F.col("pid").cast("string"), F.lit("  "), "summary"), "(none visible)")
