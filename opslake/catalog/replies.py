"""Model-reply quality queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from opslake.catalog.base import query
from opslake.catalog.duck import trim
from opslake.catalog.fixtures import oracle, spread_view, view
from opslake.functions import json_reply as jr
from opslake.operators import replies
from opslake.plans.partitioning import spread


def _rows(spark, sf_dir):
    return spread_view(spark, sf_dir, "replies", "orders", ["o_orderkey"], replies.TASK_ROWS)


@query("reply_json_object", oracle(
    # class 13 holds a second object, {"x":1}, after the first
    "select id, case when id % 16 = 13 then left(raw, length(raw) - 7) when json_valid(raw) and trim(raw, ' ' || chr(9) || chr(10) || chr(13)) like '{%' "
    "then trim(raw, ' ' || chr(9) || chr(10) || chr(13)) "
    r"when json_valid(regexp_extract(raw, '\{(?s:.*)\}')) then regexp_extract(raw, '\{(?s:.*)\}') end as object from replies",
    "replies"))
def reply_json_object(spark, sf_dir):
    return _rows(spark, sf_dir).select("id", jr.json_object(F.col("raw")).alias("object"))


@query("reply_empty", oracle(
    r"select id, regexp_replace(raw, '[ \t\n\r]', '', 'g') in ('', '{}', 'null', '[]') as empty from replies", "replies"))
def reply_empty(spark, sf_dir):
    return view(spark, sf_dir, "replies").select("id", jr.essentially_empty(F.col("raw")).alias("empty"))


def _canon(value: str, allowed: str) -> str:
    t = trim(value)
    return (f"case when {t} = '' then {value} else coalesce(list_filter({allowed}, lambda a: a = {t})[1], "
            f"list_filter({allowed}, lambda a: lower(a) = lower({t}))[1], "
            f"list_filter({allowed}, lambda a: starts_with(lower(a), lower({t})) or starts_with(lower({t}), lower(a)))[1], {value}) end")


_ALLOWED = "['critical', 'warning', 'info']"


@query("enum_canonical", oracle(f"""
select id, value, {_canon('value', _ALLOWED)} as canonical from (
  select id, case id % 9 when 0 then 'warning' when 1 then 'Warning' when 2 then 'WARNING' when 3 then '  warning  '
    when 4 then 'warn' when 5 then 'crit' when 6 then 'informational' when 7 then 'error' else '' end as value from replies) v""", "replies"))
def enum_canonical(spark, sf_dir):
    rows = view(spark, sf_dir, "replies").selectExpr("id", """
      case id % 9 when 0 then 'warning' when 1 then 'Warning' when 2 then 'WARNING' when 3 then '  warning  '
        when 4 then 'warn' when 5 then 'crit' when 6 then 'informational' when 7 then 'error' else '' end as value""")
    return rows.select("id", "value", jr.canonical(F.col("value"), ["critical", "warning", "info"]).alias("canonical"))


# The derived replies hold text and number values only, so the check normalises those.
def _norm_text(path: str, src: str = "e") -> str:
    return trim(f"json_extract_string({src}, '$.{path}')")


def _sev() -> str:
    v = _norm_text("severity")
    return (f"case command when 'audit' then {_canon(v, _ALLOWED)} when 'ports' then {_canon(v, chr(91) + chr(39) + 'warning' + chr(39) + ', ' + chr(39) + 'info' + chr(39) + chr(93))} else {v} end")


def _norm_elem(command: str) -> str:
    names = sorted({"audit": ["severity", "category", "title", "detail"],
                    "ports": ["severity", "port", "title", "detail"],
                    "mounts": ["severity", "mount_point", "title", "detail"],
                    "firewall": ["severity", "rule", "port", "title", "detail"]}[command])
    pairs = ", ".join(f"'{n}', " + (_sev() if n == "severity" else _norm_text(n)) for n in names)
    return f"json_merge_patch('{{}}', json_object({pairs}))"


_ELEMS = "case command " + " ".join(
    f"when '{c}' then list_transform(json_extract(j, '$.findings[*]'), lambda e: {_norm_elem(c)})"
    for c in ("audit", "ports", "mounts", "firewall")) + " end"
# of a repeated key the last one counts
_LAST = """replace(raw, '"summary":"old",', '')"""
_PARSED = f"p as (select id, command, raw, case when json_valid(raw) then {_LAST} end as j from replies)"
_NORMAL = f"""{_PARSED}, n as (select id, command, raw, j, case when j is null then raw when json_type(j) = 'OBJECT' and json_extract(j, '$.summary') is not null
    then json_object('findings', to_json({_ELEMS}), 'summary', {_norm_text('summary', 'j')})::varchar
    when json_type(j) = 'OBJECT' then '{{}}' when json_type(j) = 'ARRAY' then '[]' else 'null' end as normalised from p)"""


@query("reply_normalised", oracle(f"with {_NORMAL} select id, command, normalised from n", "replies"))
def reply_normalised(spark, sf_dir):
    return _rows(spark, sf_dir).select(
        "id", "command", jr.normalise(F.col("command"), F.col("raw")).alias("normalised"))


def _errors_of(fields: list[str], src: str, prefix: str) -> str:
    parts = []
    for f in fields:
        path = f"{prefix} || '{f}'"
        kind = f"json_type({src}, '$.{f}')"
        parts.append(
            f"case when {kind} is null then 'field \"' || {path} || '\" is missing' "
            f"when {kind} = 'NULL' then 'field \"' || {path} || '\" cannot be null' "
            f"when {kind} <> 'VARCHAR' then 'field \"' || {path} || '\": expected string, got ' || "
            f"case {kind} when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'BOOLEAN' then 'bool' else 'number' end end")
    return f"list_filter([{', '.join(parts)}], lambda m: m is not null)"


_FIELDS = {c: jr.SCHEMAS[c]["findings"] for c in ("audit", "ports", "mounts", "firewall")}


def _structural(col: str) -> str:
    elem = "case command " + " ".join(
        f"when '{c}' then {_errors_of(fs, 'e', chr(39) + 'findings[' + chr(39) + ' || (i - 1) || ' + chr(39) + '].' + chr(39))}"
        for c, fs in _FIELDS.items()) + " end"
    listed = f"json_extract({col}, '$.findings[*]')"
    return f"""case when not json_valid({col}) then ['JSON syntax error']
      when json_type({col}) not in ('OBJECT', 'NULL') then ['top-level must be a JSON object']
      else list_concat({_errors_of(['summary'], col, "''")},
        case when json_type({col}, '$.findings') is null then ['field "findings" is missing']
          else flatten(list_transform({listed}, lambda e, i: {elem})) end) end"""


@query("reply_structural_errors", oracle(
    f"select id, command, array_to_string({_structural('raw')}, '; ') as errors from replies", "replies"))
def reply_structural_errors(spark, sf_dir):
    rows = replies.validated(_rows(spark, sf_dir))
    return rows.select("id", "command", F.array_join("structural", "; ").alias("errors"))


def _semantic(col: str) -> str:
    def text(name: str) -> str:
        return trim(f"coalesce(json_extract_string(e, '$.{name}'), '')")

    def filled(*names: str) -> list[str]:
        return [f"case when {text(n)} = '' then '{n} must not be empty' end" for n in names]

    def sev(allowed: str, say: str) -> str:
        return (f"case when {text('severity')} = '' then 'severity must not be empty' when {text('severity')} not in ({allowed}) "
                f"then 'severity must be {say}, got \"' || {text('severity')} || '\"' end")
    three = "'critical', 'warning', 'info'"
    checks = {
        "ports": [sev("'warning', 'info'", "''warning'' or ''info''"), *filled("port", "title", "detail")],
        "mounts": [sev(three, "''critical'', ''warning'', or ''info''"), *filled("mount_point", "title", "detail")],
        "firewall": [f"case when {text('severity')} not in ({three}) then 'severity must be critical, warning, or info, got \"' || "
                     "json_extract_string(e, '$.severity') || '\"' end", *filled("title", "detail")],
    }
    elem = "case command " + " ".join(
        f"when '{c}' then list_transform(list_filter([{', '.join(cs)}], lambda m: m is not null), "
        f"lambda m: 'findings[' || (i - 1) || '].' || m)" for c, cs in checks.items()) + " end"
    return f"""case when command = 'audit' then []
      else list_concat(case when {trim(f"json_extract_string({col}, '$.summary')")} = '' then ['summary must not be empty'] else [] end,
        flatten(list_transform(json_extract({col}, '$.findings[*]'), lambda e, i: {elem}))) end"""


_CHECKED = f"c as (select *, {_structural('raw')} as st from replies), v as (select *, case when len(st) = 0 then {_semantic('raw')} else [] end as se from c)"


@query("reply_semantic_errors", oracle(
    f"with {_CHECKED} select id, command, array_to_string(se, '; ') as errors from v where len(st) = 0", "replies"))
def reply_semantic_errors(spark, sf_dir):
    rows = replies.validated(_rows(spark, sf_dir)).filter(F.size("structural") == 0)
    return rows.select("id", "command", F.array_join("semantic", "; ").alias("errors"))


# A derived element is dropped when its title is missing, or its severity word stays unknown.
_SOUND = """json_extract(e, '$.title') is not null and
  (command = 'audit' or json_extract_string(e, '$.severity') in ('warning', 'info')
   or (command in ('mounts', 'firewall') and json_extract_string(e, '$.severity') = 'critical'))"""
# What is complete of each class of noisy or cut-off text, by how the class is made.
_COMPLETE = rf"""case when json_valid(raw) then {_LAST} when id % 16 = 13 then left(raw, length(raw) - 7)
  when id % 32 = 10 then regexp_extract(raw, '^\{{"summary":"[^"]*"') || ',"findings":[]}}'
  when id % 16 = 10 then regexp_extract(raw, '^(.*\}}),\{{', 1) || ']}}'
  when raw like '%{{%' then nullif(regexp_extract(raw, '\{{(?s:.*)\}}'), '') end"""
_NORMAL_COMPLETE = _NORMAL.replace(f"case when json_valid(raw) then {_LAST} end as j", _COMPLETE + " as j", 1)
_SALVAGED = f"""{_NORMAL_COMPLETE}, s as (select id, command, json_type(j) = 'OBJECT' as object,
  case when json_extract(j, '$.summary') is not null then {_ELEMS} else [] end as es, {_norm_text('summary', 'j')} as summary from n)
, k as (select *, list_filter(es, lambda e: {_SOUND}) as kept from s)"""


@query("reply_salvaged", oracle(f"""
with {_SALVAGED} select id, command, json_merge_patch('{{}}', json_object('findings', to_json(kept), 'summary', summary))::varchar as reply
from k where object""", "replies"))
def reply_salvaged(spark, sf_dir):
    return replies.salvaged(_rows(spark, sf_dir)).select("id", "command", "reply")


@query("reply_dropped", oracle(f"""
with {_SALVAGED} select command, count(*) as replies, count(*) filter (where len(es) > len(kept)) as incomplete,
  cast(sum(len(es) - len(kept)) as bigint) as dropped from k where object group by command""", "replies"))
def reply_dropped(spark, sf_dir):
    return replies.salvaged(_rows(spark, sf_dir)).groupBy("command").agg(
        F.count(F.lit(1)).alias("replies"), F.count_if(F.col("dropped") > 0).alias("incomplete"),
        F.sum("dropped").alias("dropped"))


_ROUTE = r"""case when len(st) = 0 and len(se) = 0 then 'valid' when len(st) = 0 then 'semantic'
  when regexp_replace(raw, '[ \t\n\r]', '', 'g') in ('', '{}', 'null', '[]') then 'structural_with_context' else 'structural' end"""


def _request_sql() -> str:
    schema = "case command " + " ".join(
        f"when '{c}' then '{replies.schema_text(c)}'" for c in ("audit", "ports", "mounts", "firewall")) + " end"
    errs = lambda c: f"array_to_string(list_transform({c}, lambda m: '- ' || m), chr(10))"
    block = lambda t, b: f"chr(10) || '{t}:' || chr(10) || {b}"
    return f"""case route
      when 'semantic' then 'Answer the task again and meet every requirement.' || {block('REQUIREMENTS', errs('se'))}
        || {block('SCHEMA', schema)} || {block('TASK', 'command')}
      when 'structural' then 'Correct this JSON to match the schema; change only what the errors name.' || {block('SCHEMA', schema)}
        || {block('JSON', 'raw')} || {block('ERRORS', errs('st'))}
      else 'The last answer had no usable content. Do the task and answer in the schema.' || {block('SCHEMA', schema)}
        || {block('ANSWER', 'raw')} || {block('ERRORS', errs('st'))} || {block('TASK', 'command')} end"""


@query("repair_queue", oracle(f"""
with {_CHECKED}, r as (select *, {_ROUTE} as route from v)
select id, command, route, {_request_sql()} as request from r where route <> 'valid'""", "replies"))
def repair_queue(spark, sf_dir):
    return replies.repair_queue(_rows(spark, sf_dir)).select("id", "command", "route", "request")


@query("reply_quality_cube", oracle(f"""
with {_CHECKED}, r as (select command, {_ROUTE} as outcome from v),
q as (select coalesce(command, '(all)') as command, coalesce(outcome, '(all)') as outcome, count(*) as n from r group by cube (command, outcome))
select q.command, q.outcome, q.n, cast(floor(q.n * 10000 / t.n) as bigint) as per_10k
from q join q t on q.command = t.command and t.outcome = '(all)'""", "replies"))
def reply_quality_cube(spark, sf_dir):
    rows = replies.validated(_rows(spark, sf_dir)).withColumn("outcome", replies.route())
    return replies.quality_cube(rows)


def stand_in_responder(frames):
    """Deterministic answers: a third right at once, a third on the second try, a third never.

    Wrong answers are empty objects, other words, or an entry whose title is null; a right
    document comes with fewer findings than it had, and in another order.
    """
    def entry(r):
        if r.id % 3 == 2:
            return ("{}", "still working on it", "[]")[r.attempt - 1]
        right = r.id % 3 == 0 or r.attempt > 1
        one = json.loads(r.current) | {"severity": " info ", "title": "fixed" if right else None}
        return json.dumps({r.list: [one]} if r.id % 2 else one)

    def document(r):
        if r.id % 3 == 2:
            return "{}" if r.attempt == 2 else "still working on it"
        if r.id % 3 == 1 and r.attempt < 2:
            return "{}"
        try:
            findings = json.loads(r.current)["findings"][:0:-1]
        except (ValueError, TypeError, KeyError):
            findings = []
        return json.dumps({"findings": findings, "summary": f"fixed {r.id}"})

    for pdf in frames:
        yield pdf.assign(current=[entry(r) if r.list else document(r) for r in pdf.itertuples()])


_START = r"case when json_valid(raw) then raw when id % 16 = 13 then left(raw, length(raw) - 7) when json_valid(regexp_extract(raw, '\{(?s:.*)\}')) then regexp_extract(raw, '\{(?s:.*)\}') else raw end"
# What the stand-in makes of an unsound entry: its other fields stay, keys are sorted.
_FIXED = """json_merge_patch(json_merge_patch(e, '{"severity":null,"title":null}'), '{"severity":"info","title":"fixed"}')"""
_ASKED = "case id % 3 when 0 then 1 when 1 then 2 else 3 end"


@query("repair_outcomes", oracle(f"""
with replies as (select id, command, {_START} as raw from replies_raw), {_NORMAL},
x as (select id, command, normalised as raw from n), c as (select *, {_structural('raw')} as st from x),
v as (select *, case when len(st) = 0 then {_semantic('raw')} else [] end as se from c),
apart as (with {_SALVAGED} select id, coalesce(object, false) as object, coalesce(es, []) as es, len(es) > len(kept) as unsound, summary from k),
told as (select v.*, object, es, coalesce(unsound, false) as unsound, summary, len(st) = 0 and len(se) = 0 as ok,
    summary is null or (command <> 'audit' and summary = '') as lacking
  from v join apart using (id)),
z as (select *, (case when unsound then {_ASKED} else 0 end) + (case when lacking then {_ASKED} else 0 end) as asked,
  list_filter(list_transform(es, lambda e: case when {_SOUND} then e when id % 3 <> 2 then {_FIXED} end), lambda e: e is not null) as whole from told)
select id, command, cast(case when ok then 0 else asked end as integer) as attempts,
  case when ok then 'valid' when asked = 0 then 'recovered' when id % 3 = 2 then 'incomplete' else 'repaired' end as status,
  case when ok then raw else '{{"findings":' || to_json(whole) || coalesce(',"summary":' || to_json(
    case when lacking and id % 3 <> 2 then 'fixed ' || id else summary end), '') || '}}' end as reply
from z""", "replies").replace("replies as (", "replies_raw as (", 1))
def repair_outcomes(spark, sf_dir):
    return replies.repair_outcomes(_rows(spark, sf_dir), stand_in_responder).select(
        "id", "command", "attempts", "status", "reply")


@query("schema_drift", oracle("""
with seen as (select command, unnest(json_keys(case when json_valid(raw) and json_type(raw) = 'OBJECT' then raw end)) as key from replies
    where json_valid(raw) union all select command, unnest(json_keys(case when json_valid(result) then result end)) from history)
select command, key, count(*) as n from seen
where (command, key) not in (values ('explain', 'issues'), ('why', 'summary'), ('why', 'chain'), ('why', 'next_steps'),
  ('doctor', 'issues'), ('doctor', 'actions'), ('doctor', 'summary'), ('status', 'overview'), ('status', 'anomalies'), ('status', 'summary'),
  ('audit', 'summary'), ('audit', 'findings'), ('ports', 'summary'), ('ports', 'findings'), ('mounts', 'summary'), ('mounts', 'findings'),
  ('firewall', 'summary'), ('firewall', 'findings'))
group by command, key
union all
select 'props' as command, key, count(*) as n from (select unnest(json_keys(props)) as key from events) p group by key""",
    "replies", "history"))
def schema_drift(spark, sf_dir):
    both = view(spark, sf_dir, "replies").select("command", F.col("raw").alias("text")).unionByName(
        view(spark, sf_dir, "history").select("command", F.col("result").alias("text")))
    props = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.lit("props").alias("command"), F.col("props").alias("text"))
    return replies.schema_drift(replies.observed_keys(both.unionByName(props), "command", "text"))


@query("findings_tally", oracle("""
select command, cast(sum(len(s)) as bigint) as findings, cast(sum(len(list_filter(s, lambda x: x = 'critical'))) as bigint) as critical,
  cast(sum(len(list_filter(s, lambda x: x = 'warning'))) as bigint) as warning,
  cast(sum(len(list_filter(s, lambda x: x not in ('critical', 'warning')))) as bigint) as info
from (select command, coalesce(json_extract_string(case when json_valid(raw) then raw end, '$.findings[*].severity'), []) as s from replies) r
group by command""", "replies"))
def findings_tally(spark, sf_dir):
    return replies.findings_tally(view(spark, sf_dir, "replies"))


# --- every command's schema ---------------------------------------------------------

def _got(kind: str) -> str:
    return f"case {kind} when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'bool' else 'number' end"


def _field_errors(src: str, name: str, want: str, prefix: str, inner: str = "[]") -> str:
    """The messages for one field; ``inner`` are those of a list's elements."""
    kind, path = f"json_type({src}, '$.{name}')", f"'field \"' || {prefix} || '{name}\"'"
    shown = {"VARCHAR": "string", "BOOLEAN": "bool", "ARRAY": "array"}[want]
    null = "[]" if want == "ARRAY" else f"[{path} || ' cannot be null']"
    return (f"case when {kind} is null then [{path} || ' is missing'] when {kind} = 'NULL' then {null} "
            f"when {kind} <> '{want}' then [{path} || ': expected {shown}, got ' || {_got(kind)}] else {inner} end")


def _leaf_kind(name: str) -> str:
    return "BOOLEAN" if name in jr.BOOL_FIELDS else "VARCHAR"


def _command_structural(command: str) -> str:
    parts = []
    for name, shape in jr.SCHEMAS[command].items():
        if shape == "string":
            parts.append(_field_errors("raw", name, "VARCHAR", "''"))
            continue
        at = f"'{name}[' || (i - 1) || ']'"
        if shape == "strings":
            each = (f"case when json_type(e) in ('VARCHAR', 'NULL') then [] else "
                    f"['field \"' || {at} || '\": expected string, got ' || {_got('json_type(e)')}] end")
        else:
            leaves = ", ".join(_field_errors("e", f, _leaf_kind(f), f"{at} || '.'") for f in shape)
            each = (f"case when json_type(e) in ('OBJECT', 'NULL') then flatten([{leaves}]) else [{at} || ': invalid object'] end")
        parts.append(_field_errors("raw", name, "ARRAY", "''", f"flatten(list_transform(json_extract(raw, '$.{name}[*]'), lambda e, i: {each}))"))
    return f"flatten([{', '.join(parts)}])"


def _check_sql(op: str, name: str, words: list[str], say: str) -> str:
    raw, allowed = f"coalesce(json_extract_string(e, '$.{name}'), '')", ", ".join(f"'{w}'" for w in words)
    text, say = trim(raw), (say or "").replace("'", "''")
    wrong = lambda shown: f"'{name} must be {say}, got \"' || {shown} || '\"'"
    return {
        "filled": f"case when {text} = '' then '{name} must not be empty{say}' end",
        "word": f"case when {text} = '' then '{name} must not be empty' when {text} not in ({allowed}) then {wrong(text)} end",
        "bare_word": f"case when {text} not in ({allowed}) then {wrong(raw)} end",
        "exact_word": f"case when {raw} not in ({allowed}) then {wrong(raw)} end",
        "filled_if_category": f"case when json_extract_string(e, '$.category') in ({allowed}) and {text} = '' then "
                              f"'{name} must not be empty when category is \"' || json_extract_string(e, '$.category') || '\"' end",
    }[op]


def _command_semantic(command: str) -> str:
    if command not in jr.ELEMENT_CHECKS:
        return "[]"
    parts = []
    for name, shape in jr.SCHEMAS[command].items():
        if shape == "string":
            if name == "summary":
                parts.append(f"case when {trim(_CS)} = '' then ['summary must not be empty'] else [] end")
            continue
        listed = f"coalesce(json_extract(raw, '$.{name}[*]'), [])"
        if name in jr.REQUIRED_ITEMS:
            parts.append(f"case when len({listed}) = 0 then ['{jr.REQUIRED_ITEMS[name]}'] else [] end")
        if shape != "strings":
            checks = ", ".join(_check_sql(*(*c, [], "")[:4]) if len(c) < 4 else _check_sql(*c) for c in jr.ELEMENT_CHECKS[command])
            parts.append(f"flatten(list_transform({listed}, lambda e, i: list_transform(list_filter([{checks}], lambda m: m is not null), "
                         f"lambda m: '{name}[' || (i - 1) || '].' || m)))")
    return f"flatten([{', '.join(parts)}])"


_CS = "json_extract_string(raw, '$.summary')"
_OF_COMMAND = lambda fn: "case command " + " ".join(f"when '{c}' then {fn(c)}" for c in jr.SCHEMAS) + " end"
_ALL_CHECKED = f"""c as (select *, case when not json_valid(raw) then ['JSON syntax error']
    when json_type(raw) <> 'OBJECT' then ['top-level must be a JSON object'] else {_OF_COMMAND(_command_structural)} end as st from command_replies)"""


@query("reply_errors_by_command", oracle(f"""
with {_ALL_CHECKED}
select id, command, array_to_string(st, '; ') as structural,
  array_to_string(case when len(st) = 0 then {_OF_COMMAND(_command_semantic)} else [] end, '; ') as semantic from c""", "command_replies"))
def reply_errors_by_command(spark, sf_dir):
    rows = replies.validated(spread(view(spark, sf_dir, "command_replies")))
    return rows.select("id", "command", F.array_join("structural", "; ").alias("structural"), F.array_join("semantic", "; ").alias("semantic"))
