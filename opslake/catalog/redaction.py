"""Redaction, classification and collapsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.catalog import duck
from opslake.catalog.base import query, table
from opslake.catalog.fixtures import oracle, view
from opslake.functions import redact
from opslake.functions.redact import VALUE_EDGE
from opslake.operators import redaction
from opslake.plans.partitioning import collapse_runs, spread


def _rule_on_journal(name: str, rule: str, column: str = "raw"):
    @query(name, oracle(f"select seq, {duck.rule(rule, column)} as masked from journal", "journal"))
    def run(spark, sf_dir):
        return view(spark, sf_dir, "journal").select(
            "seq", redact.BY_NAME[rule].apply(F.col(column)).alias("masked"))


def _rule_on_documents(name: str, rule: str):
    @query(name, oracle(f"select doc_id, {duck.rule(rule, 'text')} as masked from documents"))
    def run(spark, sf_dir):
        docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
        return docs.select("doc_id", redact.BY_NAME[rule].apply(F.col("text")).alias("masked"))


_rule_on_journal("san_timestamps", "strip-timestamps")
_rule_on_journal("san_mac", "mask-mac")
_rule_on_journal("san_repo", "normalise-repo")
_rule_on_journal("san_home", "mask-home")
_rule_on_journal("san_paths", "mask-paths")
_rule_on_journal("san_uuid", "mask-uuid")
_rule_on_journal("san_nvr", "normalise-package-nvr")
_rule_on_documents("san_emails", "mask-emails")
_rule_on_documents("san_ipv4", "mask-ipv4")
_rule_on_documents("san_hex", "mask-hex")


@query("san_hostnames", oracle(
    "select seq, " + duck.rule("strip-hostnames", duck.rule("strip-timestamps", "raw"))
    + " as masked from journal", "journal"))
def san_hostnames(spark, sf_dir):
    # the host is at the line start only once the time is gone
    rules = [redact.BY_NAME["strip-timestamps"], redact.BY_NAME["strip-hostnames"]]
    out = F.col("raw")
    for r in rules:
        out = r.apply(out)
    return view(spark, sf_dir, "journal").select("seq", out.alias("masked"))


@query("san_urls", oracle(f"""
select 'page' as kind, page_id as id, {duck.rule('mask-urls', "'see ' || url || ', ' || html")} as masked from pages
union all
select 'log' as kind, seq as id, {duck.rule('mask-urls', 'raw')} as masked from journal""", "journal"))
def san_urls(spark, sf_dir):
    rule = redact.BY_NAME["mask-urls"].apply
    text = F.concat(F.lit("see "), F.col("url"), F.lit(", "), F.col("html"))
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), rule(text).alias("masked"))
    logs = view(spark, sf_dir, "journal").select(
        F.lit("log").alias("kind"), F.col("seq").alias("id"), rule(F.col("raw")).alias("masked"))
    return pages.unionByName(logs)


@query("san_ipv6", oracle(
    f"select seq, {duck.mask_ipv6('message')} as masked from neighbours", "neighbours"))
def san_ipv6(spark, sf_dir):
    return view(spark, sf_dir, "neighbours").select(
        "seq", redact.BY_NAME["mask-ipv6"].apply(F.col("message")).alias("masked"))


@query("classify_lines", oracle(
    f"select seq, tagged, regexp_extract(tagged, '^<([A-Z]+)>', 1) as severity from "
    f"(select seq, {duck.classify_text('raw')} as tagged from journal)", "journal"))
def classify_lines(spark, sf_dir):
    logs = view(spark, sf_dir, "journal").select("seq", redact.classify_line(F.col("raw")).alias("tagged"))
    return logs.select("seq", "tagged", redact.severity(F.col("tagged")).alias("severity"))


@query("collapse_repeats", oracle("""
select doc_id, cast(min(pos) as bigint) as run_start, line, count(*) as run_length from (
  select doc_id, line, pos, sum(fresh) over (partition by doc_id order by pos) as run from (
    select *, case when lag(line) over (partition by doc_id order by pos) = line then 0 else 1 end as fresh
    from (select doc_id, unnest(string_split(text, chr(10))) as line,
            unnest(range(len(string_split(text, chr(10))))) as pos from documents) a) b) c
group by doc_id, run, line"""))
def collapse_repeats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    numbered = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return collapse_runs(
        numbered.withColumn("pos", F.col("pos").cast("bigint")), ["doc_id"], "pos", "line")


_MASKED = f"masked as (select doc_id, {duck.classify_text(duck.masked('text'))} as tagged from documents)"


@query("sanitise_corpus", oracle(f"""
with {_MASKED}, collapsed as ({duck.collapse('masked', 'doc_id', 'tagged', 'joined')})
select doc_id, lang, source, case when text = '' then '' else {duck.trim('joined')} end as sanitised
from documents join collapsed using (doc_id)"""))
def sanitise_corpus(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return redaction.sanitise_column(docs, "text", "sanitised").drop("text")


@query("sanitise_lines", oracle(
    f"select seq, host, service, {duck.sanitise_line('raw')} as sanitised from journal", "journal"))
def sanitise_lines(spark, sf_dir):
    logs = spread(view(spark, sf_dir, "journal").select("seq", "host", "service", "raw"))
    return logs.select("seq", "host", "service", redact.sanitise_line(F.col("raw")).alias("sanitised"))


_COUNTED = [
    ("email", duck.RULE_SQL["mask-emails"][0][0]),
    ("ipv4", duck.RULE_SQL["mask-ipv4"][0][0]),
    ("hex", duck.RULE_SQL["mask-hex"][1][0]),
    ("url", duck.RULE_SQL["mask-urls"][0][0]),
    ("mac", duck.RULE_SQL["mask-mac"][0][0]),
    ("uuid", duck.RULE_SQL["mask-uuid"][0][0]),
    ("prefixed_hex", duck.RULE_SQL["mask-hex"][0][0]),
    ("home", duck.RULE_SQL["mask-home"][0][0]),
    ("path", duck.RULE_SQL["mask-paths"][4][0]),
    ("repo", duck.RULE_SQL["normalise-repo"][0][0]),
    ("time", duck.RULE_SQL["strip-timestamps"][0][0]),
]


def _report_sql() -> str:
    parts = []
    for name, pattern in _COUNTED:
        n = lambda c: f"cast(sum(len(regexp_extract_all({c}, {duck.quote(pattern)}))) as bigint)"  # noqa: B023,E731
        parts.append(f"select source, '{name}' as rule, {n('text')} as hits_before, "
                     f"{n('tagged')} as hits_after from both_texts group by source")
    return (f"with {_MASKED}, both_texts as (select source, text, tagged from documents "
            f"join masked using (doc_id)) " + " union all ".join(parts))


@query("redaction_report", oracle(_report_sql()))
def redaction_report(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("source", "text"))
    return redaction.residual_report(docs, "text", "source")


# The texts the report is made for: documents, log lines, and lines with addresses.
_CORPORA = """corpora as (select 'documents' as corpus, text from documents union all select 'journal', raw from journal
  union all select 'neighbours', message from neighbours)"""


def _survivors_sql() -> str:
    """One nested select a step: the text left, and the values the step takes out of it."""
    steps = [(rule, p, r) for rule, ps in duck.RULE_SQL.items() for p, r in (ps or [(None, None)])]
    edge = " || ".join(f"chr({ord(c)})" for c in VALUE_EDGE)
    sql, values = "select corpus, text, text as t0 from numbered", []
    for k, (rule, pattern, repl) in enumerate(steps):
        before, trimmed = f"t{k}", f"trim(v, {edge})"
        if pattern is None:
            found, left = duck.masked_ipv6(before), duck.mask_ipv6(before)
        else:
            group = 1 if rule == "strip-hostnames" else 0
            found, left = f"regexp_extract_all({before}, {duck.quote(pattern)}, {group})", duck.sub(before, pattern, repl)
            if repl.endswith("<PATH>"):
                trimmed = f"trim(ltrim(v, {edge} || '('), {edge})"
        values.append(f"list_transform({found}, lambda v: {{'rule': '{rule}', 'value': {trimmed}}})")
        sql = f"select *, {left} as t{k + 1}, {values[-1]} as v{k} from ({sql}) s{k}"
    every = ", ".join(f"v{k}" for k in range(len(steps)))
    rules = ", ".join(f"('{r}')" for r in duck.RULE_SQL)
    return f"""
with {_CORPORA}, numbered as (select * from corpora where text is not null), steps as ({sql}),
pairs as (select corpus, last, unnest(list_distinct(flatten([{every}]))) as p from (select *, t{len(steps)} as last from steps) x),
found as (select corpus, p.rule as rule, count(*) as removed, count(*) filter (where contains(last, p.value)) as survived
  from pairs where p.value <> '' group by all)
select c.corpus, r.rule, coalesce(removed, 0) as removed, coalesce(survived, 0) as survived
from (select distinct corpus from corpora) c cross join (values {rules}) r(rule) left join found f on f.corpus = c.corpus and f.rule = r.rule"""


@query("redaction_survivors", oracle(_survivors_sql(), "journal", "neighbours"))
def redaction_survivors(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select(F.lit("documents").alias("corpus"), "text"))
    lines = spread(view(spark, sf_dir, "journal").select(F.lit("journal").alias("corpus"), F.col("raw").alias("text")))
    peers = spread(view(spark, sf_dir, "neighbours").select(F.lit("neighbours").alias("corpus"), F.col("message").alias("text")))
    return redaction.survivor_report(docs.unionByName(lines).unionByName(peers), "text", "corpus")
