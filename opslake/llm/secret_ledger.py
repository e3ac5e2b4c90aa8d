"""Secret scans over a content-addressed ledger, in DataFrame functions only.

Method. A text version is addressed by its SHA-256. The ledger holds one row for every blob and
rule version that has been scanned, with the spans found. A scan takes the distinct blobs, leaves
out pairs the ledger has, searches the rest and adds them as one batch; findings are then joined
back to every row (path) that holds the blob. Writing a batch again replaces it, so a retried
batch changes nothing.

Places are code points. They come from the lengths of what ``split`` leaves between the matches
and of the matches themselves, summed in order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opslake.functions.text import bind
from opslake.llm.common import free_name, keep, numbered, spans_text
from opslake.plans.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched leftmost without overlaps; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(pattern: str) -> str:
    """ASCII letters in either case, and no others (case folding would let in more)."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in pattern)


#: A private key to its END line (headers may hold single hyphens), else its marker and the base64 lines after it.
_PEM = (r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----(?:[A-Za-z0-9+/=,:\\\t\n\r\x20]*(?:-[A-Za-z0-9+/=,:\\\t\n\r\x20]+){0,64}"
        r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----|"
        r"(?:[\r\n]+(?:Proc-Type|DEK-Info):[^\r\n]*){0,2}[\r\n]+[A-Za-z0-9+/=\r\n]*[A-Za-z0-9+/=](?m:$))?")

#: In the order in which kinds are listed; the first three are the base.
RULES = [
    Rule("assign", 1, _either_case("(password|passwd|secret|token|api_?key)")
         + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", 2, _PEM),
]
BASE = ("assign", "access", "hex")
TAG = "<SECRET>"

LEDGER = "blob binary, rule string, version int, spans array<struct<start:bigint,end:bigint>>"


def blob_of(text: Column) -> Column:
    """Content address; null is the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _hits(text: Column, rule: Rule) -> Column:
    """Array of (piece before, match, tested group) of a text."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    before = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = F.transform(found, F.length)
    return F.when(text.rlike(rule.pattern), F.arrays_zip(
        F.slice(before, 1, F.size(found)).alias("before"), sizes.alias("size"), F.transform(group, F.length).alias("tested")))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All pairs of a ledger; an absent ledger is empty."""
    try:
        return spark.read.schema(LEDGER + ", batch string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER + ", batch string")


def scan(docs: DataFrame, ledger_path: str, batch: str, rules: list[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """Search the blobs of ``docs`` under the rule versions not in the ledger yet; returns the whole ledger."""
    spark = docs.sparkSession
    # what the batch wrote itself when it ran before is done anew
    known = read_ledger(spark, ledger_path).filter(F.col("batch") != batch)
    blobs = (
        docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text"))
        .withColumn("blob", blob_of(F.col("text"))).dropDuplicates(["blob"])
    )
    done = known.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("done"))
    open_pairs = blobs.join(done, "blob", "left").withColumn(
        "done", F.coalesce("done", F.array().cast("array<string>")))
    unseen = lambda r: ~F.array_contains("done", r.name)
    pairs = open_pairs.select("blob", F.explode(F.array(*[
        F.when(unseen(r), F.struct(
            F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"),
            _hits(F.col("text"), r).alias("hits"))) for r in rules])).alias("p")).filter("p is not null")
    each = pairs.select("blob", "p.rule", "p.version", "p.least", F.posexplode_outer("p.hits").alias("nth", "hit"))
    upto = Window.partitionBy("blob", "rule").orderBy("nth")
    placed = each.withColumn("end", F.sum(F.col("hit.before") + F.col("hit.size")).over(upto))
    span = F.when(F.col("hit.tested") >= F.col("least"), F.struct(
        (F.col("end") - F.col("hit.size")).alias("start"), F.col("end").alias("end")))
    found = placed.groupBy("blob", "rule", "version").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    found.write.mode("overwrite").option("compression", "zstd").parquet(f"{ledger_path}/batch={batch}")
    return read_ledger(spark, ledger_path)


def findings(ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """blob and its spans (start, place of the kind, kind, end) under the given rule versions."""
    order = F.coalesce(*[
        F.when((F.col("rule") == r.kind) & (F.col("version") == r.version), i) for i, r in enumerate(rules)])
    hit = ledger.withColumn("ord", order).filter(F.col("ord").isNotNull() & (F.size("spans") > 0))
    flat = hit.select("blob", "rule", "ord", F.explode("spans").alias("s")).select(
        "blob", F.struct(F.col("s.start").alias("start"), "ord", F.col("rule").alias("kind"), F.col("s.end").alias("end")).alias("s"))
    return flat.groupBy("blob").agg(F.sort_array(F.collect_set("s")).alias("found"))


def report(docs: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans; equal rows give equal rows; texts are searched whole;
    an empty table gives no rows. Findings are kept before the join, so that both sides are plain
    shuffles and the rows of a blob with very many copies can be split over tasks.
    """
    spans = keep(findings(ledger, rules), "findings")
    paths = docs.select(docs[id_col].alias("_id"), blob_of(docs[text_col]).alias("blob"))
    found = F.coalesce("found", F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint>>"))
    base = F.filter(found, lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return paths.join(spans, "blob", "left").select(
        F.col("_id").alias(id_col), *[count(k) for k in BASE],
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(found).alias("spans"))


def scan_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``report`` over a ledger that is filled in two batches (a new one in the shared folder, if no ``path`` is given).

    The first scan knows the base rules; the second, under all rules, searches the same blobs
    for the rules the ledger has not seen with them.
    """
    path = path or scratch_path(docs.sparkSession, "ledger")
    scan(docs, path, "0", [r for r in RULES if r.kind in BASE], text_col)
    return report(docs, scan(docs, path, "1", RULES, text_col), id_col=id_col, text_col=text_col)


def _without(rule: Rule) -> Callable[[Column], Column]:
    def tag(match: Column, tested: Column) -> Column:
        return F.when(F.length(tested) >= rule.least, F.lit(TAG)).otherwise(match)

    def replaced(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
        tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
        parts = F.zip_with(F.split(text, rule.pattern, -1), F.zip_with(found, tested, tag),
                           lambda before, match: F.concat(before, F.coalesce(match, F.lit(""))))
        return F.when(text.rlike(rule.pattern), F.concat_ws("", parts)).otherwise(text)
    return replaced


def redacted(text: Column, rules: list[Rule] = RULES) -> Column:
    """The text with every secret replaced by a tag, rule by rule; whole keys first, before others cut into them."""
    for r in sorted(rules, key=lambda r: r.kind != "pem"):
        text = bind(text, _without(r))  # bound, so that the expression grows by one term a rule
    return text


def redact_corpus(docs: DataFrame, ledger_path: str | None = None, batch: str = "0", id_col: str = "doc_id",
                  text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All documents, those with secrets redacted; ``chars_col`` follows where there is one.

    Other columns come back unchanged, whatever they are called.
    """
    ledger = scan(docs, ledger_path or scratch_path(docs.sparkSession, "ledger"), batch, text_col=text_col)
    held = findings(ledger).select("blob")
    row, hit = free_name(docs, "_row"), free_name(docs, "_hit")
    # by row, so that the texts do not move: the blobs go to the rows' keys
    rows = numbered(docs, id_col, row)
    marks = rows.select(row, blob_of(rows[text_col]).alias("blob")).join(held, "blob", "left_semi").select(
        row, F.lit(True).alias(hit))
    out = rows.join(marks, row, "left").withColumn(
        text_col, F.when(F.col(hit), redacted(F.col(text_col))).otherwise(F.col(text_col)))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(hit), F.length(text_col).cast(dict(docs.dtypes)[chars_col]))
                             .otherwise(F.col(chars_col)))
    return out.drop(row, hit)


def sql() -> str:
    """DuckDB SQL for ``scan_corpus`` over documents."""
    parts = []
    for i, r in enumerate(RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(f"""
select doc_id, {i} as ord, '{r.kind}' as kind, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
    "end" := cast(coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0)
             + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) as bigint),
    size := length(m[i]), tested := length(g[i])))) as h
from (select doc_id, regexp_extract_all(t, {p}) as m, regexp_extract_all(t, {p}, {r.group}) as g,
        string_split_regex(t, {p}) as s from texts where regexp_matches(t, {p})) x{i}""")
    base = ", ".join(f"'{k}'" for k in BASE)
    entry = "string_agg(kind || ':' || (h.\"end\" - h.size) || ':' || h.\"end\", ',' order by h.\"end\" - h.size, ord)"
    least = " ".join(f"when {i} then {r.least}" for i, r in enumerate(RULES))
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE)
    return f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
every as ({" union all ".join(parts)}),
hits as (select * from every where h.tested >= case ord {least} end),
per_doc as (select doc_id, {counts}, {entry} filter (kind in ({base})) as base, {entry} as spans from hits group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in BASE)},
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join per_doc using (doc_id)"""
