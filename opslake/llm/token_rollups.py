"""Token totals by source, language and tokenizer version, kept up to date by deltas.

Method. A batch of changes (inserts, deletes, revised counts) becomes signed numbers: an insert
adds a document's counts, a delete takes them away, a revision takes the old ones away and adds
the new ones. The sums by key of a batch are written under the batch's name, so a batch that is
committed again replaces itself and changes nothing. Totals are the sums over all batches;
``compact`` folds batches into one and keeps their names, so that a late repeat is ignored.

All of it is DataFrame functions; a hot source is summed in every task before anything moves.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake.llm.common import keep

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_chars bigint"

#: Tokenizer versions by name: whole words, and words with punctuation marks of their own.
TOKENIZERS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "marks-2": r"[^\x20\x09-\x0D,.;:!?]+|[,.;:!?]",
}


def count_tokens(text: Column, tokenizer: str) -> Column:
    """Number of tokens of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])).cast("long"), F.lit(0).cast("long"))


def counted(docs: DataFrame, tokenizers: list[str]) -> DataFrame:
    """The documents without their texts: n_chars, and ``counts`` under every tokenizer."""
    counts = F.array(*[F.struct(F.lit(t).alias("tokenizer"), count_tokens(F.col("text"), t).alias("n_tokens")) for t in tokenizers])
    rest = [c for c in docs.columns if c not in ("text", "counts", "n_chars")]
    return docs.select(*rest, F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), counts.alias("counts"))


def inserts(counts: DataFrame, tokenizers: list[str]) -> DataFrame:
    """Signed counts of documents that come in, under the given tokenizers among those counted."""
    each = counts.select("source", "lang", "n_chars", F.explode("counts").alias("c")).filter(F.col("c.tokenizer").isin(tokenizers))
    return each.select("source", "lang", "c.tokenizer", F.lit(1).cast("long").alias("n_docs"), "c.n_tokens", "n_chars")


def deletes(counts: DataFrame, tokenizers: list[str]) -> DataFrame:
    return negative(inserts(counts, tokenizers))


def revisions(old: DataFrame, new: DataFrame, tokenizers: list[str]) -> DataFrame:
    """Signed counts that replace the old versions of documents by the new ones."""
    return deletes(old, tokenizers).unionByName(inserts(new, tokenizers))


def negative(deltas: DataFrame) -> DataFrame:
    return deltas.select(*KEYS, *[(-F.col(c)).alias(c) for c in ("n_docs", "n_tokens", "n_chars")])


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")])


def _read(spark: SparkSession, path: str) -> DataFrame:
    schema = SCHEMA + ", batch string, covers array<string>"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def commit(deltas: DataFrame, path: str, batch: str) -> None:
    """Write the sums of a batch; committing it again, whole or after a failure, changes nothing."""
    covered = _read(deltas.sparkSession, path).filter(F.array_contains("covers", batch))
    if covered.isEmpty():
        (summed(deltas).withColumn("covers", F.lit(None).cast("array<string>")).coalesce(1)  # one row per key
         .write.mode("overwrite").parquet(f"{path}/batch={batch}"))


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Totals over all batches. A compacted batch stands for those it covers; keys that come to nothing go."""
    rows = _read(spark, path)
    covered = rows.select(F.explode("covers").alias("batch")).distinct()
    live = rows.join(covered, "batch", "left_anti")
    return summed(live.drop("covers", "batch")).filter("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")


def compact(spark: SparkSession, path: str, into: str, batches: list[str]) -> None:
    """Fold the named batches into one that stands for them."""
    rows = _read(spark, path).filter(F.col("batch").isin(batches))
    (summed(rows.drop("covers", "batch")).withColumn("covers", F.array(*[F.lit(b) for b in batches]))
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={into}"))


def maintained(docs: DataFrame, path: str) -> DataFrame:
    """Totals of a corpus that is loaded, cleaned of copies and revised, by four batches of changes.

    load: all documents under the first tokenizer. copies: of equal texts all but the row of the
    least id go. retoken: what is left is also counted under the second tokenizer. trim: texts
    that start or end with white space are revised to trimmed ones. The second batch is
    committed twice. Null texts, sources and languages are values of their own (a null text has
    no tokens); rows that are equal in id and text count as one copy each; an empty table has no
    totals.
    """
    spark = docs.sparkSession
    both = list(TOKENIZERS)
    rows = docs.select("doc_id", "source", "lang", "text", F.sha2("text", 256).alias("print"))
    trimmed = F.regexp_replace("text", r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    # texts are read once; from here on only counts move
    plain = counted(rows.withColumn("after", trimmed), both)
    kept = keep(counted(plain.withColumnsRenamed({"after": "text", "n_chars": "before_chars", "counts": "before"}), both)
                .withColumnsRenamed({"n_chars": "trimmed_chars", "counts": "trimmed_counts", "before_chars": "n_chars", "before": "counts"}),
                "counts")
    least = kept.groupBy("print").agg(F.min("doc_id").alias("least"))
    marked = kept.join(least, kept["print"].eqNullSafe(least["print"])).drop(least["print"]).withColumn(
        "stays", F.col("doc_id").eqNullSafe(F.col("least")))
    gone, stay = marked.filter("not stays"), marked.filter("stays")
    commit(inserts(kept, both[:1]), path, "load")
    commit(deletes(gone, both[:1]), path, "copies")
    commit(deletes(gone, both[:1]), path, "copies")
    commit(inserts(stay, both[1:]), path, "retoken")
    loose = stay.filter("trimmed_chars <> n_chars")
    tight = loose.withColumn("n_chars", F.col("trimmed_chars")).withColumn("counts", F.col("trimmed_counts"))
    commit(revisions(loose, tight, both), path, "trim")
    return totals(spark, path)


def sql() -> str:
    """DuckDB SQL for ``maintained``, from the final state of the corpus."""
    one = ", ".join(f"('{name}', len(regexp_extract_all(text, '{p}')))" for name, p in TOKENIZERS.items())
    return rf"""
with stay as (select source, lang, regexp_replace(text, '\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z', '', 'g') as text from (
  select *, min(doc_id) over (partition by text) as least from documents) where doc_id = least),
counted as (select source, lang, length(text) as n_chars, unnest([{one.replace("('", "struct_pack(tokenizer := '").replace("', len", "', n_tokens := len")}]) as c from stay)
select source, lang, c.tokenizer as tokenizer, count(*) as n_docs, cast(sum(c.n_tokens) as bigint) as n_tokens,
  cast(sum(n_chars) as bigint) as n_chars
from counted group by all"""
