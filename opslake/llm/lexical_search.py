"""Ranked lexical search with one score for each class of like documents.

Method (bag deduplication). A document is restricted to the vocabulary of the items: what is left
is its vector of term frequencies, and its length enters the score only through the whole number
m. Documents with the same vector and the same m score alike for every item, so they form one
class: they are brought together by a hash and told apart by vector and m themselves. A class is
scored once, through an inverted index of the items; the best classes of an item are then expanded
into their members by ascending id.

The members of a class tie for every item, so its first ``TOP`` ids are all that a result can show.
They are found in two steps (by class and salt, then by class), so that a class of very many
copies does not meet in one task before it is cut down. The items are a stated query set: they go
to the tasks in blocks of about ``BLOCK_CHARS`` characters, and every block reads all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslake.llm.common import arrow_rows, keep, sliced

TOP = 20
#: Characters of items sent to the tasks at once.
BLOCK_CHARS = 4 << 20
#: Class and item pairs scored at a time.
CELLS = 1 << 21
SALTS = 8
#: Letters and digits of ASCII and all that lies beyond; as UTF-8 bytes, bytes from 0x80 on.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text in order, only A-Z in lower case."""
    return _TERM.findall((text or "").encode("utf-8").lower())


@dataclass
class Items:
    """A block of items: their vocabulary, and for each term the items that hold it and how often."""

    row: np.ndarray
    vocabulary: dict[bytes, int]
    start: np.ndarray
    item: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        entries = [(vocabulary.setdefault(t, len(vocabulary)), i, n)
                   for i, (_, text) in enumerate(rows) for t, n in Counter(terms(text)).items()]
        flat = np.array(sorted(entries), np.int64).reshape(-1, 3)
        start = np.searchsorted(flat[:, 0], np.arange(len(vocabulary) + 1))
        return cls(np.array([r for r, _ in rows], np.int64), vocabulary, start, flat[:, 1], flat[:, 2])

    def bag(self, text: str | None) -> tuple[int, np.ndarray]:
        """How many terms a text has, and its (term, frequency) pairs within the vocabulary, by term."""
        counts = Counter(found := terms(text))
        pairs = sorted((self.vocabulary[t], n) for t, n in counts.items() if t in self.vocabulary)
        return len(found), np.array(pairs, np.int64).reshape(-1, 2)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def score(items: Items, weights: np.ndarray, m: np.ndarray, of: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """Classes x items. Pair (term, tf) belongs to class ``of``, whose length figure is ``m[of]``."""
    gain = weights[term] * ((1000000000 * tf) // (1000 * tf + 12 * m[of]))
    n = np.diff(items.start)[term]
    pair = np.repeat(np.arange(len(term)), n)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + items.start[term][pair]
    out = np.zeros((len(m), len(items.row)), np.int64)
    np.add.at(out.reshape(-1), of[pair] * len(items.row) + items.item[at], gain[pair] * items.times[at])
    return out


def _best_classes(items: Items, weights: np.ndarray):
    """For each item the first ``TOP`` classes of a partition: higher scores, then the smaller first id."""
    rows_at_once = max(1, CELLS // max(1, len(items.row)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((4, 0), np.int64)  # item, score, place of the id, class
        for batch in sliced(batches, rows_at_once):
            first, m, class_ = (batch[c].to_numpy() for c in ("first", "m", "class"))
            bags = [np.frombuffer(b, np.int32).reshape(-1, 2) for b in batch["bag"].to_pylist()]
            of = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
            pairs = np.concatenate(bags).astype(np.int64) if bags else np.zeros((0, 2), np.int64)
            scores = score(items, weights, m, of, pairs[:, 0], pairs[:, 1])
            floor = np.zeros(len(items.row), np.int64)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(floor)) >= TOP)
            least = np.full(len(floor), np.iinfo(np.int64).max)
            np.minimum.at(least, best[0], best[1])
            floor[full] = least[full] - 1  # ties may win by id
            c, i = np.nonzero(scores > np.maximum(floor, 0))
            best = np.concatenate((best, np.stack((i, scores[c, i], first[c], class_[c]))), 1)
            best = best[:, np.lexsort((best[3], best[2], -best[1], best[0]))]
            best = best[:, np.arange(best.shape[1]) - np.searchsorted(best[0], best[0]) < TOP]
        yield pa.record_batch({"item": pa.array(items.row[best[0]]), "score": pa.array(best[1]),
                               "first": pa.array(best[2]), "class": pa.array(best[3])})
    return run


def _bags(docs: DataFrame, items: Items) -> DataFrame:
    """_row, _id, n (terms), bag (int32 pairs within the vocabulary); documents without a term go."""
    shared = docs.sparkSession.sparkContext.broadcast(items)  # BLOCK_CHARS bounds it

    def fold(rows, ids, texts):
        bags = [shared.value.bag(t) for t in texts.to_pylist()]
        return pa.table({"_row": rows, "_id": ids, "n": pa.array([n for n, _ in bags], pa.int64()),
                         "bag": pa.array([b.astype(np.int32).tobytes() for _, b in bags], pa.binary())}).filter(
            pa.array([n > 0 for n, _ in bags], pa.bool_()))

    return keep(docs.mapInArrow(arrow_rows(fold, ["_row", "_id", "_text"]), "_row long, _id long, n long, bag binary"), "bags")


def _frequencies(bags: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary, summed over partitions."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in sliced(batches):
            pairs = np.frombuffer(b"".join(batch["bag"].to_pylist()), np.int32).reshape(-1, 2)
            df += np.bincount(pairs[:, 0], minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.record_batch({"term": pa.array(at), "df": pa.array(df[at])})

    total = np.zeros(n_terms, np.int64)
    for r in bags.select("bag").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        total[r.term] = r.df  # one row for each term of the block
    return total


def _search(docs: DataFrame, items: Items) -> DataFrame:
    """item (row), rank, _id, score for one block of items."""
    spark = docs.sparkSession
    bags = _bags(docs, items)
    documents, length = bags.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _frequencies(bags, len(items.vocabulary))
    weights = np.array([weight(documents, int(d)) for d in df], np.int64)
    like = ["h", "m", "bag"]
    at_all = bags.filter(F.length("bag") > 0).withColumn(
        "m", F.lit(75).cast("long") + F.expr(f"(25 * n * {documents}L) div {max(length, 1)}L")).withColumn(
        "h", F.xxhash64("bag", "m")).withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)))
    # null ids come after all others
    place = [F.col("_id").isNull(), F.col("_id"), F.col("_row")]
    salted = at_all.withColumn("nth", F.row_number().over(Window.partitionBy(*like, "salt").orderBy(*place)))
    few = salted.filter(F.col("nth") <= TOP)
    ranked = few.withColumn("nth", F.row_number().over(Window.partitionBy(*like).orderBy(*place))).filter(F.col("nth") <= TOP)
    # the class is named by the row of its first member
    named = ranked.withColumn("class", F.first("_row").over(Window.partitionBy(*like).orderBy("nth")))
    members = keep(named.select("class", "nth", "_row", "_id", "m", F.when(F.col("nth") == 1, F.col("bag")).alias("bag")), "members")
    classes = members.filter("nth = 1").select("class", "m", "bag", F.coalesce("_id", F.lit((1 << 63) - 1)).alias("first"))
    shared = spark.sparkContext.broadcast((items, weights))  # BLOCK_CHARS bounds it

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _best_classes(*shared.value)(batches)

    found = classes.mapInArrow(best, "item long, score long, first long, class long")
    top = found.withColumn("nth", F.row_number().over(
        Window.partitionBy("item").orderBy(F.desc("score"), "first", "class"))).filter(F.col("nth") <= TOP)
    expanded = top.select("item", "score", "class").join(members.select("class", "_id", "_row"), "class")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), *place))
    return expanded.withColumn("rank", rank).filter(F.col("rank") <= TOP).select("item", "rank", "_id", "score")


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           query_col: str = "text") -> DataFrame:
    """The ``TOP`` documents with the highest score above 0 for each item: item id, rank, document id, score.

    Document ids are whole numbers. Null and empty texts have no terms: such a document counts
    nowhere, such an item has no rows. Equal rows are documents (or items) of their own; among equal
    scores the smaller id comes first, a null id last. Empty tables give no rows.
    """
    narrow = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text")).withColumn(
        "_row", F.monotonically_increasing_id())
    asked = keep(queries.select(queries[item_col].alias("_item"), queries[query_col].alias("_text")).withColumn(
        "_row", F.monotonically_increasing_id()), "items")
    chars = asked.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0]
    blocks = 1 + chars // BLOCK_CHARS
    out = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == b).select("_row", "_text").orderBy("_row").collect()
        found = _search(narrow, Items.of([tuple(r) for r in rows]))
        out = found if out is None else out.unionByName(found)
    return asked.select(F.col("_row").alias("item"), "_item").join(out, "item").select(
        F.col("_item").alias(item_col), "rank", F.col("_id").alias(id_col), "score")


_TERMS_SQL = r"""regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

#: DuckDB SQL for ``search`` over documents and benchmark.
SQL = f"""
with docs as (
  select row_number() over () as row, doc_id, {_TERMS_SQL.format("text")} as terms from documents where text is not null),
total as (select count(*) as n, cast(sum(len(terms)) as bigint) as l from docs where len(terms) > 0),
tf as (
  select d.row, d.doc_id, d.len, d.term, count(*) as tf
  from (select row, doc_id, len(terms) as len, unnest(terms) as term from docs) d group by all),
w as (
  select term, cast(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) as bigint) as w
  from (select term, count(*) as df from tf group by term), total),
items as (select row_number() over () as item, item_id, unnest({_TERMS_SQL.format("text")}) as term from benchmark),
asked as (select item, item_id, term, count(*) as times from items group by all),
scored as (
  select item, item_id, row, doc_id,
    cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len * n) // l)))) as bigint) as score
  from asked join tf using (term) join w using (term), total group by all)
select item_id, cast(row_number() over (partition by item order by score desc, doc_id nulls last, row) as integer) as rank,
  doc_id, score
from scored where score > 0
qualify rank <= {TOP}"""
