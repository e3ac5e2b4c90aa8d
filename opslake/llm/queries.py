"""Registered queries of the training-data operators, and the DuckDB SQL of those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opslake.llm import (
    bpe, decontaminate, factorisation, hard_negatives, hmm_lm, lexical_search, line_crf, pii, secret_ledger, simhash,
    suffix_dedup, token_rollups, warc,
)
from opslake.plans.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_warc_revisits", warc.SQL)
def op1(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op2_suffix_dedup")
def op2(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op3_simhash_near_dedup")
def op3(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_token_rollups", token_rollups.sql())
def op6(spark, sf_dir):
    return token_rollups.maintained(table(spark, sf_dir, "documents"), scratch_path(spark, "rollups"))


@query("op7_bpe_encode_decode")
def op7(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


@query("op8_hmm_scores")
def op8(spark, sf_dir):
    return hmm_lm.scores(table(spark, sf_dir, "documents"))


@query("op9_decontamination")
def op9(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("_row")


@query("op10_pii_anchors")
def op10(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@query("op5_line_crf_quality")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return line_crf.judge(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


@query("op4_secret_ledger", secret_ledger.sql())
def op4(spark, sf_dir):
    return secret_ledger.scan_corpus(table(spark, sf_dir, "documents"))


@query("op11_hard_negatives", hard_negatives.SQL)
def op11(spark, sf_dir):
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


@query("op12_lexical_search", lexical_search.SQL)
def op12(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_factorisation_quality")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return factorisation.judge(docs, factorisation.train(docs, table(spark, sf_dir, "labels")))
