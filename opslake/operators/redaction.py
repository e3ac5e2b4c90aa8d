"""Corpus-level redaction jobs."""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslake.functions.redact import MASKING, PATTERNS, Rule, nothing_removed, removal_steps, sanitise
from opslake.functions.text import once

# What must not survive redaction, by report name.
LEAK_PATTERNS = {
    "email": PATTERNS["email"],
    "ipv4": PATTERNS["ipv4"],
    "hex": PATTERNS["bare_hex"],
    "url": PATTERNS["url"],
    "mac": PATTERNS["mac"],
    "uuid": PATTERNS["uuid"],
    "prefixed_hex": PATTERNS["prefixed_hex"],
    "home": PATTERNS["home_path"],
    "path": PATTERNS["any_path"],
    "repo": PATTERNS["repo_cache"],
    "time": PATTERNS["iso_time"],
}


def sanitise_column(df: DataFrame, column: str, name: str, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Add ``name``, the sanitised text of ``column``; per-row work, no shuffle."""
    return df.withColumn(name, sanitise(F.col(column), rules))


def residual_report(df: DataFrame, column: str, by: str) -> DataFrame:
    """Pattern hits before and after redaction per rule and ``by`` value, in one pass."""
    both = sanitise_column(df, column, "_after")
    sums = []
    for rule, pattern in LEAK_PATTERNS.items():
        sums.append(F.sum(F.regexp_count(column, F.lit(pattern))).alias(f"before_{rule}"))
        sums.append(F.sum(F.regexp_count("_after", F.lit(pattern))).alias(f"after_{rule}"))
    wide = both.groupBy(by).agg(*sums)
    rows = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.col(f"before_{rule}").alias("hits_before"),
                 F.col(f"after_{rule}").alias("hits_after"))
        for rule in LEAK_PATTERNS])
    return wide.select(by, F.inline(rows))


def found_in(values: Sequence[str], text: str) -> list[bool]:
    """Which of the values occur in a text; one pass over the text, however many there are."""
    automaton = ahocorasick.Automaton()
    for v in values:
        automaton.add_word(v, v)
    automaton.make_automaton()
    seen = {v for _, v in automaton.iter(text)} if len(automaton) else set()
    return [v in seen for v in values]


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _found(values: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([found_in(v, t) if len(v) else [] for v, t in zip(values, text)])


def removed_values(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``name``: struct(values, text), what the masking rules take out of a text and what they leave.

    ``values`` are different (rule, value) pairs. Every step is computed once, as the next ones read it often.
    """
    rows = once(df, name, nothing_removed(F.col(column)))
    for step in removal_steps():
        rows = once(rows.withColumnRenamed(name, "_before"), name, step(F.col("_before"))).drop("_before")
    values = F.array_distinct(F.filter(F.col(name)["values"], lambda v: v["value"] != ""))
    return rows.withColumn(name, F.struct(values.alias("values"), F.col(name)["text"].alias("text")))


def survivors(df: DataFrame, column: str) -> DataFrame:
    """The columns of ``df``, and rule and value of everything removed that its redacted text still holds elsewhere, as ``survived``.

    One row for every different removed value of a text. A text without any is left out.
    """
    rows = removed_values(df.filter(F.col(column).isNotNull()), column, "_r").filter(F.size("_r.values") > 0)
    # the texts of a batch go to the automaton with their values, by Arrow
    marked = rows.withColumn("_hit", _found(F.transform("_r.values", lambda v: v["value"]), F.col("_r.text")))
    pairs = F.zip_with("_r.values", "_hit", lambda v, h: F.struct(
        v["rule"].alias("rule"), v["value"].alias("value"), h.alias("survived")))
    return marked.select(*df.columns, F.inline(pairs))


def survivor_report(df: DataFrame, column: str, by: str) -> DataFrame:
    """Removed values per ``by`` value and rule, and how many of them survive in their own text; all rules are listed."""
    found = survivors(df.select(by, column), column).groupBy(by, "rule").agg(
        F.count(F.lit(1)).alias("removed"), F.count_if("survived").alias("survived"))
    zeros = df.select(by).distinct().select(by, F.explode(F.array(*[F.lit(r) for r in MASKING])).alias("rule"))
    return zeros.join(found, [by, "rule"], "left").select(
        by, "rule", F.coalesce("removed", F.lit(0)).alias("removed"), F.coalesce("survived", F.lit(0)).alias("survived"))
