"""All registered queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opslake.catalog import base

AREAS = ["redaction", "logs", "audit", "watch", "history", "replies", "inventory"]


def load() -> tuple[dict[str, base.Query], dict[str, str]]:
    for area in AREAS:
        importlib.import_module(f"opslake.catalog.{area}")
    return base.QUERIES, base.ORACLES


def in_utc(fn: base.Query) -> Callable[[SparkSession, str], DataFrame]:
    """Times in the tables are plain UTC times, so windows and epochs are taken in UTC."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last one counts
        return fn(spark, sf_dir)
    return run
