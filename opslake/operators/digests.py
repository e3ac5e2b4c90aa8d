"""Readable texts per host built from typed rows, in pages of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions.text import trim
from opslake.plans.partitioning import running_index

PAGE_LINES = 1000


def paged_digest(rows: DataFrame, hosts: DataFrame, order: Sequence[str], bucket: Column, line: Column,
                 empty: str, page_lines: int = PAGE_LINES) -> DataFrame:
    """(host, page, digest): the rows of a host in order, ``page_lines`` to a page.

    The pages of a host joined by newlines are its whole text. ``line`` may use ``number``,
    the 1-based position of the row. Hosts without rows get one page with ``empty``.
    """
    numbered = running_index(rows, ["host"], order, bucket, "number")
    texts = numbered.select(
        "host", F.floor((F.col("number") - 1) / page_lines).alias("page"), "number", line.alias("line"))
    pages = texts.groupBy("host", "page").agg(trim(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("number", "line"))), lambda r: r["line"]), "\n")).alias("digest"))
    return hosts.join(pages, "host", "left").select(
        "host", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("digest", F.lit(empty)).alias("digest"))
