"""Command output captured on many hosts, and log files, as line tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake.functions.text import lines, trim


def capture_lines(df: DataFrame, keys: Sequence[str], output: str = "output") -> DataFrame:
    """Non-blank trimmed lines of each capture, with their position."""
    rows = df.select(*keys, F.posexplode(lines(F.col(output))).alias("line_no", "line"))
    return rows.withColumn("line", trim(F.col("line"))).filter(F.col("line") != "")


def write_log_files(df: DataFrame, path: str, log: str, order: Sequence[str], line: str = "line") -> None:
    """Lines as text files below ``path``, a folder for every ``log`` value; its files follow ``order`` by name."""
    (df.repartitionByRange(log, *order).sortWithinPartitions(log, *order).select(log, F.col(line).alias("value"))
     .write.partitionBy(log).option("lineSep", "\n").text(path))


def read_log_files(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """(file, line_at, line) of text files, large ones split across tasks, and the columns of their folders.

    ``line_at`` orders the lines of a file: by the split they come from, then as read. Write the
    rows before using them twice, as it holds within one run only.
    """
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    found = reader.text(path)
    return found.select(
        *[c for c in found.columns if c != "value"], F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("line_at"),
        F.col("value").alias("line"))
