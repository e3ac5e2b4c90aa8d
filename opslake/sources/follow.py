"""Live sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def follow_files(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                 files_per_trigger: int = 64) -> DataFrame:
    """New files under ``path`` as a stream; a micro-batch takes a bounded number of them."""
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", files_per_trigger).load(path))
