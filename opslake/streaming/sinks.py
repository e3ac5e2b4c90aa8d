"""foreachBatch sinks that keep books by epoch, so that a replayed epoch changes nothing.

Every micro-batch overwrites a folder named by its epoch. After a failure Spark hands the same
epoch over again, and the folder gets the same rows again; later epochs are not touched.
"""

from __future__ import annotations

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The epoch of what stands before the stream.
SEED_EPOCH = -1


def _read(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class EpochTable:
    """A stream's rows under ``path``/rows, in a folder for each epoch, with a boolean ``seeded``.

    ``seed``: rows shown before following starts. They are written once, in front of the first
    epoch; a restarted stream finds them and leaves them alone.
    """

    def __init__(self, path: str, seed: DataFrame | None = None):
        self.path, self.seed = path, seed

    def __call__(self, df: DataFrame, epoch: int) -> None:
        if epoch == 0 and self.seed is not None and not self.has_seed(df.sparkSession):
            self._write(self.seed.select(*df.columns), SEED_EPOCH)
        self._write(df, epoch)

    def has_seed(self, spark: SparkSession) -> bool:
        # files without the mark of a finished write are no seed
        return _read(spark, f"{self.path}/seed-written", "n long") is not None

    def _write(self, df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/rows/epoch={epoch}")
        if epoch == SEED_EPOCH:
            df.sparkSession.range(1).select(F.col("id").alias("n")).write.mode("overwrite").parquet(f"{self.path}/seed-written")

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """All rows so far, with their epoch and whether they are of the seed."""
        rows = _read(spark, f"{self.path}/rows", f"{_ddl(schema)}, epoch long")
        rows = spark.createDataFrame([], f"{_ddl(schema)}, epoch long") if rows is None else rows
        return rows.withColumn("seeded", F.col("epoch") == SEED_EPOCH)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


class LateRouter:
    """Rows behind the watermark go to a side table and are counted, the others to the main one.

    The watermark of an epoch is the latest time of all earlier epochs, less ``late_seconds``; it
    is read from the epochs' books (``path``/books: latest time, rows on time, late rows), which an
    observation fills while the rows are written. Rows without a time are on time.
    """

    BOOK = "latest timestamp, on_time long, late long"

    def __init__(self, path: str, late_seconds: int, ts: str = "ts"):
        self.path, self.late, self.ts = path, datetime.timedelta(seconds=late_seconds), ts

    def watermark(self, spark: SparkSession, epoch: int) -> datetime.datetime | None:
        books = _read(spark, f"{self.path}/books", f"{self.BOOK}, epoch long")
        if books is None:
            return None
        latest = books.filter(F.col("epoch") < epoch).agg(F.max("latest")).first()[0]
        return latest - self.late if latest is not None else None

    def __call__(self, df: DataFrame, epoch: int) -> None:
        spark, mark = df.sparkSession, self.watermark(df.sparkSession, epoch)
        behind = F.coalesce(F.col(self.ts) < F.lit(mark), F.lit(False)) if mark is not None else F.lit(False)
        seen = Observation(f"epoch {epoch}")
        routed = df.withColumn("late", behind).observe(
            seen, F.max(self.ts).alias("latest"), F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late"))
        routed.write.mode("overwrite").partitionBy("late").parquet(f"{self.path}/rows/epoch={epoch}")
        book = seen.get
        row = spark.createDataFrame([(book["latest"], book["on_time"], book["late"])], self.BOOK)
        row.write.mode("overwrite").parquet(f"{self.path}/books/epoch={epoch}")

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """All rows so far, with their epoch and ``late``; filtering on ``late`` reads one table only."""
        rows = _read(spark, f"{self.path}/rows", f"{_ddl(schema)}, epoch long, late boolean")
        return spark.createDataFrame([], f"{_ddl(schema)}, epoch long, late boolean") if rows is None else rows

    def books(self, spark: SparkSession) -> DataFrame:
        """(latest, on_time, late, epoch) of every epoch."""
        books = _read(spark, f"{self.path}/books", f"{self.BOOK}, epoch long")
        return spark.createDataFrame([], f"{self.BOOK}, epoch long") if books is None else books


def run_into(df: DataFrame, sink: EpochTable | LateRouter) -> DataFrame:
    """Run a stream over everything available now into a sink; returns all that the sink holds."""
    (df.writeStream.foreachBatch(sink).option("checkpointLocation", f"{sink.path}/state").trigger(availableNow=True)
     .start().awaitTermination())
    return sink.read(df.sparkSession, df.schema)
