"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "opslake") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local session that names none (tests, trial runs) gets a folder of its own; on a
    cluster, whose executors would not see it, that is an error.
    """
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    need_local_master(spark.sparkContext.master)
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="opslake-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


def need_local_master(master: str) -> None:
    if master.split("[")[0] != "local":
        raise ValueError(f"set spark.checkpoint.dir to a folder all executors share (master {master})")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For inputs that several passes need and that are dear to compute; the files outlive
    lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
