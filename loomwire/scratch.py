"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_mine: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the checkpoint folder already set; a folder of
    its own under /tmp only where neither is set and the master is local, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = f"file:///tmp/loomwire-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(at)
    _mine.append((spark, at))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str = "t") -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _mine.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and the loss of
    an executor costs nothing that was written."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clear() -> None:
    for spark, path in _mine:
        try:
            remove(spark, path)
        except Exception:  # the session has ended
            pass
