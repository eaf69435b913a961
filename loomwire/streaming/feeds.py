"""Items as a stream: listing rows arrive, what is new and recent goes to the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomwire.operators.items import first_wins


def read_items(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Stream of the Parquet files under ``path``; a single file is read through its folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def distinct_items(items: DataFrame, date: str = "created_at", late: str = "3 days") -> DataFrame:
    """Items less repetitions of their category and hash_id within ``late``: the state forgets older keys,
    as the history window does."""
    return items.withWatermark(date, late).dropDuplicatesWithinWatermark(["category", "hash_id"])


def counts_by_window(items: DataFrame, date: str = "created_at", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    from pyspark.sql import functions as F

    return items.withWatermark(date, late).groupBy(F.window(date, width), "category").count()


def save_new(items: DataFrame, save: Callable[[DataFrame], None], checkpoint: str, order: tuple[str, ...] = ("source_ord", "item_ord")) -> StreamingQuery:
    """Runs over all files there are and ends: each micro-batch keeps the first of its equal items and hands
    them to ``save``. Saving by key makes a repeated batch harmless."""

    def batch(df: DataFrame, _: int) -> None:
        save(first_wins(df, ["category", "hash_id"], order))

    return items.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
