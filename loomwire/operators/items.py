"""Relational operators on items: recency, history, first-wins, truncation, duplicates, upsert.

Items are one flat DataFrame with ``category``; order is data and lives in ``source_ord`` and
``item_ord``. Everything is declarative, so filters reach the scan and top-N is pruned per task.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwire.functions.dates import parse_source_date
from loomwire.functions.urls import article_token, canonical_url, hash_id, is_article_url

ORDER = ("source_ord", "item_ord")


def before(as_of: datetime | Column, hours: float) -> Column:
    """The instant ``hours`` (fractions allowed) before ``as_of``."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return at - F.make_dt_interval(secs=F.lit(hours * 3600))


def filter_recency(items: DataFrame, as_of: datetime | Column, hours: float = 24, date: str = "source_date", keep_undated: bool = False) -> DataFrame:
    """Items not older than ``hours`` at ``as_of``. The bound itself, future dates and null dates stay;
    undated items, which bear 1970, go unless ``keep_undated``."""
    keep = F.col(date).isNull() | (F.col(date) >= before(as_of, hours))
    if keep_undated:
        keep = keep | (F.col(date) == F.lit(datetime(1970, 1, 1)).cast(items.schema[date].dataType))
    return items.where(keep)


def history_window(store: DataFrame, categories: Iterable[str], as_of: datetime | Column, days: float = 3, date: str = "source_date") -> DataFrame:
    """Stored items of the categories from the last ``days``, bound included, without their texts."""
    return store.where(F.col("category").isin(list(categories)) & (F.col(date) >= before(as_of, days * 24))).drop("raw")


def to_items(raw: DataFrame, source: Column, as_of: datetime | Column) -> DataFrame:
    """Typed items from listing rows (title, url, time, category, raw)."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    columns = {"hash_id": hash_id(F.col("url"), source, F.col("title")), "source_date": parse_source_date(F.col("time")), "source_name": source, "created_at": at}
    return raw.withColumns(columns).drop("time")


def first_wins(items: DataFrame, keys: Iterable[str | Column], order: Iterable[str] = ORDER) -> DataFrame:
    """The first row by ``order`` of each group of ``keys``; kept as one aggregation with map-side
    combination, so a group that holds a third of all rows is one row per task before the shuffle."""
    order = list(order)
    columns = items.columns
    ks = [k if isinstance(k, Column) else F.col(k) for k in keys]
    named = [k.alias(f"__k{i}") for i, k in enumerate(ks)]
    packed = items.select(*named, F.struct(*order).alias("__o"), F.struct(*columns).alias("__r"))
    best = packed.groupBy(*[f"__k{i}" for i in range(len(ks))]).agg(F.min_by("__r", "__o").alias("r"))
    return best.select("r.*")


def distinct_by_url(items: DataFrame) -> DataFrame:
    """Items of which the canonical URL is seen for the first time in their category."""
    return first_wins(items, ["category", canonical_url(F.col("url"))])


def resolve_links(items: DataFrame, resolved: DataFrame, most: int = 5, group: str = "source_key") -> DataFrame:
    """Aggregator links replaced by what ``resolved`` (url, target; null for a failure) has for them. The
    first ``most`` items of a feed are looked up: failures go, direct links pass. Beyond them
    aggregator links go. Only article URLs remain."""
    rows = items.withColumns({"__a": article_token(F.col("url")).isNotNull()})
    # only the head of each feed is ranked: tasks prune it to ``most`` rows a group before the shuffle
    rank = F.row_number().over(Window.partitionBy(group).orderBy("item_ord", "url"))
    head = rows.withColumn("__n", rank).where(F.col("__n") <= most).where("__a").drop("__n", "__a")
    found = resolved.groupBy(F.col("url").alias("__u")).agg(F.min("target").alias("__t"))
    looked_up = head.join(found, F.col("url") == F.col("__u")).withColumn("url", F.col("__t")).select(*items.columns)
    both = rows.where("not __a").select(*items.columns).unionByName(looked_up)
    return both.where(F.col("url").isNotNull() & is_article_url(F.col("url")))


def drop_known(items: DataFrame, history: DataFrame | None, keys: Iterable[str] = ("category", "hash_id")) -> DataFrame:
    """Items whose keys the history does not have (left anti join); all of them without a history."""
    keys = list(keys)
    return items if history is None else items.join(history.select(*keys), keys, "left_anti")


def truncate(items: DataFrame, n: int = 5, group: str = "category", order: Iterable[str] = ORDER) -> DataFrame:
    """The first ``n`` items by ``order`` of each group, not the newest. Spark prunes each task to ``n``
    rows per group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return items.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def upsert(store: DataFrame, changes: DataFrame, key: str = "hash_id", order: Iterable[str] = ("category_ord", *ORDER)) -> DataFrame:
    """The store after ``changes``: rows of a known key are replaced, others added. Of several changes of a
    key the first by ``order`` counts, where its columns are there."""
    by = [c for c in order if c in changes.columns]
    new = first_wins(changes, [key], by) if by else changes.dropDuplicates([key])
    return store.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True).select(*store.columns)


def category_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def merge_status(flags: DataFrame, flag: str = "ok") -> DataFrame:
    """One row: whether all flags are true; null flags count as false, no flags as true."""
    return flags.agg(F.coalesce(F.bool_and(F.coalesce(F.col(flag), F.lit(False))), F.lit(True)).alias("success"))
