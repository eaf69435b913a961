"""Items of the sources of a registry, from pages already fetched."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire.operators.items import distinct_by_url, resolve_links, to_items
from loomwire.sources.listings import LISTINGS, parse_feed, parse_listing

_ROW = ("slot", "item_ord", "title", "url", "time", "category", "raw")


def fetch_items(registry: DataFrame, pages: DataFrame, as_of: datetime | Column, categories: Iterable[str] | None = None, resolved: DataFrame | None = None, most_links: int = 5) -> DataFrame:
    """Typed items with source_ord and item_ord of the registry's sources.

    ``registry`` has category, source_ord, source_key, url, source_name and parser (a listing or
    ``feed``); ``pages`` has url and html. A source without a page, or whose page is null, gives no
    items and stops nothing. Feeds take the category of their entry; rows of listings must be of
    it. Aggregator links are replaced by ``resolved`` (url, target) where it is given. Within a
    category the first of equal canonical URLs stays. Sources run side by side, page by page.
    """
    wanted = registry if categories is None else registry.where(F.col("category").isin(list(categories)))
    slots = wanted.select(F.concat_ws("|", "category", F.col("source_ord").cast("string"), "source_key").alias("slot"), F.col("category").alias("of"), "source_ord", "source_key", "source_name", "parser", F.col("url").alias("at"))
    html = pages.groupBy(F.col("url").alias("pu")).agg(F.first("html", ignorenulls=True).alias("html"))
    read = slots.join(html, F.col("at") == F.col("pu")).where("html is not null").select("slot", "parser", "html")
    rows = parse_feed(read.where("parser = 'feed'"), "slot", "html").withColumn("category", F.lit(None).cast("string")).select(*_ROW)
    for name in LISTINGS:
        found = parse_listing(read.where(F.col("parser") == name), name, "slot").withColumn("raw", F.lit(None).cast("string"))
        rows = rows.unionByName(found.select(*_ROW))
    both = rows.join(slots.withColumnRenamed("slot", "s"), F.col("slot") == F.col("s")).where(F.col("category").isNull() | (F.col("category") == F.col("of")))
    both = both.select("title", "url", "time", F.col("of").alias("category"), "raw", "source_name", "source_ord", "item_ord", "source_key")
    if resolved is not None:
        both = resolve_links(both.withColumn("__feed", F.concat_ws("|", "category", "source_key")), resolved, most_links, "__feed").drop("__feed")
    items = to_items(both, F.col("source_name"), as_of).withColumn("bullets", F.lit(None).cast("array<string>"))
    order = ["hash_id", "url", "title", "source_date", "source_name", "category", "bullets", "raw", "created_at", "source_ord", "item_ord"]
    return distinct_by_url(items.select(*order))
