from pyspark.sql import functions as F

from loomwire.operators.fetch import fetch_items
from loomwire.schema import ITEM, validate
from tests.test_items import AS_OF

REGISTRY = "category string, source_ord int, source_key string, kind string, url string, source_name string, parser string"
FEED = "<item><title>A story title</title><link>{}</link><pubDate>Tue, 03 Jun 2025 10:00:00 GMT</pubDate></item>"


def test_fetch(spark, rows):
    registry = spark.createDataFrame(
        [("f1", 0, "a", "html", "https://a.example/l", "A", "article_links"), ("f1", 1, "b", "rss", "https://b.example/feed", "B", "feed"), ("ai", 0, "c", "html", "https://a.example/l", "C", "article_links"), ("ai", 1, "d", "rss", "https://d.example/feed", "D", "feed")],
        REGISTRY,
    )
    link = "https://www.formula1.com/en/latest/article/1"
    g = "https://news.google.com/rss/articles/T"
    pages = spark.createDataFrame([("https://a.example/l", '<a href="/en/latest/article/1">A long headline</a>'), ("https://b.example/feed", FEED.format(link) + FEED.format("https://x.example/1") + FEED.format(g)), ("https://d.example/feed", None)], "url string, html string")
    got = fetch_items(registry, pages, AS_OF)
    # the link of the first source wins, rows of another category and pages that are missing give nothing
    assert rows(got, "category", "source_name", "url") == sorted([("f1", "A", link), ("f1", "B", "https://x.example/1"), ("f1", "B", g)], key=repr)
    dated = {r.url: r.us for r in got.select("url", F.unix_micros("source_date").alias("us")).collect()}
    assert dated[link] == 0 and dated["https://x.example/1"] > 0
    assert validate(got, ITEM).count() == 3 and fetch_items(registry, pages, AS_OF, ["ai"]).count() == 0
    resolved = spark.createDataFrame([(g, "https://y.example/2")], "url string, target string")
    assert rows(fetch_items(registry, pages, AS_OF, resolved=resolved), "url") == sorted([(link,), ("https://x.example/1",), ("https://y.example/2",)], key=repr)
