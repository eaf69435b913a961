from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loomwire.functions import dates, text, urls


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_unescape(spark):
    given = ["a &amp;lt; b", "&#8212;&#x2014;&AMP;&bogus;", "&#X41;", "x&nbsp;y", "&#99999999;", "", None]
    assert one(spark, text.html_unescape, *given) == ["a &lt; b", "——&&bogus;", "&#X41;", "x y", "&#99999999;", "", None]


def test_strip_tags(spark):
    assert one(spark, text.strip_tags_listing, "<b>a</b><i>b</i>", " <p>x &gt; y</p> ") == ["ab", "x > y"]
    assert one(spark, text.strip_tags_body, "<b>a</b><i>b</i>") == ["a  b"]
    assert one(spark, text.collapse_whitespace, "﻿ a  \n b ") == ["a b"]
    assert one(spark, text.escape_markdown, "a.b-c!") == [r"a\.b\-c\!"]
    assert one(spark, text.utf16_length, "🏎️") == [3]


def test_canonical_url(spark):
    given = ["HTTPS://WWW.Ex.com:8443/a//?utm_source=x&b=2&A=1&ref=q#f", "ex.com", " ", None, "https://a.com/x y", "no url at all", "http://u:p@a.com/"]
    want = ["https://ex.com/a?A=1&b=2", "https://ex.com/", "", "", "https://a.com/x%20y", "no url at all", "http://a.com/"]
    assert one(spark, urls.canonical_url, *given) == want
    assert one(spark, urls.canonical_url, *want[:2]) == want[:2]  # idempotent


def test_hash_id(spark):
    import hashlib

    df = spark.createDataFrame([("", "S", "T"), ("ex.com", "S", "T")], "u string, s string, t string")
    got = [r[0] for r in df.select(urls.hash_id(F.col("u"), F.col("s"), F.col("t"))).collect()]
    assert got == [hashlib.sha256(x.encode()).hexdigest() for x in ("S:T", "https://ex.com/")]


@pytest.mark.parametrize(
    ("url", "ok"),
    [
        ("https://reuters.com/x", False), ("https://uk.reuters.com/x", True), ("https://a.com/news/", False), ("https://a.com/news/1", True), ("https://a.com/Tag/x", False),
        ("ftp://a.com/x", False), ("a.com/x", False), ("", False), (None, False), ("https://news.google.com/a/b", False),
    ],
)
def test_is_article_url(spark, url, ok):
    assert one(spark, urls.is_article_url, url) == [ok]


def test_token_and_publisher(spark):
    assert one(spark, urls.article_token, "https://news.google.com/rss/articles/T?oc=5", "https://news.google.com/x", "https://a.com/articles/T") == ["T", None, None]
    assert one(spark, urls.is_publisher_url, "https://p.com/a", "https://x.news.google.com/a", "https://u@p.com/", "ftp://p.com/", None) == [True, False, False, False, False]


def test_source_date(spark):
    utc = timezone.utc
    given = ["2025-06-03 10:00", "Tue, 03 Jun 2025 10:00:00 GMT", "2025-06-03T10:00:00+02:00", "", "garbage", None]
    got = [r.timestamp() for r in one(spark, dates.parse_source_date, *given)]
    assert got == [datetime(2025, 6, 3, h, tzinfo=utc).timestamp() for h in (2, 10, 8)] + [0, 0, 0]


def test_extract_time(spark):
    page = '"datePublished": "never" <time datetime="2025-06-03T10:00:00Z">'
    got = one(spark, dates.extract_time, page, "nothing", '"pubTime":"2025/06/03 10:00"')
    assert got[0].hour == 10 and got[1] is None and got[2].hour == 2
