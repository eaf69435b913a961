import pytest
from pyspark.sql import functions as F

from loomwire import queries
from loomwire.sources import frames, listings
from loomwire.sources.store import ParquetStore
from tests.test_items import frame


def parse(spark, name, *html):
    df = spark.createDataFrame(list(enumerate(html)), "page_id int, html string")
    return [tuple(r) for r in listings.parse_listing(df, name).orderBy("page_id", "item_ord").select("title", "url", "time").collect()]


def test_cards_look_back_then_forward(spark):
    h2 = '<h2 data-testid="card-headline">A long headline</h2>'
    a = '<a href="/news/articles/{}">'
    assert parse(spark, "cards", a.format("x") + h2, h2 + a.format("y"), a.format("x") + h2 + h2, h2, None, "") == [
        ("A long headline", "https://www.bbc.com/news/articles/x", ""), ("A long headline", "https://www.bbc.com/news/articles/y", ""), ("A long headline", "https://www.bbc.com/news/articles/x", ""),
    ]


def test_spans_skip_noise_and_live(spark):
    row = '<a href="/2025/06/03/{}/x"><span class="container__headline">{}</span>'
    page = row.format("live-news", "A headline of twenty characters") + row.format("world", ".css{padding} and so on and on") + row.format("world", "Another headline, long enough")
    assert [t for t, _, _ in parse(spark, "spans", page)] == ["Another headline, long enough"]


def test_numbered_times(spark):
    page = '"contId":"1","a":2,"pubTime":"2025-06-03 10:00"}<a href="/newsDetail_forward_1"><h2>标题标题标题标题标题标题</h2></a>'
    assert parse(spark, "numbered", page) == [("标题标题标题标题标题标题", "https://www.thepaper.cn/newsDetail_forward_1", "2025-06-03 10:00")]


def test_caps(spark):
    rows = "".join(f'<a href="/content/{i}.html"><b class="title">A title that is long, no. {i}</b></a>' for i in range(40))
    assert len(parse(spark, "titled", rows)) == 30


def test_feed(spark, rows):
    item = "<item><title>{}</title><link>{}</link><pubDate>d</pubDate><description>{}</description></item>"
    xml = item.format("<![CDATA[A &amp; title]]>", "https://a.example", "<p>" + "d" * 41 + "</p><a class='more' href='#'>Keep reading</a>") + item.format("short", "x", "") + item.format("A long title", " ", "") + item.format("Second title", "u", "d" * 40)
    df = spark.createDataFrame([(1, xml), (2, None)], "page_id int, html string")
    assert rows(listings.parse_feed(df), "item_ord", "title", "url", "raw") == [(0, "A & title", "https://a.example", "d" * 41), (3, "Second title", "u", None)]


def test_frames(spark):
    body = 'junk\n[["wrb.fr","Fbv4je","[\\"garturlres\\",\\"https://p.example/a\\"]"]]\n['
    assert frames.candidates(body) == ["https://p.example/a"] and frames.candidates(None) == []
    df = spark.createDataFrame([(body,), ("x",), (None,)], "b string")
    assert [r[0] for r in df.select(frames.resolved_url(F.col("b"))).collect()] == ["https://p.example/a", None, None]


def test_store(spark, rows, tmp_path):
    store = ParquetStore(spark, f"file://{tmp_path}/store")
    assert store.read().count() == 0
    store.upsert(frame(spark, dict(hash_id="a"), dict(hash_id="b", category="f1")))
    store.upsert(frame(spark, dict(hash_id="a", title="new", category="f1")))
    assert rows(store.read(), "hash_id", "title", "category") == [("a", "new", "f1"), ("b", "A title", "f1")]
    assert rows(store.read(["ai"]), "hash_id") == []


def test_names_match():
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_stream(spark, rows, tmp_path):
    from loomwire.streaming import feeds

    df = frame(spark, dict(hash_id="a"), dict(hash_id="a", item_ord=1), dict(hash_id="b"))
    df.write.parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    feeds.save_new(feeds.read_items(spark, f"{tmp_path}/in", df.schema), lambda x: x.write.mode("append").parquet(out), f"{tmp_path}/state").awaitTermination()
    assert rows(spark.read.parquet(out), "hash_id", "item_ord") == [("a", 0), ("b", 0)]
    assert feeds.distinct_items(feeds.read_items(spark, f"{tmp_path}/in", df.schema)).isStreaming


@pytest.mark.parametrize("name", sorted(listings.LISTINGS))
def test_every_listing_has_a_query(name):
    assert f"listing_{name}" in queries.QUERIES
