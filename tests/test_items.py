from datetime import datetime, timedelta

import pytest

from loomwire import ai, config
from loomwire.functions.urls import canonical_url  # noqa: F401
from loomwire.operators import digest, items, pages
from loomwire.schema import ITEM, validate

AS_OF = datetime(2025, 6, 3, 12)
ROW = dict(hash_id="h", url="https://a.example/1", title="A title", source_date=AS_OF, source_name="S", category="ai", bullets=["a first bullet", "a second bullet"], raw="r", created_at=AS_OF, source_ord=0, item_ord=0)


def frame(spark, *changes):
    rows = [{**ROW, **c} for c in changes]
    return spark.createDataFrame([tuple(r[f] for f in ITEM.names) for r in rows], ITEM)


def test_recency_bounds(spark, rows):
    df = frame(spark, *[dict(hash_id=n, source_date=d) for n, d in (("on", AS_OF - timedelta(hours=24)), ("out", AS_OF - timedelta(hours=24, milliseconds=1)), ("future", AS_OF + timedelta(days=9)), ("none", datetime(1970, 1, 1)))])
    assert rows(items.filter_recency(df, AS_OF), "hash_id") == [("future",), ("on",)]
    assert ("none",) in rows(items.filter_recency(df, AS_OF, keep_undated=True), "hash_id")


def test_history_drops_text(spark, rows):
    df = items.history_window(frame(spark, {}, dict(category="f1", hash_id="x")), ["ai"], AS_OF)
    assert "raw" not in df.columns and rows(df, "hash_id") == [("h",)]


def test_drop_known_by_category(spark, rows):
    new = frame(spark, dict(hash_id="a"), dict(hash_id="b"), dict(hash_id="a", category="f1"))
    assert rows(items.drop_known(new, frame(spark, dict(hash_id="a"))), "category", "hash_id") == [("ai", "b"), ("f1", "a")]
    assert items.drop_known(new, None).count() == 3


def test_first_wins_and_truncate(spark, rows):
    df = frame(spark, *[dict(hash_id=str(i), item_ord=i, source_date=AS_OF + timedelta(hours=i), url=f"https://a.example/{i % 4}?utm_x=1") for i in range(7)])
    assert rows(items.truncate(df, 5), "hash_id") == [(str(i),) for i in range(5)]
    assert rows(items.distinct_by_url(df), "hash_id") == [("0",), ("1",), ("2",), ("3",)]


def test_upsert_is_idempotent(spark, rows):
    store, new = frame(spark, dict(hash_id="a", title="old"), dict(hash_id="b")), frame(spark, dict(hash_id="a", title="new"), dict(hash_id="a", title="later", item_ord=1), dict(hash_id="c"))
    once = items.upsert(store, new)
    assert rows(once, "hash_id", "title") == [("a", "new"), ("b", "A title"), ("c", "A title")]
    assert rows(items.upsert(once, new), "hash_id", "title") == rows(once, "hash_id", "title")


def test_resolve_links(spark, rows):
    g = "https://news.google.com/rss/articles/"
    df = spark.createDataFrame([("f", i, u) for i, u in enumerate([g + "a", g + "b", "https://p.example/x", g + "c"])], "source_key string, item_ord int, url string")
    known = spark.createDataFrame([(g + "a", "https://p.example/a"), (g + "b", None), (g + "c", "https://p.example/c")], "url string, target string")
    assert rows(items.resolve_links(df, known, most=3), "url") == [("https://p.example/a",), ("https://p.example/x",)]


def test_merge_status(spark):
    ok = lambda *v: items.merge_status(spark.createDataFrame([(x,) for x in v], "ok boolean")).first()[0]
    assert ok(True, True) and not ok(True, None) and not ok(True, False)


def test_validation(spark):
    with pytest.raises(ValueError, match="title is missing"):
        validate(frame(spark, {}).drop("title"), ITEM)


def test_extractors(spark):
    p = "<p>" + "word " * 12 + "</p><p>short</p>"
    df = spark.createDataFrame([(p, "generic"), ('<div data-component="text-block"><p>x</p></div>' + p, "text_blocks"), ("<div data-component-name=\"paragraph\">" + "w" * 60 + "</div>", "component"), (None, "generic")], "h string, x string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(pages.extract_body(F.col("h"), F.col("x"))).collect()]
    assert got == [("word " * 12).strip(), "x", "w" * 60, ""]
    many = "<p>" + "y" * 41 + "</p>"
    assert spark.createDataFrame([(many * 120,)], "h string").select(F.size(F.split(pages.generic(F.col("h")), "\n\n"))).first()[0] == 100


def test_routes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("BBC", "x"), ("?", "https://edition.cnn.com/a"), ("?", "https://www.ft.com/a"), ("Motorsport.com", "https://a.example"), ("?", "https://a.example/")], "s string, u string")
    assert [r[0] for r in df.select(pages.route(F.col("s"), F.col("u"))).collect()] == ["text_blocks", "component", None, None, "generic"]


def test_split_message():
    assert digest.split_message("a \n\n\n b", 4000) == ["a \n\n\n b"]
    assert digest.split_message("aaaa\n\nbbbb", 5) == ["aaaa", "bbbb"]
    assert digest.split_message("x" * 12, 5) == ["x" * 12]
    long = "\n\n".join("word " * n for n in (3, 40, 2, 100)) + "\n" + "z" * 70
    parts = digest.split_message(long, 50)
    assert all(len(p) <= 50 or " " not in p for p in parts) and "".join(parts).replace("\n", "").replace(" ", "") == long.replace("\n", "").replace(" ", "")


def test_digest(spark):
    df = frame(spark, dict(title="B.", source_date=AS_OF), dict(hash_id="n", title="No bullets", bullets=None), dict(hash_id="l", title="Later", source_date=AS_OF + timedelta(hours=1), item_ord=1))
    known = spark.createDataFrame([("ai",), ("f1",)], "category string")
    text = digest.format_digest(df, known, AS_OF).first()[0]
    assert text == "📰 *News Digest \\| 06/03/2025 12:00 🤖🏎️*\n\n🤖 *AI & Tech*\n• *Later* 6/3, 13:00 [S](https://a.example/1)\n  • a first bullet\n  • a second bullet\n\n• *B\\.* 6/3, 12:00 [S](https://a.example/1)\n  • a first bullet\n  • a second bullet"


class Counting:
    def __init__(self, reply):
        self.reply = reply

    def ask(self, prompts):
        return [self.reply] * len(prompts)


def test_event_dedupe(spark, rows):
    two, none = frame(spark, dict(hash_id="a"), dict(hash_id="b")), frame(spark)
    assert rows(ai.dedupe_by_event(two, none, Counting('{"ids": ["a", "unknown"]}')), "hash_id") == [("b",)]
    # one item without history is not asked
    assert rows(ai.dedupe_by_event(frame(spark, {}), none, Counting("not json")), "hash_id") == [("h",)]
    with pytest.raises(Exception, match="unsound"):
        ai.dedupe_by_event(two, none, Counting('{"ids": 1}')).count()


def test_summaries_by_id_or_position(spark, rows):
    two = frame(spark, dict(hash_id="a"), dict(hash_id="b", item_ord=1))
    said = lambda *ids: '{"items": [' + ",".join(f'{{"hash_id": "{i}", "title": "T{n}", "bullets": ["ten characters", "ten characters"]}}' for n, i in enumerate(ids)) + "]}"
    assert rows(ai.summarize(two, Counting(said("x", "y"))), "hash_id", "title") == [("a", "T0"), ("b", "T1")]
    assert rows(ai.summarize(two, Counting(said("b", "a"))), "hash_id", "title") == [("a", "T1"), ("b", "T0")]
    assert rows(ai.summarize(two, Counting(said("x"))), "hash_id", "title") == [("a", "A title"), ("b", "A title")]


def test_repair_json():
    assert ai.repair_json('Sure: ```json\n{"ids": ["a",]}\n```') == '{"ids": ["a"]}'
    assert ai.repair_json('{"ids": ["a"') == '{"ids": ["a"]}'


def test_config(tmp_path):
    f = tmp_path / ".env"
    f.write_text("categories = ai, f1\nchannels=c\n# no\ndebug=false\nsend_chunk_size=100\n")
    c = config.load_config(str(f))
    assert c["categories"] == ["ai", "f1"] and c["error_channels"] == [""] and c["debug"] is True and c["send_chunk_size"] == 100
    with pytest.raises(ValueError, match="channels"):
        config.load_config({"categories": "ai"})
    with pytest.raises(ValueError, match="truncate"):
        config.load_config({"categories": "ai", "channels": "c", "truncate_max_items_per_category": "0"})
