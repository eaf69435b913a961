"""Queries of the core operators over the test tables, and their SQL.

Every query runs over its whole tables. Markup, feeds and replies, which the tables do not hold,
are built from their columns inside the query.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire import ai, dims
from loomwire.functions import dates, text, urls
from loomwire.operators import digest, fetch, items, pages, timestamps
from loomwire.plans.news import digest_of
from loomwire.scratch import materialize, new_folder
from loomwire.session import table
from loomwire.sources import listings
from loomwire.streaming import feeds

AS_OF = datetime(2025, 10, 1, tzinfo=timezone.utc)
AS_OF_US = int(AS_OF.timestamp() * 1_000_000)
HOUR_US = 3_600_000_000


def _news(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "brief_news")


# --- relational operators -------------------------------------------------------------------


def filter_recency(spark: SparkSession, d: str) -> DataFrame:
    return items.filter_recency(_news(spark, d), AS_OF).select("item_id")


def history_window(spark: SparkSession, d: str) -> DataFrame:
    return items.history_window(_news(spark, d), ["ai", "f1", "football"], AS_OF, 3).select("item_id", "hash_id", "category")


def dedupe_by_id(spark: SparkSession, d: str) -> DataFrame:
    return items.drop_known(table(spark, d, "batch_item"), _news(spark, d)).select("batch_item_id")


def first_wins_canonical(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_item")
    return items.first_wins(raw.select("raw_id", "category", "url"), ["category", urls.canonical_url(F.col("url"))], ["raw_id"]).select("raw_id")


def exact_text_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return items.first_wins(docs, ["h"], ["doc_id"]).select("doc_id")


def truncate_per_category(spark: SparkSession, d: str) -> DataFrame:
    return items.truncate(_news(spark, d).select("category", "item_id", "source_ord", "item_ord"), 5, order=("source_ord", "item_ord", "item_id")).select("category", "item_id")


def save_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = _news(spark, d).select("item_id", "hash_id", "category", "created_at")
    first = items.first_wins(rows, ["hash_id"], ["item_id"])
    changes = rows.where(F.col("created_at") >= F.lit(AS_OF))
    return items.upsert(first, changes, order=("item_id",)).select("hash_id", "item_id")


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return items.category_counts(_news(spark, d))


def merge_status(spark: SparkSession, d: str) -> DataFrame:
    return items.merge_status(_news(spark, d).select((F.length("hash_id") == 64).alias("ok")))


def resolve_links(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_item").select("raw_id", F.col("source_name").alias("source_key"), F.col("raw_id").alias("item_ord"), "url")
    token = F.concat(F.lit("https://news.google.com/rss/articles/"), F.col("raw_id").cast("string"))
    links = raw.withColumn("url", F.when(F.col("raw_id") % 3 == 0, token).otherwise(F.col("url")))
    known = raw.where("raw_id % 6 = 0").select(token.alias("url"), F.col("url").alias("target"))
    return items.resolve_links(links, known).select("raw_id")


def source_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "category_dim").select("category", digest.category_order(F.col("category")).alias("place"))


# --- URLs, text, dates ----------------------------------------------------------------------


def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_item").select("raw_id", urls.canonical_url(F.col("url")).alias("canonical"))


def hash_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_item").select("raw_id", urls.hash_id(F.col("url"), F.col("source_name"), F.col("title")).alias("hash_id"))


def is_article_url(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "raw_item").select(F.col("raw_id").alias("id"), "url")
    b = table(spark, d, "source_registry").select((-1 - F.col("source_ord")).cast("bigint").alias("id"), "url")
    return a.unionByName(b).select("id", urls.is_article_url(F.col("url")).alias("ok"))


def aggregator_links(spark: SparkSession, d: str) -> DataFrame:
    link = F.concat(F.lit("https://news.google.com/"), F.when(F.col("raw_id") % 2 == 0, "rss/articles/").otherwise("topics/"), F.col("raw_id").cast("string"), F.lit("?oc=5"))
    return table(spark, d, "raw_item").select("raw_id", urls.article_token(link).alias("token"), urls.is_publisher_url(F.col("url")).alias("usable"), urls.is_publisher_url(link).alias("usable_link"))


def html_unescape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "batch_item").select("batch_item_id", text.html_unescape(F.col("title")).alias("title"))


def _markup(column: str) -> Column:
    return F.concat(F.lit(" <b>"), F.col(column), F.lit("</b>&mdash;<i class='x'>"), F.col(column), F.lit("</i>\n")).alias("m")


def strip_tags_listing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "batch_item").select("batch_item_id", text.strip_tags_listing(_markup("title")).alias("t"))


def strip_tags_body(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "batch_item").select("batch_item_id", text.strip_tags_body(_markup("title")).alias("t"))


def collapse_ws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(text.collapse_whitespace(F.col("text")), 256).alias("h"))


def escape_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _news(spark, d).select("item_id", text.escape_markdown(F.col("title")).alias("t"))


def parse_source_date(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    rfc = F.concat(F.date_format("ts", "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    forms = F.when(F.col("o_orderkey") % 4 == 0, rfc).when(F.col("o_orderkey") % 4 == 1, F.concat(iso, F.lit("Z"))).when(F.col("o_orderkey") % 4 == 2, F.date_format("ts", "yyyy-MM-dd HH:mm")).otherwise("soon")
    return o.select("o_orderkey", F.unix_micros(dates.parse_source_date(forms)).alias("us"))


def extract_time(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("published_at is not null")
    iso, local = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")
    forms = (
        ('<script>{"datePublished": "', iso, '"}</script>'), ("datePublished&quot;:&quot;", iso, "&quot;"), ("<meta name='datePublished' content='", iso, "'>"), ('<meta property="article:published_time" content="', iso, '">'),
        ('<meta name="pubdate" content="', iso, '">'), ('<time class="a" datetime="', iso, '">'), ('{"pubTime":"', local, '"}'), ('<i class="source-time">', F.replace(local, F.lit("-"), F.lit("/")), "</i>"),
    )
    own = F.lit("")
    for i, (before, stamp, after) in enumerate(forms):
        own = F.when(F.col("doc_id") % len(forms) == i, F.concat(F.lit(before), stamp, F.lit(after))).otherwise(own)
    # an unreadable match of the first pattern, and one of the last that comes too late
    page = F.concat(F.lit("<p>"), own, F.lit('</p><i class="source-time">never</i>'))
    page = F.when(F.col("doc_id") % len(forms) > 0, F.concat(F.lit('{"datePublished": "soon"}'), page)).otherwise(page)
    return docs.select("doc_id", F.unix_micros(dates.extract_time(page)).alias("us"))


def source_date_repair(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.timestamp_micros(F.lit(0).cast("bigint"))).otherwise(F.col("ts").cast("timestamp")).alias("d"), F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("f"))
    return e.select("event_id", F.unix_micros(dates.repair_source_date(F.col("d"), F.col("f"), F.lit(AS_OF))).alias("us"))


# --- pages, listings, feeds -----------------------------------------------------------------


def _page() -> Column:
    lines = F.regexp_replace(F.replace(F.replace(F.col("text"), F.lit("<"), F.lit("")), F.lit("&"), F.lit("&amp;")), "\n+", "</p>\n<p class='x'>")
    return F.concat(F.lit('<html><div class="article-content main"><p>'), lines, F.lit("</p></div></html>"))


def _body(extract: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = table(spark, d, "documents").where("text is not null")
        return docs.select("doc_id", F.sha2(extract(_page()), 256).alias("h"))

    run.__name__ = f"extract_{extract.__name__}"
    return run


# How each marked page begins, what stands around its paragraphs, and how it ends; every line of a text is a paragraph.
MARKED = {
    "text_blocks": ("<main>", '<div data-component="text-block"><p>', "</p></div>", "</main>"),
    "component": ("<main>", '<div data-component-name="paragraph" class="p">', "</div>", "</main>"),
    "article_content": ('<div class="big article-content">', "<p>", "</p>", "</article>"),
    "body_container": ('<div class="ms-article__body x">', "<p>", "</p>", "</div>"),
}


def _marked(name: str) -> Callable[[SparkSession, str], DataFrame]:
    head, begin, end, tail = MARKED[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = table(spark, d, "documents").where("text is not null")
        lines = F.regexp_replace(F.replace(F.replace(F.col("text"), F.lit("<"), F.lit("")), F.lit("&"), F.lit("&amp;")), "\n+", f"{end}\n{begin}")
        page = F.concat(F.lit(head + begin), lines, F.lit(end + tail + "<p>A paragraph of the page that is not of the article at all.</p>"))
        return docs.select("doc_id", F.sha2(pages.EXTRACTORS[name](page), 256).alias("h"))

    run.__name__ = f"extract_{name}_marked"
    return run


def route_extractor(spark: SparkSession, d: str) -> DataFrame:
    known = [(n, f"https://x.example/{i}") for i, n in enumerate(dims.EXTRACTOR_BY_NAME)] + [("?", f"https://{h}/a") for h in dims.EXTRACTOR_BY_HOST] + [("?", "https://www.ft.com/a")]
    extra = spark.createDataFrame(known, "source_name string, url string")
    rows = _news(spark, d).select("source_name", "url").unionByName(extra)
    return rows.select(F.coalesce(pages.route(F.col("source_name"), F.col("url")), F.lit("skipped")).alias("extractor")).groupBy("extractor").agg(F.count(F.lit(1)).alias("n"))


def read_items(spark: SparkSession, d: str) -> DataFrame:
    rows = _news(spark, d).where("raw_id is not null").select("item_id", "url", "source_name", "source_date", F.lit("feed text").alias("raw"))
    snap = rows.where("item_id % 2 = 0").select("url", F.concat(F.lit("<p>"), F.repeat(F.lit("word "), F.lit(12)), F.col("item_id").cast("string"), F.lit("</p>")).alias("html"))
    snap = snap.groupBy("url").agg(F.min("html").alias("html"))
    return pages.read_items(rows, snap, F.lit(AS_OF)).select("item_id", (F.col("raw") == "feed text").alias("kept"))


def _feed() -> Column:
    clean = F.replace(F.coalesce("title", F.lit("")), F.lit("]]>"), F.lit(""))
    return F.concat(
        F.lit("<rss><item><title><![CDATA["), clean, F.lit("]]></title><link> "), F.col("url"), F.lit(" </link><pubDate>"), F.coalesce("time", F.lit("")),
        F.lit("</pubDate><description>"), F.repeat(F.col("source_name"), F.lit(4)), F.lit("<a class='more' href='x'>Keep reading</a></description></item><item><title>tiny</title><link>x</link></item></rss>"),
    )


def fetch_items(spark: SparkSession, d: str) -> DataFrame:
    item = "<item><title>A story title</title><link>https://x.example/{}</link></item>"
    registry = table(spark, d, "source_registry")
    html = F.concat(F.replace(F.lit(item.format("@")), F.lit("@"), F.col("source_key")), F.lit(item.format("shared")))
    # listing pages of the two structures in the table; their rows count only in the category that the structure is of
    spans = '<a href="/2025/06/03/world/@"><span class="container__headline-text">A headline of the source @</span></a>'
    headings = '<a href="https://www.marca.com/futbol/real-madrid/@.html"></a><h2 class="t">A headline of the source @</h2>'
    listing = F.replace(F.when(F.col("parser") == "spans", spans).when(F.col("parser") == "headings", headings), F.lit("@"), F.col("source_key"))
    snap = registry.select("url", F.when(F.col("kind") == "rss", html).otherwise(listing).alias("html"))
    return fetch.fetch_items(registry, snap, AS_OF).select("category", "url")


def rss_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_item").select("raw_id", _feed().alias("xml"))
    return listings.parse_feed(rows, "raw_id", "xml").select("raw_id", "item_ord", "url", "raw")


def _listing(name: str, parts: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "raw_item").select("raw_id", _markup_of(parts).alias("html"))
        return listings.parse_listing(rows, name, "raw_id").select("raw_id", "item_ord", "title", "url", "time", "category")

    run.__name__ = f"listing_{name}"
    return run


def _markup_of(parts: str) -> Column:
    """A page of five rows from a pattern in which @ stands for a number and ^ for a title: a row, text that is
    no row, the same row again, one whose title is too short, and another row."""
    number = F.col("raw_id").cast("string")

    def row(n: Column, title: Column) -> Column:
        return F.replace(F.replace(F.lit(parts), F.lit("^"), title), F.lit("@"), n)

    first = row(number, F.concat(F.lit("A headline that is long enough no. "), number))
    return F.concat(first, F.lit("<p>Text between</p>"), first, row(F.concat(number, F.lit("5")), F.lit("Short")), row(F.concat(number, F.lit("7")), F.concat(F.lit("Another headline of length no. "), number)))


LISTING_PAGES = {
    "cards": '<a class="c" href="/news/articles/@"><h2 data-testid="card-headline">^</h2></a>',
    "sport_links": '<a href="/sport/football/articles/@" class="x"><span>^</span></a>',
    "spans": '<a href="/2025/06/03/world/@"><span class="container__headline-text">^</span></a>',
    "headings": '<a href="https://www.marca.com/futbol/real-madrid/@.html"></a><h2 class="t">^</h2>',
    "article_links": '<a href="/en/latest/article/@">^</a>',
    "dated_links": '<a href="https://techcrunch.com/2025/06/03/@/">^</a> <time datetime="2025-06-03T10:00:00Z">',
    "numbered": '{"contId":"@","x":1,"pubTime":"2025-06-03 10:00"}<a href="/newsDetail_forward_@"><h2>^</h2></a>',
    "titled": '<a class="l" href="/content/@.html"><div class="item-title">^ 南方周末</div></a>',
    "linked_headings": '<h2 class="t"><a href="https://www.racefans.net/2025/06/03/@/">^</a></h2>',
}
_LISTING_SQL = {
    "cards": ("'https://www.bbc.com/news/articles/' || raw_id", "''", "'international'"),
    "sport_links": ("'https://www.bbc.com/sport/football/articles/' || raw_id", "''", "'football'"),
    "spans": ("'https://edition.cnn.com/2025/06/03/world/' || raw_id", "''", "'international'"),
    "headings": ("'https://www.marca.com/futbol/real-madrid/' || raw_id || '.html'", "''", "'realmadrid'"),
    "article_links": ("'https://www.formula1.com/en/latest/article/' || raw_id", "''", "'f1'"),
    "dated_links": ("'https://techcrunch.com/2025/06/03/' || raw_id || '/'", "'2025-06-03T10:00:00Z'", "'ai'"),
    "numbered": ("'https://www.thepaper.cn/newsDetail_forward_' || raw_id", "'2025-06-03 10:00'", "'shenzhen'"),
    "titled": ("'https://www.nfnews.com/content/' || raw_id || '.html'", "''", "'shenzhen'"),
    "linked_headings": ("'https://www.racefans.net/2025/06/03/' || raw_id || '/'", "''", "'f1'"),
}


# --- digest, messages, AI -------------------------------------------------------------------


def _shown(spark: SparkSession, d: str) -> DataFrame:
    rows = _news(spark, d).select("item_id", "hash_id", "title", "url", "source_name", "source_date", "bullets", "category", "source_ord", "item_ord")
    return items.truncate(rows.where("bullets is not null"), 5, order=("source_ord", "item_ord", "item_id"))


def format_article(spark: SparkSession, d: str) -> DataFrame:
    return _news(spark, d).select("item_id", digest.format_article().alias("article"))


def format_section(spark: SparkSession, d: str) -> DataFrame:
    return digest.format_sections(_shown(spark, d))


def format_digest(spark: SparkSession, d: str) -> DataFrame:
    return digest.format_digest(_shown(spark, d), table(spark, d, "category_dim"), AS_OF)


def split_message(spark: SparkSession, d: str) -> DataFrame:
    return digest.message_chunks(table(spark, d, "documents"))


def reply_validate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit('{"items":[{"hash_id":"h'), F.col("doc_id").cast("string"), F.lit('","title":"t","bullets":['), F.array_join(F.array_repeat(F.lit('"ten chars and more"'), (F.col("doc_id") % 7).cast("int")), ","), F.when(F.col("doc_id") % 11 == 0, "").otherwise("]}]}")).alias("reply"))
    return docs.select("doc_id", ai.valid_summary(F.col("reply")).isNotNull().alias("ok"))


def reply_match_by_id_or_pos(spark: SparkSession, d: str) -> DataFrame:
    rows = items.first_wins(_shown(spark, d), ["category", "hash_id"], ["item_id"]).withColumnRenamed("item_ord", "o").withColumn("item_ord", (F.col("o").cast("bigint") * 10_000_000 + F.col("item_id")))
    ids = rows.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("source_ord", "item_ord", "hash_id"))).alias("r"))
    # every second id is given wrong and must be matched by its place
    said = F.transform("r", lambda r, i: F.struct(F.when(i % 2 == 0, r["hash_id"]).otherwise("?").alias("hash_id"), F.concat(F.lit("T"), i.cast("string")).alias("title"), F.array(F.lit("a bullet of ten"), F.lit("another bullet")).alias("bullets")))
    replies = ids.select("category", F.to_json(F.struct(said.alias("items"))).alias("reply"))
    return ai.match_replies(rows, replies).select("item_id", "title")


def dedupe_by_event(spark: SparkSession, d: str) -> DataFrame:
    cols = ["hash_id", "title", "category", "source_ord", "item_ord"]
    new = items.drop_known(table(spark, d, "batch_item").select("batch_item_id", *cols), _news(spark, d))
    return ai.dedupe_by_event(new, _news(spark, d).select(*cols), ai.FakeAIClient(ai.same_titles)).select("batch_item_id")


def pipeline_flagship(spark: SparkSession, d: str) -> DataFrame:
    rows = _news(spark, d).where("bullets is not null").drop("raw", "raw_id")
    old = rows.where(F.col("created_at") < F.lit(AS_OF))
    return digest_of(rows, old, AS_OF, hours=24 * 90, n=5)


def stream_to_store(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "stream")
    schema = _news(spark, d).schema
    query = feeds.save_new(feeds.read_items(spark, f"{d}/brief_news.parquet", schema), lambda df: df.select("item_id", "category", "hash_id").write.mode("append").parquet(f"{folder}/rows"), f"{folder}/state", ("item_id",))
    query.awaitTermination()
    kept = spark.read.parquet(f"{folder}/rows")
    return items.first_wins(kept, ["category", "hash_id"], ["item_id"]).select("item_id")


# --- problem 6 ------------------------------------------------------------------------------


def p6_times(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise_times(table(spark, d, "raw_item"), table(spark, d, "source_profile"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    times = materialize(p6_times(spark, d).where("epoch_us is not null").select("raw_id", "epoch_us"), "times")
    listed = times.select(F.lit("raw_item").alias("table_name"), F.col("raw_id").alias("row_id"), "epoch_us")
    wrong = timestamps.wrong_dates(_news(spark, d), times)
    return listed.unionByName(wrong.select(F.lit("brief_news").alias("table_name"), F.col("item_id").alias("row_id"), "epoch_us"))


_BODIES = [_body(f) for f in (pages.generic, pages.long, pages.text_blocks, pages.component, pages.article_content, pages.body_container)]
_LISTINGS = [_listing(n, p) for n, p in LISTING_PAGES.items()]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        pipeline_flagship, filter_recency, history_window, dedupe_by_id, first_wins_canonical, exact_text_dedupe, truncate_per_category, save_upsert, category_counts, merge_status,
        resolve_links, source_order, canonical_url, hash_id, is_article_url, aggregator_links, html_unescape, strip_tags_listing, strip_tags_body, collapse_ws, escape_markdown,
        parse_source_date, extract_time, source_date_repair, *_BODIES, *[_marked(n) for n in MARKED], route_extractor, read_items, fetch_items, rss_parse, *_LISTINGS,
        format_article, format_section, format_digest, split_message, reply_validate, reply_match_by_id_or_pos, dedupe_by_event, stream_to_store, p6_found, p6_times,
    )
}


# --- SQL ------------------------------------------------------------------------------------

_WS = r"[\t\n\x0b\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _unescape_sql(x: str) -> str:
    names = " ".join(f"WHEN lower(t) = '&{k};' THEN {_q(v)}" for k, v in text.ENTITIES.items())
    return rf"list_aggregate(list_transform(regexp_extract_all({x}, '&(?:#x?[0-9a-fA-F]+|[a-zA-Z]+);|[^&]+|&'), lambda t: CASE {names} ELSE t END), 'string_agg', '')"


def _canonical_sql(u: str) -> str:
    full = f"CASE WHEN contains({u}, '://') THEN {u} ELSE 'https://' || {u} END"
    host = rf"regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract({full}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':\d{{0,5}}$', '')), '^www\.', '')"
    path = rf"regexp_replace(regexp_extract({full}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"
    drop = ", ".join(map(_q, urls.DROPPED))
    pairs = rf"list_sort(list_filter(string_split(regexp_extract({full}, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND lower(regexp_replace(p, '=.*$', '')) NOT IN ({drop})))"
    return f"(lower(regexp_extract({full}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN len({pairs}) > 0 THEN '?' || array_to_string({pairs}, '&') ELSE '' END)"


_U = "trim(coalesce(url, ''))"
_PAGE_SQL = r"""'<html><div class="article-content main"><p>' || regexp_replace(replace(replace(text, '<', ''), '&', '&amp;'), '\n+', '</p>' || chr(10) || '<p class=''x''>', 'g') || '</p></div></html>'"""


def _strip_sql(x: str, by: str) -> str:
    return _unescape_sql(_trim_sql(f"regexp_replace({x}, '<[^>]+>', '{by}', 'g')"))


def _clean_sql(x: str) -> str:
    return _trim_sql(f"regexp_replace({_strip_sql(x, ' ')}, '{_WS}+', ' ', 'g')")


def _body_sql(blocks: str, keep: str, glue: str = "chr(10) || chr(10)", most: int = 100) -> str:
    s = f"coalesce({_strip_sql('b', ' ')}, '')"
    kept = f"list_filter({blocks}, lambda b: {keep.format(s=s)})"
    cleaned = f"list_transform({kept}, lambda b: coalesce({_clean_sql('b')}, ''))"
    return f"coalesce(array_to_string(list_slice({cleaned}, 1, {most}), {glue}), '')"


_PS = r"regexp_extract_all(page, '(?s)<p[^>]*>(.*?)</p>', 1)"
_GENERIC_SQL = _body_sql(_PS, "length({s}) > 40 AND length({s}) < 5000")
_LONG_SQL = _body_sql(_PS, "length({s}) > 50 AND length({s}) < 5000 AND NOT (contains(lower({s}), 'sign in') AND contains(lower({s}), 'subscribe'))")
_FULL_SQL = _body_sql(_PS, "length({s}) > 40", "' '", 20)
_ESC = r"regexp_replace({}, '([_*\[\]()~`>#+\-=|{{}}.!\\])', '\\\1', 'g')"
_DATE = _ESC.format("strftime(make_timestamp(epoch_us(source_date)), '%-m/%-d, %H:%M')")
_ARTICLE = f"""'• *' || {_ESC.format("title")} || '*' || CASE WHEN epoch_us(source_date) > 0 THEN ' ' || {_DATE} ELSE '' END || ' ' ||
 CASE WHEN coalesce(url, '') <> '' THEN '[' || {_ESC.format("source_name")} || '](' || url || ')' ELSE '_' || {_ESC.format("source_name")} || '_' END ||
 coalesce(array_to_string(list_transform(bullets, lambda b: chr(10) || '  • ' || {_ESC.format("b")}), ''), '')"""
_SHOWN = "(SELECT * FROM brief_news WHERE bullets IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY source_ord, item_ord, item_id) <= 5)"
_SIGN = "CASE category " + " ".join(f"WHEN {_q(c)} THEN {_q(s)}" for c, s in dims.CATEGORIES) + f" ELSE {_q(dims.FALLBACK_SIGN)} END"
_LABEL = "CASE category " + " ".join(f"WHEN {_q(c)} THEN {_q(n)}" for (c, _), n in zip(dims.CATEGORIES, dims.LABELS["English"])) + " ELSE category END"
_PLACE = "CASE category " + " ".join(f"WHEN {_q(c)} THEN {i}" for i, (c, _) in enumerate(dims.CATEGORIES, 1)) + f" ELSE {len(dims.CATEGORIES) + 1} END"


def _sections_sql(rows: str) -> str:
    order = "-epoch_us(source_date), source_ord, item_ord, hash_id"
    head = f"{_SIGN} || ' *' || {_ESC.format(_LABEL)} || '*' || chr(10)"
    return f"SELECT category, {head} || string_agg({_ARTICLE}, chr(10) || chr(10) ORDER BY {order}) AS section FROM {rows} WHERE len(bullets) > 0 AND title <> '' AND url <> '' AND source_name <> '' GROUP BY category"


_ARTICLE_URL = rf"""coalesce(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) IN ('http', 'https') AND NOT contains(h, 'news.google.com') AND regexp_replace(h, '^www\.', '') NOT IN ({", ".join(map(_q, urls.BLOCKED_HOSTS))})
 AND p NOT IN ({", ".join(map(_q, urls.HOME_PATHS))}) AND NOT regexp_matches(lower(p), '/search|/tag/|/category/|/topics/'), false)"""
_PARTS = r"""SELECT *, lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':\d{0,5}$', '')) AS h,
 CASE WHEN regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') END AS p"""
_MARKUP = "' <b>' || title || '</b>&mdash;<i class=''x''>' || title || '</i>' || chr(10)"
_NAMED = {k: v for k, v in dims.EXTRACTOR_BY_NAME.items() if k != "Motorsport.com"}
_ROUTED: dict[str, int] = {"skipped": 2}
for _e in [*_NAMED.values(), *dims.EXTRACTOR_BY_HOST.values()]:
    _ROUTED[_e] = _ROUTED.get(_e, 0) + 1



def _listing_sql(name: str, url: str, time: str, category: str) -> str:
    """The row of a page and the other one; a listing that does not look for repeats has the first twice."""
    one = f"'A headline that is long enough no. ' || raw_id AS title, {url} AS url"
    other = "'Another headline of length no. ' || raw_id AS title, " + url.replace("raw_id", "(raw_id || '7')") + " AS url"
    rows = [one, one, other] if not listings.LISTINGS[name].once else [one, other]
    return " UNION ALL ".join(f"SELECT raw_id, {i} AS item_ord, {x}, {time} AS time, {category} AS category FROM raw_item" for i, x in enumerate(rows))


def _marked_sql(name: str, blocks: str, keep: str, clean: bool = False) -> str:
    head, begin, end, tail = MARKED[name]
    lines = f"regexp_replace(replace(replace(text, '<', ''), '&', '&amp;'), '\\n+', {_q(end)} || chr(10) || {_q(begin)}, 'g')"
    page = f"{_q(head + begin)} || {lines} || {_q(end + tail + '<p>A paragraph of the page that is not of the article at all.</p>')}"
    body = _body_sql(blocks, keep)
    if clean:  # lengths are those of collapsed texts
        body = f"coalesce(array_to_string(list_slice(list_filter(list_transform({blocks}, lambda b: coalesce({_clean_sql('b')}, '')), lambda b: {keep.format(s='b')}), 1, 100), chr(10) || chr(10)), '')"
    rest = "" if name in ("text_blocks", "article_content") else f"WHEN {body} = '' THEN {_GENERIC_SQL} "
    return f"SELECT doc_id, sha256(CASE {rest}WHEN true THEN {body} END) AS h FROM (SELECT doc_id, {page} AS page FROM documents WHERE text IS NOT NULL)"


SQL: dict[str, str] = {
    "filter_recency": f"SELECT item_id FROM brief_news WHERE source_date IS NULL OR epoch_us(source_date) >= {AS_OF_US - 24 * HOUR_US}",
    "history_window": f"SELECT item_id, hash_id, category FROM brief_news WHERE category IN ('ai', 'f1', 'football') AND epoch_us(source_date) >= {AS_OF_US - 72 * HOUR_US}",
    "dedupe_by_id": "SELECT batch_item_id FROM batch_item b WHERE NOT EXISTS (SELECT 1 FROM brief_news n WHERE n.category = b.category AND n.hash_id = b.hash_id)",
    "first_wins_canonical": f"SELECT min(raw_id) AS raw_id FROM (SELECT raw_id, category, {_canonical_sql(_U)} AS c FROM raw_item) GROUP BY category, c",
    "exact_text_dedupe": "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text",
    "truncate_per_category": "SELECT category, item_id FROM brief_news QUALIFY row_number() OVER (PARTITION BY category ORDER BY source_ord, item_ord, item_id) <= 5",
    "save_upsert": f"SELECT hash_id, CASE WHEN min(CASE WHEN epoch_us(created_at) >= {AS_OF_US} THEN item_id END) IS NOT NULL THEN min(CASE WHEN epoch_us(created_at) >= {AS_OF_US} THEN item_id END) ELSE min(item_id) END AS item_id FROM brief_news GROUP BY hash_id",
    "category_counts": "SELECT category, count(*) AS n FROM brief_news GROUP BY category",
    "merge_status": "SELECT bool_and(coalesce(length(hash_id) = 64, false)) AS success FROM brief_news",
    "resolve_links": f"""SELECT raw_id FROM ({_PARTS} FROM (SELECT raw_id, CASE WHEN raw_id % 3 <> 0 THEN url WHEN n <= 5 AND raw_id % 6 = 0 THEN url END AS url
      FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY raw_id) AS n FROM raw_item))) WHERE url IS NOT NULL AND {_ARTICLE_URL}""",
    "source_order": f"SELECT category, {_PLACE} AS place FROM category_dim",
    "canonical_url": f"SELECT raw_id, {_canonical_sql(_U)} AS canonical FROM raw_item",
    "hash_id": f"SELECT raw_id, sha256({_canonical_sql(_U)}) AS hash_id FROM raw_item",
    "is_article_url": f"SELECT id, {_ARTICLE_URL} AS ok FROM ({_PARTS} FROM (SELECT raw_id AS id, url FROM raw_item UNION ALL SELECT CAST(-1 - source_ord AS BIGINT), url FROM source_registry))",
    "aggregator_links": "SELECT raw_id, CASE WHEN raw_id % 2 = 0 THEN CAST(raw_id AS VARCHAR) END AS token, regexp_matches(url, '^https?://') AS usable, false AS usable_link FROM raw_item",
    "html_unescape": f"SELECT batch_item_id, {_unescape_sql('title')} AS title FROM batch_item",
    "strip_tags_listing": f"SELECT batch_item_id, {_strip_sql(_MARKUP, '')} AS t FROM batch_item",
    "strip_tags_body": f"SELECT batch_item_id, {_strip_sql(_MARKUP, ' ')} AS t FROM batch_item",
    "collapse_ws": "SELECT doc_id, sha256(" + _trim_sql(f"regexp_replace(text, '{_WS}+', ' ', 'g')") + ") AS h FROM documents",
    "escape_markdown": f"SELECT item_id, {_ESC.format('title')} AS t FROM brief_news",
    "parse_source_date": f"SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN epoch_us(o_orderdate) // 1000000 * 1000000 WHEN 1 THEN epoch_us(o_orderdate) // 1000000 * 1000000 WHEN 2 THEN epoch_us(o_orderdate) // 60000000 * 60000000 - {8 * HOUR_US} ELSE 0 END AS BIGINT) AS us FROM orders",
    "extract_time": f"SELECT doc_id, epoch_us(published_at) // 1000000 * 1000000 - CASE WHEN doc_id % 8 >= 6 THEN {8 * HOUR_US} ELSE 0 END AS us FROM documents WHERE published_at IS NOT NULL",
    "source_date_repair": f"""SELECT event_id, CASE WHEN event_id % 5 = 0 AND event_id % 3 <> 0 THEN {AS_OF_US} WHEN event_id % 3 = 0 THEN epoch_us(ts) + {HOUR_US} ELSE epoch_us(ts) END AS us FROM events""",
    "extract_generic": f"SELECT doc_id, sha256({_GENERIC_SQL}) AS h FROM (SELECT doc_id, {_PAGE_SQL} AS page FROM documents WHERE text IS NOT NULL)",
    "extract_text_blocks": f"SELECT doc_id, sha256({_GENERIC_SQL}) AS h FROM (SELECT doc_id, {_PAGE_SQL} AS page FROM documents WHERE text IS NOT NULL)",
    "extract_component": f"SELECT doc_id, sha256({_GENERIC_SQL}) AS h FROM (SELECT doc_id, {_PAGE_SQL} AS page FROM documents WHERE text IS NOT NULL)",
    "extract_body_container": f"SELECT doc_id, sha256({_GENERIC_SQL}) AS h FROM (SELECT doc_id, {_PAGE_SQL} AS page FROM documents WHERE text IS NOT NULL)",
    "extract_long": f"SELECT doc_id, sha256({_LONG_SQL}) AS h FROM (SELECT doc_id, {_PAGE_SQL} AS page FROM documents WHERE text IS NOT NULL)",
    "extract_article_content": f"SELECT doc_id, sha256(CASE WHEN length({_clean_sql('x')}) > 20 THEN {_clean_sql('x')} ELSE '' END) AS h FROM (SELECT doc_id, {_FULL_SQL} AS x FROM (SELECT doc_id, {_PAGE_SQL} AS page FROM documents WHERE text IS NOT NULL))",
    "extract_text_blocks_marked": _marked_sql("text_blocks", "regexp_extract_all(page, '(?s)data-component=\"text-block\".*?<p[^>]*>(.*?)</p>', 1)", "{s} <> ''"),
    "extract_component_marked": _marked_sql("component", "regexp_extract_all(page, '(?s)data-component-name=\"paragraph\"[^>]*>(.*?)</div>', 1)", "length({s}) > 50 AND length({s}) < 5000", True),
    "extract_article_content_marked": _marked_sql("article_content", r"string_split_regex(regexp_extract(page, '(?s)class=\"big article-content\">(.*?)</article>', 1), '</p>\s*<p[^>]*>')", "length({s}) > 20", True),
    "extract_body_container_marked": _marked_sql("body_container", "regexp_extract_all(regexp_extract(page, '(?s)ms-article__body x\">(.*?)</div>', 1), '(?s)<p[^>]*>(.*?)</p>', 1)", "length({s}) > 40"),
    "route_extractor": "SELECT extractor, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'generic' AS extractor, count(*) AS n FROM brief_news UNION ALL VALUES " + ", ".join(f"({_q(e)}, {n})" for e, n in _ROUTED.items()) + ") GROUP BY extractor",
    "read_items": "SELECT item_id, NOT EXISTS (SELECT 1 FROM brief_news b WHERE b.url = a.url AND b.raw_id IS NOT NULL AND b.item_id % 2 = 0) AS kept FROM brief_news a WHERE raw_id IS NOT NULL",
    "fetch_items": "SELECT category, 'https://x.example/' || source_key AS url FROM source_registry WHERE kind = 'rss' UNION ALL SELECT DISTINCT category, 'https://x.example/shared' FROM source_registry WHERE kind = 'rss' UNION ALL SELECT category, 'https://edition.cnn.com/2025/06/03/world/' || source_key FROM source_registry WHERE parser = 'spans' AND category = 'international' UNION ALL SELECT category, 'https://www.marca.com/futbol/real-madrid/' || source_key || '.html' FROM source_registry WHERE parser = 'headings' AND category = 'realmadrid'",
    "rss_parse": f"SELECT raw_id, 0 AS item_ord, trim(url) AS url, CASE WHEN length({_trim_sql('repeat(source_name, 4)')}) > 40 THEN {_trim_sql('repeat(source_name, 4)')} END AS raw FROM raw_item WHERE length(coalesce({_unescape_sql('title')}, '')) > 5 AND url <> ''",
    **{f"listing_{n}": _listing_sql(n, *x) for n, x in _LISTING_SQL.items()},
    "format_article": f"SELECT item_id, {_ARTICLE} AS article FROM brief_news",
    "format_section": _sections_sql(_SHOWN),
    "format_digest": f"""WITH s AS ({_sections_sql(_SHOWN)}), c AS (SELECT coalesce(d.category, s.category) AS category, s.section FROM (SELECT DISTINCT category FROM category_dim) d FULL JOIN s ON d.category = s.category)
      SELECT '📰 *News Digest \\| ' || {_ESC.format(_q(AS_OF.strftime("%m/%d/%Y %H:%M")))} || ' ' || string_agg({_SIGN}, '' ORDER BY {_PLACE}, category) FILTER ({_PLACE} <= 8) || '*' || coalesce(chr(10) || chr(10) || string_agg(section, chr(10) || chr(10) ORDER BY {_PLACE}, category), '') AS text FROM c""".replace("\\\\|", "\\|"),
    "reply_validate": "SELECT doc_id, (doc_id % 7 BETWEEN 2 AND 5) AND doc_id % 11 <> 0 AS ok FROM documents",
    "reply_match_by_id_or_pos": f"SELECT item_id, 'T' || (row_number() OVER (PARTITION BY category ORDER BY source_ord, item_ord, item_id) - 1) AS title FROM (SELECT * FROM {_SHOWN} QUALIFY row_number() OVER (PARTITION BY category, hash_id ORDER BY item_id) = 1)",
    "dedupe_by_event": """SELECT batch_item_id FROM batch_item b WHERE NOT EXISTS (SELECT 1 FROM brief_news n WHERE n.category = b.category AND n.hash_id = b.hash_id)
      AND NOT EXISTS (SELECT 1 FROM batch_item o WHERE o.category = b.category AND o.hash_id = b.hash_id
        AND NOT EXISTS (SELECT 1 FROM brief_news n WHERE n.category = o.category AND n.hash_id = o.hash_id) AND EXISTS (SELECT 1 FROM brief_news n WHERE n.category = o.category AND n.title = o.title))""",
    "pipeline_flagship": _sections_sql(f"""(SELECT * FROM brief_news b WHERE bullets IS NOT NULL AND (source_date IS NULL OR epoch_us(source_date) >= {AS_OF_US - 24 * 90 * HOUR_US})
      AND NOT EXISTS (SELECT 1 FROM brief_news n WHERE n.bullets IS NOT NULL AND epoch_us(n.created_at) < {AS_OF_US} AND n.category = b.category AND n.hash_id = b.hash_id)
      QUALIFY row_number() OVER (PARTITION BY category ORDER BY source_ord, item_ord) <= 5)"""),
    "stream_to_store": "SELECT min(item_id) AS item_id FROM brief_news GROUP BY category, hash_id",
}
