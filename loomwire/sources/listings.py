"""Listing pages and feeds as rows.

A listing is described by a row pattern, where the link is looked for around each match, and
filters. One Arrow map runs any of these descriptions, since the offsets of all matches, which
the windows need, are not to be had from built-in functions. Feeds have no windows and are
parsed by built-in expressions alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire.functions.text import html_unescape, strip_tags_listing, trim
from loomwire.functions.urls import is_article_url

_SITE = r"(?:https://www\.bbc\.com)?"


@dataclass(frozen=True)
class Listing:
    """How the rows of a listing page are found.

    ``row`` has the title in its group ``title``, and the link in ``link`` unless ``windows`` says
    where to look: (signed reach in characters, pattern, whether the first match is taken instead of
    the last), tried in order. ``time`` looks forward from the end of the row."""

    row: str
    windows: tuple[tuple[int, str, bool], ...] = ()
    inside: tuple[str, ...] = ()
    prefix: str = ""
    category: str = "international"
    categories: tuple[tuple[str, str], ...] = ()
    shortest: int = 10
    longest: int | None = None
    cap: int | None = None
    once: str = "url"
    time: tuple[int, str] | None = None
    times: str | None = None
    drop: str | None = None
    suffixes: tuple[str, ...] = ()
    skip_link: str | None = None
    need: str | None = None


# The page structures of the known sites.
LISTINGS = {
    "cards": Listing(
        row=r'<h2[^>]*data-testid="card-headline"[^>]*>(?P<title>.*?)</h2>',
        windows=(
            (-5000, rf'<a[^>]*href="({_SITE}/(?:news|sport)/(?:articles|videos|live|[a-z0-9_-]+/articles)/[^"]+)"', False),
            (2000, rf'<a[^>]*href="({_SITE}/(?:news|sport)/(?:articles|videos|live|[a-z0-9_-]+/articles)/[^"]+)"', False),
            (-5000, rf'<a[^>]*href="({_SITE}/(?:news|sport)/[^"]+)"', False),
        ),
        prefix="https://www.bbc.com",
    ),
    "sport_links": Listing(
        row=rf'href="(?P<link>{_SITE}/sport/[^"]+/articles/[^"]+)"[^>]*>(?P<title>.*?)</a>', prefix="https://www.bbc.com", once="link",
        categories=(("football", "football"), ("formula1", "f1")),
    ),
    "spans": Listing(
        row=r'class="[^"]*container__headline[^"]*"[^>]*>(?P<title>.*?)</span>', windows=((-3000, r'<a[^>]*href="(/20\d{2}/\d{2}/\d{2}/[^"]+)"', False),), skip_link="/live-news/",
        prefix="https://edition.cnn.com", shortest=20, cap=50, drop=r"^(?:[.{@]|function|var |const )|\{|padding|margin",
    ),
    "headings": Listing(row=r"<h2[^>]*>(?P<title>.*?)</h2>", windows=((-2000, r'href="(https://www\.marca\.com/[^"]+)"', False),), category="realmadrid", shortest=15, once="url and title", need=r"(?i)/real[-_]madrid/"),
    "article_links": Listing(row=r'href="(?P<link>/en/latest/article/[^"]+)"[^>]*>(?P<title>.*?)</a>', prefix="https://www.formula1.com", category="f1", shortest=11, once=""),
    "dated_links": Listing(row=r'href="(?P<link>https://techcrunch\.com/20\d{2}/\d{2}/\d{2}/[^"]+)"[^>]*>(?P<title>.*?)</a>', category="ai", time=(500, r'<time[^>]*datetime="([^"]+)"')),
    "numbered": Listing(
        row=r"<h2[^>]*>(?P<title>.*?)</h2>", windows=((-3000, r'<a[^>]*href="(/newsDetail_forward_\d+)"', False),), prefix="https://www.thepaper.cn", category="shenzhen", longest=200, cap=30,
        drop=r"^(?:推荐|热榜|视频|专题|广告)$", times=r'"contId":"?(\d+)"?[^}]{0,800}"pubTime":"([^"]*?)"',
    ),
    "titled": Listing(
        row=r'class="[^"]*title[^"]*"[^>]*>\s*(?P<title>.{15,200}?)\s*</', windows=((-3000, r'<a[^>]*href="((?:https?://static\.nfnews\.com/content/|/content/)[^"]+)"', False),),
        prefix="https://www.nfnews.com", category="shenzhen", cap=30, suffixes=(r"\s+(?:南方\+|南方\S*周刊|南方周末)\s*$", r"\s+\d{2}:\d{2}\s*$"),
    ),
    "linked_headings": Listing(
        row=r"<h2[^>]*>(?P<title>.*?)</h2>", inside=(r'<a[^>]*href="(https?://www\.racefans\.net/\d{4}/\d{2}/\d{2}/[^"]+)"', r'<a[^>]*href="(https?://[^"]+)"'), category="f1", drop="(?i)caption",
    ),
}


def find_rows(html: str, spec: Listing) -> list[tuple[str, str, str, str, str]]:
    """(title markup, url, time, category, link) of every match in document order; nothing filtered yet."""
    times = dict(re.findall(spec.times, html)) if spec.times else {}
    out = []
    for m in re.finditer(spec.row, html, re.S):
        title = m["title"] or ""
        link = m.groupdict().get("link") or ""
        for pattern in spec.inside:
            link = link or next((x[1] for x in [re.search(pattern, title)] if x), "")
        for reach, pattern, first in spec.windows:
            if link:
                break
            part = html[max(0, m.start() + reach) : m.start()] if reach < 0 else html[m.start() : m.start() + reach]
            links = [x for x in re.findall(pattern, part) if not (spec.skip_link and spec.skip_link in x)]
            link = (links[0] if first else links[-1]) if links else ""
        when = ""
        if spec.time:
            t = re.search(spec.time[1], html[m.end() : m.end() + spec.time[0]])
            when = t[1] if t else ""
        elif spec.times:
            when = times.get(link.rpartition("_")[2], "")
        category = next((c for word, c in spec.categories if word in link), spec.category)
        url = link if link.startswith("http") or not link else spec.prefix + link
        out.append((title, url, when, category, link))
    return out


def parse_listing(pages: DataFrame, name: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key``, item_ord (from 0), title, url, time, category of a listing's rows.

    Within a page the first of equal links (or titles, as the listing says) counts, then its cap.
    Pages that are null or hold no row give none.
    """
    spec = LISTINGS[name]
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("title", "url", "time", "category", "link")
        for b in batches:
            rows = [find_rows(h, spec) if h else [] for h in b.column("h").to_pylist()]
            at = pa.array([i for i, r in enumerate(rows) for _ in r], pa.int64())
            pos = pa.array([n for r in rows for n in range(len(r))], pa.int32())
            flat = [x for r in rows for x in r]
            yield pa.RecordBatch.from_arrays([b.column("k").take(at), pos, *(pa.array([x[i] for x in flat], pa.string()) for i in range(5))], ["k", "pos", *fields])

    rows = pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInArrow(run, f"k {kind}, pos int, title string, url string, time string, category string, link string")
    title = strip_tags_listing(F.col("title"))
    for s in spec.suffixes:
        title = trim(F.regexp_replace(title, s, ""))
    rows = rows.withColumn("title", title).where(F.length("title") >= spec.shortest)
    if spec.longest:
        rows = rows.where(F.length("title") <= spec.longest)
    if spec.drop:
        rows = rows.where(~F.col("title").rlike(spec.drop))
    rows = rows.where((F.col("url") != "") & is_article_url(F.col("url")))
    if spec.need:
        rows = rows.where(F.col("url").rlike(spec.need))
    # one struct per page keeps the order without a window over all pages
    page = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "url", "time", "category", "link"))).alias("rows"))
    kept = F.col("rows")
    if spec.once:
        parts = {"url": ("url",), "link": ("link",), "url and title": ("url", "title")}[spec.once]

        def fresh(acc: Column, r: Column) -> Column:
            seen = _has(acc, r, parts[0])
            for p in parts[1:]:
                seen = seen | _has(acc, r, p)
            return F.when(seen, acc).otherwise(F.concat(acc, F.array(r)))

        kept = F.aggregate(kept, F.slice(kept, 1, 0), fresh)
    if spec.cap:
        kept = F.slice(kept, 1, spec.cap)
    return page.select(F.col("k").alias(key), F.posexplode(kept).alias("item_ord", "r")).select(key, "item_ord", "r.title", "r.url", "r.time", "r.category")


def _has(acc: Column, r: Column, field: str) -> Column:
    return F.exists(acc, lambda a: a[field] == r[field])


def parse_feed(feeds: DataFrame, key: str = "page_id", xml: str = "html", category: str = "international") -> DataFrame:
    """``key``, item_ord, title, url, time, category, raw of the items of RSS feeds: titles of more than
    five characters with a link; raw is a description of more than 40 characters."""
    items = feeds.select(F.col(key).alias("k"), F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<item>(.*?)</item>"), 1)).alias("pos", "item"))

    def field(name: str) -> Column:
        return trim(F.regexp_extract("item", rf"(?s)<{name}>(.*?)</{name}>", 1))

    def bare(x: Column) -> Column:
        return F.regexp_replace(x, r"(?s)^<!\[CDATA\[(.*?)\]\]>$", "$1")

    text = trim(strip_tags_listing(F.regexp_replace(bare(field("description")), r"""(?i)<a[^>]*class=['"]more['"][^>]*>.*?</a>""", "")))
    rows = items.select("k", "pos", html_unescape(bare(field("title"))).alias("title"), field("link").alias("url"), field("pubDate").alias("time"), F.lit(category).alias("category"), F.when(F.length(text) > 40, text).alias("raw"))
    rows = rows.where((F.length("title") > 5) & (F.col("url") != ""))
    return rows.select(F.col("k").alias(key), F.col("pos").alias("item_ord"), "title", "url", "time", "category", "raw")
