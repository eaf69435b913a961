"""Body text of pages: seven extraction rules as expressions, and their routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire import dims
from loomwire.functions.dates import extract_time, repair_source_date
from loomwire.functions.text import collapse_whitespace, strip_tags_body
from loomwire.functions.urls import host, is_skipped

MAX_PARAGRAPHS = 100
_P = r"(?s)<p[^>]*>(.*?)</p>"


def _all(page: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(page, F.lit(pattern), 1), F.array().cast("array<string>"))


def _join(paragraphs: Column, most: int = MAX_PARAGRAPHS, between: str = "\n\n") -> Column:
    return F.array_join(F.slice(paragraphs, 1, most), between)


def _stripped(blocks: Column) -> Column:
    return F.transform(blocks, strip_tags_body)


def _collapsed(texts: Column) -> Column:
    return F.transform(texts, collapse_whitespace)


def _sized(texts: Column, least: int, most: int | None = 5000) -> Column:
    """Stripped, not yet collapsed texts that are longer than ``least`` and shorter than ``most``."""
    return F.filter(texts, lambda t: (F.length(t) > least) & (F.length(t) < most) if most else F.length(t) > least)


def _paragraphs(page: Column) -> Column:
    return _stripped(_all(page, _P))


def generic(page: Column) -> Column:
    """All paragraphs of more than 40 and fewer than 5,000 characters."""
    return _join(_collapsed(_sized(_paragraphs(page), 40)))


def long(page: Column) -> Column:
    """As generic from 50 characters, without the paragraphs that invite to sign in and subscribe."""
    kept = F.filter(_sized(_paragraphs(page), 50), lambda t: ~(F.lower(t).contains("sign in") & F.lower(t).contains("subscribe")))
    return _join(_collapsed(kept))


def text_blocks(page: Column) -> Column:
    """The first paragraph of each marked text block; all of generic's if no block is marked."""
    marked = F.when(page.contains('data-component="text-block"'), _all(page, r'(?s)data-component="text-block".*?<p[^>]*>(.*?)</p>')).otherwise(F.array().cast("array<string>"))
    texts = F.when(F.size(marked) > 0, _stripped(marked)).otherwise(_sized(_paragraphs(page), 40))
    return _join(F.filter(_collapsed(texts), lambda p: p != ""))


def component(page: Column) -> Column:
    """Elements marked as paragraphs, of more than 50 and fewer than 5,000 characters; else generic."""
    marked = F.when(page.contains('data-component-name="paragraph"'), _all(page, r'(?s)data-component-name="paragraph"[^>]*>(.*?)</div>')).otherwise(F.array().cast("array<string>"))
    texts = F.filter(_collapsed(_stripped(marked)), lambda p: (F.length(p) > 50) & (F.length(p) < 5000))
    return F.when(F.size(texts) > 0, _join(texts)).otherwise(generic(page))


def article_content(page: Column) -> Column:
    """The article's container cut at its paragraphs; without one the first 20 paragraphs of more than
    40 characters as one. Pieces of 20 characters or fewer go."""
    body = F.nullif(F.regexp_extract(page, r'(?s)<div[^>]*class="[^"]*article-content[^"]*"[^>]*>(.*?)</article>', 1), F.lit(""))
    rest = F.array_join(_collapsed(F.slice(_sized(_paragraphs(page), 40, None), 1, 20)), " ")
    pieces = F.split(F.coalesce(body, rest), r"</p>\s*<p[^>]*>")
    return _join(F.filter(_collapsed(_stripped(pieces)), lambda p: F.length(p) > 20))


def body_container(page: Column) -> Column:
    """Paragraphs of more than 40 characters in the body container; else generic."""
    body = F.regexp_extract(page, r'(?s)<div[^>]*class="[^"]*ms-article__body[^"]*"[^>]*>(.*?)</div>', 1)
    inner = F.when(body != "", _sized(_paragraphs(body), 40, None)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(inner) > 0, _join(_collapsed(inner))).otherwise(generic(page))


EXTRACTORS = {f.__name__: f for f in (generic, long, text_blocks, component, article_content, body_container)}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.get(F.array(F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), F.coalesce(key, F.lit("")))), F.lit(0))


def route(source: Column, url: Column) -> Column:
    """Name of the extractor for an item, null for one whose page is not read: skip list, then source
    name, then exact host, then generic."""
    return F.when(is_skipped(source, url), None).otherwise(F.coalesce(_lookup(source, dims.EXTRACTOR_BY_NAME), _lookup(host(url), dims.EXTRACTOR_BY_HOST), F.lit("generic")))


def extract_body(page: Column, extractor: Column) -> Column:
    """Body text of a page by the extractor named; only the chosen rule is evaluated."""
    out = F.when(extractor == "generic", generic(page))
    for name, f in EXTRACTORS.items():
        if name != "generic":
            out = out.when(extractor == name, f(page))
    return out


def read_items(items: DataFrame, pages: DataFrame, as_of: Column, max_chars: int | None = None) -> DataFrame:
    """Items with the text and time of their pages. ``pages`` has url and html, one row per url. A page
    without a body leaves the item's text; an item without a page, or of a source that is not read,
    stays as it is but for a missing date, which becomes ``as_of`` only where a page was read or the
    source is skipped."""
    named = items.withColumn("__x", route(F.col("source_name"), F.col("url")))
    p = pages.groupBy(F.col("url").alias("__u")).agg(F.first("html").alias("__h"))
    j = named.join(p, F.when(named["__x"].isNotNull(), named["url"]) == p["__u"], "left")
    j = j.withColumns({"__b": extract_body(F.col("__h"), F.col("__x")), "__t": extract_time(F.col("__h"))})
    body = F.col("__b")
    text = body if max_chars is None else F.left(body, F.lit(max_chars))
    date = repair_source_date(F.col("source_date"), F.col("__t"), as_of)
    read = F.col("__h").isNotNull() | F.col("__x").isNull()
    return j.withColumns({"raw": F.when(body != "", text).otherwise(F.col("raw")), "source_date": F.when(read, date).otherwise(F.col("source_date"))}).select(*items.columns)
