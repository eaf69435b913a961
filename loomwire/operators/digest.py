"""The digest: items as ordered Markdown, and its cutting into messages."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire import dims
from loomwire.functions.text import escape_markdown

# Order of the parts of a short date by language.
DATE_PATTERNS = {"English": "M/d, HH:mm", "German": "d.M., HH:mm", "French": "dd/MM HH:mm", "Spanish": "d/M, HH:mm", "Chinese": "M/d HH:mm", "Italian": "d/M, HH:mm", "Portuguese": "dd/MM, HH:mm", "Russian": "dd.MM, HH:mm", "Japanese": "M/d HH:mm", "Korean": "M. d. HH:mm"}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])


def valid(items: DataFrame) -> DataFrame:
    """Items that can be shown: with bullets, title, url and source."""
    return items.where((F.size("bullets") > 0) & (F.col("title") != "") & (F.col("url") != "") & (F.col("source_name") != ""))


def format_article(language: str = "English", zone: str = "UTC") -> Column:
    """One article: title, date if there is one, link, bullets. Everything is escaped but the URL."""
    source = escape_markdown(F.col("source_name"))
    link = F.when(F.coalesce(F.col("url"), F.lit("")) != "", F.concat(F.lit("["), source, F.lit("]("), F.col("url"), F.lit(")"))).otherwise(F.concat(F.lit("_"), source, F.lit("_")))
    stamp = F.date_format(F.from_utc_timestamp(F.col("source_date"), zone), DATE_PATTERNS.get(language, DATE_PATTERNS["English"]))
    date = F.when(F.unix_micros(F.col("source_date").cast("timestamp")) > 0, F.concat(F.lit(" "), escape_markdown(stamp))).otherwise("")
    bullets = F.transform(F.coalesce("bullets", F.array().cast("array<string>")), lambda b: F.concat(F.lit("\n  • "), escape_markdown(b)))
    return F.concat(F.lit("• *"), escape_markdown(F.col("title")), F.lit("*"), date, F.lit(" "), link, F.array_join(bullets, ""))


def _sign(category: Column) -> Column:
    return F.coalesce(F.get(F.array(F.try_element_at(_map(dict(dims.CATEGORIES)), category)), F.lit(0)), F.lit(dims.FALLBACK_SIGN))


def _label(category: Column, language: str) -> Column:
    names = [c for c, _ in dims.CATEGORIES]
    table = dict(zip(names, dims.LABELS.get(language, dims.LABELS["English"])))
    return F.coalesce(F.get(F.array(F.try_element_at(_map(table), category)), F.lit(0)), category)


def category_order(category: Column) -> Column:
    """Place in the display order; unknown categories come last."""
    place = F.array_position(F.array(*[F.lit(c) for c, _ in dims.CATEGORIES]), category)
    return F.when(place > 0, place).otherwise(len(dims.CATEGORIES) + 1)


def format_sections(items: DataFrame, language: str = "English", zone: str = "UTC") -> DataFrame:
    """category, section: the valid items of a category, newest first, as one text. A section is the
    unit of delivery and small after truncation; use it on truncated items."""
    shown = valid(items).select("category", F.struct((-F.unix_micros(F.col("source_date").cast("timestamp"))).alias("d"), *[c for c in ("source_ord", "item_ord", "hash_id") if c in items.columns], format_article(language, zone).alias("a")).alias("r"))
    by = shown.groupBy("category").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    head = F.concat(_sign(F.col("category")), F.lit(" *"), escape_markdown(_label(F.col("category"), language)), F.lit("*\n"))
    return by.select("category", F.concat(head, F.array_join(F.transform("rows", lambda r: r["a"]), "\n\n")).alias("section"))


def format_digest(items: DataFrame, categories: DataFrame, as_of: datetime, language: str = "English", zone: str = "UTC", title: str | None = None) -> DataFrame:
    """One row, text: header with the signs of all ``categories`` (also those without items), then the
    sections in display order."""
    sections = format_sections(items, language, zone)
    both = categories.select("category").distinct().join(sections, "category", "full")
    rows = both.agg(F.array_sort(F.collect_list(F.struct(category_order(F.col("category")).alias("o"), "category", "section"))).alias("rows"))  # one entry per category
    prefix = title or dims.TITLES.get(language, dims.TITLES["English"])
    stamp = F.date_format(F.from_utc_timestamp(F.lit(as_of), zone), "MM/dd/yyyy HH:mm")
    signs = F.array_join(F.transform(F.filter("rows", lambda r: r["o"] <= len(dims.CATEGORIES)), lambda r: _sign(r["category"])), "")
    head = F.concat(F.lit("📰 *"), escape_markdown(F.lit(prefix)), F.lit(" \\| "), escape_markdown(stamp), F.lit(" "), signs, F.lit("*"))
    body = F.transform(F.filter("rows", lambda r: r["section"].isNotNull()), lambda r: r["section"])
    return rows.select(F.array_join(F.concat(F.array(head), body), "\n\n").alias("text"))


def _size(text: str) -> int:
    """UTF-16 units, as messaging services count."""
    return len(text) + sum(c > "￿" for c in text)


def split_message(text: str, limit: int = 4000) -> list[str]:
    """Messages of at most ``limit`` units: paragraphs are packed, one that is too long by its lines, a
    line that is too long by its words; a single longer word is a message of its own."""
    if _size(text) <= limit:
        return [text]
    out: list[str] = []
    pending = ""

    def flush() -> None:
        nonlocal pending
        if pending:
            out.append(pending.strip())
        pending = ""

    def pack(part: str, glues: tuple[str, ...]) -> None:
        """Adds ``part`` to what is pending; cuts it at the next finer glue if it is too long itself."""
        nonlocal pending
        glue, finer = glues[0], glues[1:]
        joined = pending + glue + part if pending else part
        if _size(joined) <= limit:
            pending = joined
            return
        flush()
        if _size(part) <= limit or not finer:
            pending = part
            return
        for piece in part.split(finer[0]):
            if piece.strip() or finer[0] == " ":
                pack(piece, finer)

    for paragraph in text.split("\n\n"):
        if paragraph.strip():
            pack(paragraph, ("\n\n", "\n", " "))
    if pending.strip():
        out.append(pending.strip())
    return out


def message_chunks(texts: DataFrame, text: str = "text", key: str = "doc_id", limit: int = 4000) -> DataFrame:
    """``key``, chunk_no (from 0), chunk of every text; a null text has none, an empty one a single empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [[] if t is None else split_message(t, limit) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(parts, pa.list_(pa.string()))], ["k", "c"])

    kind = texts.schema[key].dataType.simpleString()
    out = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, c array<string>")
    return out.select(F.col("k").alias(key), F.posexplode("c").alias("chunk_no", "chunk"))
