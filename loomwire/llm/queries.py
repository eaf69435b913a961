"""Queries of the llm operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire.llm import furniture, lines, linkage, mixing, pieces, quality, residue, tokens, truncation
from loomwire.scratch import materialize
from loomwire.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "brief_news")).select("item_id")


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "brief_news")).select("item_id", "source_name", "category")


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link_batches(table(spark, d, "brief_news"), table(spark, d, "batch_item"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_links(spark, d).where("is_case").select("batch_item_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return furniture.furniture_lines(table(spark, d, "brief_news"))


def p3_body(spark: SparkSession, d: str) -> DataFrame:
    return furniture.main_body(table(spark, d, "brief_news"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "brief_news"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, d, "brief_news"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "brief_news")).where(F.size("pieces") > 1).select("item_id")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.piece_rows(table(spark, d, "brief_news"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.recurrent_lines(table(spark, d, "brief_news"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return lines.without_recurrent_lines(table(spark, d, "brief_news").select("item_id", "source_name", "raw")).select("item_id", "raw")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(materialize(p9_mix(spark, d), "mix"), table(spark, d, "mix_target"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"))


def p10_figures(spark: SparkSession, d: str) -> DataFrame:
    figures = quality.text_quality(table(spark, d, "documents"))
    return figures.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("mean_word_len", "symbol_ratio", "line_end_share", "common_share")], "best_lang", "profile")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_kept, p2_found, p2_links, p3_found, p3_body, p4_found, p4_rates, p5_found, p5_pieces, p7_found, p7_clean, p8_ids, p9_mix, p9_shares, p10_found, p10_figures)
}

_SPACES = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}"
_RECURRENT = rf"""WITH l AS (SELECT item_id, source_name, i AS line_no, string_split(raw, chr(10))[i] AS line
    FROM (SELECT *, unnest(range(1, len(string_split(raw, chr(10))) + 1)) AS i FROM brief_news WHERE raw IS NOT NULL)),
  p AS (SELECT item_id, source_name, line_no, trim(regexp_replace(regexp_replace(replace(lower(line), 'ß', 'ss'), '[{_SPACES}]+', ' ', 'g'), '\p{{Nd}}+', '0', 'g')) AS k FROM l WHERE regexp_matches(line, '[^{_SPACES}]')),
  n AS (SELECT source_name, count(DISTINCT item_id) AS n FROM p GROUP BY source_name),
  c AS (SELECT source_name, k, count(DISTINCT item_id) AS c FROM p GROUP BY source_name, k),
  f AS (SELECT p.item_id, CAST(p.line_no AS INTEGER) AS line_no FROM p JOIN c ON p.source_name IS NOT DISTINCT FROM c.source_name AND p.k = c.k JOIN n ON n.source_name IS NOT DISTINCT FROM p.source_name WHERE c.c >= 3 AND c.c >= 0.05 * n.n)"""

SQL: dict[str, str] = {
    "p5_found": "SELECT item_id FROM brief_news WHERE length(raw) > 4000",
    "p7_found": f"{_RECURRENT} SELECT item_id, line_no FROM f",
    "p7_clean": rf"""{_RECURRENT}, g AS (SELECT item_id, list(line_no) AS gone FROM f GROUP BY item_id)
      SELECT b.item_id, CASE WHEN g.gone IS NULL THEN b.raw ELSE array_to_string(list_filter(string_split(b.raw, chr(10)), lambda x, i: NOT list_contains(g.gone, i)), chr(10)) END AS raw FROM brief_news b LEFT JOIN g ON b.item_id = g.item_id""",
}
