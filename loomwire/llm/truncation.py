"""Texts cut by field limits or in transfer, and how often each source cuts (problem 4).

All in SQL. Word trigrams (characters for Chinese; names and numbers masked) are counted inside
texts and at the ends of lines. A text that does not end like a sentence is joined with the
counts of its final trigram: one that is frequent inside and almost never terminal means a cut.
If the last word is itself cut in two, its trigram is rare after the one before it, which decides,
whatever the number of texts: in many texts a half word is met again, and in some inside. A last
line that is no running text, but a score, an item, a headline or furniture, ends nothing.
Counts cover all texts; they are summed by trigram before the shuffle, so a trigram that half of
the texts share is a few rows per task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwire.llm import furniture
from loomwire.llm.residue import residue
from loomwire.scratch import materialize

#: Terminal share of a trigram up to which it counts as almost never terminal.
MAX_TERMINAL = 0.05

#: White space that may follow a text.
WHITE = " \t\n\r\x0b\x0c\x85\xa0\u2028\u2029\u3000\u200b\ufeff"
#: Marks and remnants at a cut: ellipses, bracketed or not, half a character, tag or entity.
CUT_MARK = r"\s*(?:[\[(（]\s*(?:…|\.{2,}|\+?\d+ (?:more )?char\w*)\s*[\])）]?|…+|\.{2,}|\x{FFFD}+|<(?:[a-zA-Z/!][^<>\n]*)?|&#?\w{0,8}|\\u?[0-9a-f]{0,4}|-)\s*$"
#: How a complete sentence ends, with closing marks after it.
TERMINAL = r"(?:[.!?。！？:：;；][\s\x{A0}]*[\"'”’»“„«」』)\]）]*|[.!?。！？]?[\])）][.。]?)\s*$"


# Words between blanks with the stops that follow them; a line feed is a word of its own. Words with a
# capital are names, numbers are all alike. A text with many characters of several bytes is split into
# characters: in Chinese there are no blanks.
_WORDS = r"""filter(CASE WHEN octet_length({x}) > 1.7 * length({x}) THEN split({x}, '')
  ELSE transform(split(replace({x}, '\n', ' \n '), ' '),
    w -> CASE WHEN ascii(w) BETWEEN 65 AND 90 THEN CASE WHEN right(w, 1) IN ('.', ',', ';', ':', '?', '!', '”', '"', ')', '»', '“') THEN concat('¤', right(w, 1)) ELSE '¤' END
              WHEN ascii(w) BETWEEN 48 AND 57 THEN '0' ELSE w END) END, w -> w <> '')"""



def _java(pattern: str) -> str:
    """A pattern of :mod:`furniture` as Java writes it."""
    return pattern.replace(r"\p{Han}", r"\p{IsHan}")


def _lines_sql() -> dict[str, str]:
    """SQL conditions on a line {x}, from the marks of :mod:`furniture`."""
    f = furniture
    any_of = lambda flags, *ps: "{x} RLIKE '" + _quoted(flags + "|".join(f"(?:{_java(p)})" for p in ps)) + "'"
    han, words = "regexp_count({x}, '\\\\p{IsHan}')", "regexp_count({x}, '[\\\\p{L}\\\\p{N}][\\\\p{L}\\\\p{N}’''-]*')".replace("''", "\\'")
    size = f"({han} + {words})"
    head = "regexp_extract({x}, '^[^:：]*', 0)"
    runs = f"({any_of('', f._END.pattern)} OR {size} > CASE WHEN {han} > 5 THEN 60 ELSE 30 END OR ({size} >= 10 AND {any_of('', f._INNER_END.pattern)}))"
    listed = f"({any_of('', f._SCORE.pattern, f._BULLET.pattern)})"
    titles = any_of("", f._TITLES.pattern)
    outlet = "(length({x}) <= 140 AND (length(source) >= 6 OR source RLIKE '\\\\p{IsHan}') AND contains(lower({x}), lower(trim(source))) AND NOT {x} RLIKE '[“”«»„\"]')"
    tag = f"({any_of('(?iuU)', *f.CUES)} OR {any_of('', f._BYLINE.pattern, f._COUNTED.pattern, f._MENU.pattern)} OR coalesce({outlet}, false))"
    brief = f"(CASE WHEN {han} > 2 THEN {han.replace('{x}', head)} <= 9 ELSE {words.replace('{x}', head)} <= 5 AND {size} <= 9 END AND NOT CASE WHEN {han} > 0 THEN {size} <= 4 ELSE {size} = 1 END)"
    return {
        # neither furniture nor in a list
        "text": f"NOT {listed} AND (length({{x}}) > {f.PARAGRAPH} OR NOT ({tag} OR {titles}))",
        "runs": runs,
        "headline": f"NOT {runs} AND NOT {listed} AND NOT {tag} AND ({titles} OR NOT {brief})",
    }


# fmt: off
COUNTS = r"""
-- one column, since two that are read apart would have the trigrams counted twice: inside, terminal
SELECT h, array(count_if(NOT last), count_if(last)) AS n
FROM (SELECT xxhash64(a, b, c) AS h, coalesce(d, '\n') = '\n' AS last
      FROM (SELECT inline(arrays_zip(w, slice(w, 2, size(w)), slice(w, 3, size(w)), slice(w, 4, size(w)))) AS (a, b, c, d)
            FROM (SELECT {words} AS w FROM {texts}))
      WHERE c IS NOT NULL)
GROUP BY h
"""
ENDS = r"""
SELECT key, source, marked, last_line, before_last,
       xxhash64(get(w, size(w) - 3), get(w, size(w) - 2), get(w, size(w) - 1)) AS final,
       xxhash64(get(w, size(w) - 4), get(w, size(w) - 3), get(w, size(w) - 2)) AS before
FROM (SELECT key, source, marked, get(lines, size(lines) - 1) AS last_line, get(lines, size(lines) - 2) AS before_last, {words} AS w
      -- the last words are enough; a text without blanks is its own last word
      FROM (SELECT key, source, mark <> '' AS marked, substring_index(stripped, ' ', -12) AS tail, filter(split(raw, '\n'), x -> x RLIKE '\\S') AS lines
            FROM (SELECT *, left(raw, length(raw) - length(mark)) AS stripped
                  FROM (SELECT key, source, raw, regexp_extract(substring_index(raw, '\n', -1), '{mark}', 0) AS mark FROM {texts}
                        -- most texts end with a plain stop and are done here
                        WHERE NOT right(raw, 1) IN ('.', '!', '?', '。', '！', '？') OR right(raw, 2) = '..'))
            WHERE stripped <> '' AND NOT right(stripped, 12) RLIKE '{terminal}'))
"""
CUT = r"""
SELECT e.key, e.source, trim(e.last_line) AS last_line, trim(e.before_last) AS before_last
FROM {ends} e
LEFT JOIN {counts} f ON e.final = f.h
LEFT JOIN {counts} b ON e.before = b.h
WHERE e.marked
   -- the final trigram is known: almost never terminal
   OR (f.n[0] >= 3 AND f.n[1] - 1 <= 1 + {most} * f.n[0])
   -- half a word, known or not: the trigram before it is known and hardly ever goes on like this
   OR (b.n[0] >= 3 AND coalesce(f.n[0] + f.n[1], 0) - 1 <= 1 + {most} * b.n[0])
   OR (coalesce(f.n[0], 0) < 3 AND coalesce(b.n[0], 0) < 3 AND coalesce(f.n[1], 0) <= 1 AND length(e.last_line) >= 12)
"""
# fmt: on


def truncated(df: DataFrame, text: str = "raw", key: str = "item_id", source: str = "source_name", max_terminal: float = MAX_TERMINAL) -> DataFrame:
    """``source``, ``key`` of the texts that stop inside a sentence.

    ``key`` must be unique. Null, empty and blank texts, texts that end with a sentence, a score,
    a list or page furniture, and the records of :func:`loomwire.llm.residue.residue` have no row. A
    null source is kept as null. The counts cover whole texts; trailing white space is no part of a text.
    No rows give no rows.
    """
    spark = df.sparkSession
    df = df.select(key, source, text, *(["url"] if "url" in df.columns else []))
    trimmed = F.rtrim(F.col(text), F.lit(WHITE))
    # whole tags at the end are no part of a text
    trimmed = F.when(trimmed.endswith(">"), F.rtrim(F.regexp_replace(trimmed, r"(?:\s*<[^<>\n]+>)+$", ""), F.lit(WHITE))).otherwise(trimmed)
    texts = df.select(F.col(key).alias("key"), F.col(source).alias("source"), trimmed.alias("raw")).where("raw <> ''")
    counts = _sql(spark, COUNTS.replace("{words}", _WORDS.replace("{x}", "raw")), texts=texts)
    ends = ENDS.replace("{words}", _WORDS.replace("{x}", "tail"))
    ends = _sql(spark, ends.replace("{terminal}", _quoted(TERMINAL)).replace("{mark}", _quoted(CUT_MARK)), texts=texts)
    cut = materialize(_sql(spark, CUT.replace("{most}", repr(max_terminal)), ends=ends, counts=counts), "cuts")
    # the check: the last line is running text, and not one of several headlines, which need no full stop
    is_text, runs, headline = (_lines_sql()[x] for x in ("text", "runs", "headline"))
    cut = cut.where(f"({is_text}) AND (({runs}) OR NOT coalesce(({headline}), false))".replace(f"({headline})", f"({headline.replace('{x}', 'before_last')})").replace("{x}", "last_line"))
    out = residue(df, text, key, source).select(F.col(key).alias("rk"))
    cut = cut.join(out, F.col("key") == F.col("rk"), "left_anti")
    return cut.select(F.col("source").alias(source), F.col("key").alias(key))


def _quoted(pattern: str) -> str:
    """A pattern inside a SQL string."""
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _sql(spark, query: str, **views: DataFrame) -> DataFrame:
    """The query with each {name} replaced by a view of its DataFrame."""
    for name, df in views.items():
        view = f"lw_{name}_{uuid.uuid4().hex[:8]}"
        df.createOrReplaceTempView(view)
        query = query.replace("{" + name + "}", view)
    return spark.sql(query)


def truncation_rates(df: DataFrame, text: str = "raw", key: str = "item_id", source: str = "source_name", max_terminal: float = MAX_TERMINAL) -> DataFrame:
    """``source``, n_rows with a non-blank text, n_cut and share of cut texts, for each source."""
    cut = truncated(df, text, key, source, max_terminal).groupBy(F.col(source).alias("cs")).agg(F.count(F.lit(1)).alias("n_cut"))
    rows = df.where(F.col(text).rlike(r"\S")).groupBy(F.col(source)).agg(F.count(F.lit(1)).alias("n_rows"))
    both = rows.join(cut, F.col(source).eqNullSafe(F.col("cs")), "left").select(source, "n_rows", F.coalesce("n_cut", F.lit(0)).alias("n_cut"))
    return both.withColumn("share", F.col("n_cut") / F.col("n_rows"))
