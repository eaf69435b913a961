"""Text expressions: entities, tags, white space, Markdown. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named entities that are decoded.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…", "bull": "•",
    "copy": "©", "reg": "®", "trade": "™", "times": "×", "divide": "÷", "middot": "·",
}
# Fixed value: the characters that Markdown V2 wants escaped.
MARKDOWN = r"([_*\[\]()~`>#+\-=|{}.!\\])"
# Fixed value: white space as JavaScript's trim and \s know it.
WHITE = r"[\t\n\x{B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, f"^{WHITE}+|{WHITE}+$", "")


def collapse_whitespace(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim(F.regexp_replace(x, f"{WHITE}+", " "))


def _character(code: Column) -> Column:
    """The character of a code point; null beyond U+10FFFF and for surrogates."""
    sound = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(sound, F.decode(F.unhex(F.lpad(F.hex(F.when(sound, code)), 8, "0")), "UTF-32"))


def _decoded(token: Column) -> Column:
    name = F.lower(F.regexp_extract(token, r"^&([a-zA-Z]+);$", 1))
    by_hex = F.conv(F.nullif(F.regexp_extract(token, r"^&#x([0-9a-fA-F]+);$", 1), F.lit("")), 16, 10).try_cast("bigint")
    by_dec = F.nullif(F.regexp_extract(token, r"^&#([0-9]+)[0-9a-fA-F]*;$", 1), F.lit("")).try_cast("bigint")
    names = F.create_map(*[F.lit(v) for kv in ENTITIES.items() for v in kv])
    return F.coalesce(_character(by_hex), _character(by_dec), F.get(F.array(F.try_element_at(names, name)), F.lit(0)), token)


def html_unescape(x: Column) -> Column:
    """One pass over the entities; those unknown or beyond Unicode stay as they are."""
    parts = F.regexp_extract_all(x, F.lit(r"&(?:#x?[0-9a-fA-F]+|[a-zA-Z]+);|[^&]+|&"), 0)
    whole = F.array_join(F.transform(parts, lambda t: F.when(t.startswith("&") & (F.length(t) > 2), _decoded(t)).otherwise(t)), "")
    return F.when(x.contains("&"), whole).otherwise(x)


def strip_tags_listing(x: Column) -> Column:
    """Text of a listing's markup: tags go, ends are trimmed, then entities are decoded."""
    return html_unescape(trim(F.regexp_replace(x, "<[^>]+>", "")))


def strip_tags_body(x: Column) -> Column:
    """Text of a page's markup: tags become spaces, ends are trimmed, then entities are decoded."""
    return html_unescape(trim(F.regexp_replace(x, "<[^>]+>", " ")))


def escape_markdown(x: Column) -> Column:
    return F.regexp_replace(x, MARKDOWN, r"\\$1")


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units, as messaging services count."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")
