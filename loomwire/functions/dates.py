"""Date expressions of listings and pages. Zone-less times of the fixed forms mean UTC+8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwire.functions.text import html_unescape, trim

EPOCH = 0
# Where pages keep their time of publication, in order of trust.
TIME_PATTERNS = (
    r'"datePublished"\s*:\s*"([^"]+)"',
    r"datePublished&quot;\s*:\s*&quot;([^&]+)&quot;",
    r"""(?i)<meta[^>]*name=["']datePublished["'][^>]*content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]*property=["']article:published_time["'][^>]*content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]*name=["']pubdate["'][^>]*content=["']([^"']+)["']""",
    r'<time[^>]*datetime="([^"]+)"',
    r'"pubTime"\s*:\s*"([^"]+)"',
    r'class="source-time">([^<]+)',
)
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[Tt ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s?(?:[Zz]|[+-]\d{2}:?\d{2})?)?$"


def _instant(s: Column) -> Column:
    """Instant of an ISO 8601 or RFC 822 text; UTC without a zone, null if neither."""
    iso = F.regexp_replace(F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"(\d)\s+([+-]\d{2}:)", "$1$2")
    iso = F.regexp_replace(iso, r"([Tt ]\d{2}:\d{2})(?=$|\s?[Zz+-])", "$1:00")
    zoned = F.when(iso.rlike(r"(?:[Zz]|[+-]\d{2}:\d{2})$"), iso).when(iso.rlike(":"), F.concat(iso, F.lit("Z"))).otherwise(F.concat(iso, F.lit("T00:00:00Z")))
    plain = F.regexp_replace(s, r"^[A-Za-z]{3,9},?\s+", "")
    zone = F.regexp_replace(plain, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    full = F.when(zone.rlike(r"[+-]\d{4}$"), zone).otherwise(F.concat(zone, F.lit(" +0000")))
    secs = F.regexp_replace(full, r"(\s\d{1,2}:\d{2})(\s[+-])", "$1:00$2")
    return F.when(s.rlike(_ISO), F.try_to_timestamp(F.upper(zoned))).when(s.rlike(r"\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}"), F.try_to_timestamp(secs, F.lit("d MMM yyyy HH:mm:ss Z")))


def parse_source_date(text: Column) -> Column:
    """Instant of a listing's time; 1970 for a blank, null or unreadable one. ``YYYY-MM-DD HH:MM[:SS]``
    without a zone is local in UTC+8."""
    s = trim(text)
    local = s.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2})?$")
    s = F.when(local, F.concat(F.regexp_replace(s, " ", "T"), F.lit("+08:00"))).otherwise(s)
    return F.coalesce(_instant(s), F.timestamp_micros(F.lit(EPOCH).cast("bigint")))


def extract_time(page: Column) -> Column:
    """Time of publication found in a page; the first pattern whose first match can be read wins, null if none."""

    def one(found: Column) -> Column:
        s = html_unescape(trim(found))
        local = s.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}(?::\d{2})?$")
        return _instant(F.when(local, F.concat(F.regexp_replace(F.regexp_replace(s, "/", "-"), " ", "T"), F.lit("+08:00"))).otherwise(s))

    firsts = F.filter(F.array(*[F.regexp_extract(page, p, 1) for p in TIME_PATTERNS]), lambda x: x != "")
    return F.get(F.filter(F.transform(firsts, one), lambda t: t.isNotNull()), F.lit(0))


def repair_source_date(date: Column, found: Column, as_of: Column) -> Column:
    """Date of an item after its page was read: the page's time if the item has none (1970) or an
    earlier one, then ``as_of`` if there is still none."""
    epoch = F.timestamp_micros(F.lit(EPOCH).cast("bigint"))
    best = F.when(found.isNotNull() & ((date == epoch) | (found > date)), found).otherwise(date)
    return F.when(best == epoch, as_of).otherwise(best)
