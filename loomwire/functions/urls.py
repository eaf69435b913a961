"""URL expressions: canonical form, identity, and what may be an article's address.

URLs are cut by regular expressions, since built-in parsers return null for addresses that
browsers accept. Punycode is not formed, and dot segments are resolved up to three levels.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwire.functions.text import trim

# Parameters that only track; those that begin with utm_ go too.
DROPPED = ("fbclid", "gclid", "cmpid", "ocid", "ref", "source")
# Hosts that cannot be read, paths that are no articles.
BLOCKED_HOSTS = ("news.qq.com", "cepr.org", "dazn.com", "reuters.com", "wsj.com", "bloomberg.com", "ft.com", "nytimes.com")
HOME_PATHS = ("", "/", "/news", "/world", "/sport", "/latest", "/en/latest.html", "/category/artificial-intelligence/")
LISTING_PATHS = ("/search", "/tag/", "/category/", "/topics/")
AGGREGATOR_HOST = "news.google.com"

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _SCHEME, 1))


def host(u: Column) -> Column:
    """Host in lower case, without user and port; null if the URL has none or an impossible one."""
    authority = F.regexp_replace(F.regexp_extract(u, _AUTHORITY, 1), "^.*@", "")
    name = F.lower(F.regexp_replace(authority, r":\d{0,5}$", ""))
    return F.when(name.rlike(r"^(?:\[[0-9a-f:.]+\]|[^\s<>^|%:\[\]]+)$"), name)


def path(u: Column) -> Column:
    """Path as a browser gives it: percent-encoded, dot segments resolved, "/" at least."""
    raw = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^?#]*)", 1), r"\\", "/")
    runs = F.regexp_extract_all(raw, F.lit(r"[!#-;=?-_a-z|~]+|[^!#-;=?-_a-z|~]+"), 0)
    coded = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^[!#-;=?-_a-z|~]"), r).otherwise(F.replace(F.url_encode(r), F.lit("+"), F.lit("%20")))), "")
    p = F.when(raw.rlike(r"[^!#-;=?-_a-z|~]"), coded).otherwise(raw)
    p = F.regexp_replace(p, r"/(?:\.(?:/|$))+", "/")
    for _ in range(3):
        p = F.regexp_replace(p, r"(?:^|/[^/]+)/\.\.(?:/|$)", "/")
    return F.when(p == "", "/").otherwise(p)


def without_www(h: Column) -> Column:
    return F.regexp_replace(h, r"^www\.", "")


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def _query(u: Column) -> Column:
    """Kept parameters, sorted by name (letter case only breaks ties), form-encoded."""
    pairs = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    named = F.transform(pairs, lambda p, i: F.struct(
        F.lower(_decoded(F.substring_index(p, "=", 1))).alias("low"),
        F.translate(_decoded(F.substring_index(p, "=", 1)), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz").alias("case"),
        i.alias("i"),
        _decoded(F.substring_index(p, "=", 1)).alias("k"),
        F.when(p.contains("="), _decoded(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v"),
    ))
    kept = F.filter(named, lambda x: ~x["low"].startswith("utm_") & ~x["low"].isin(*DROPPED))
    return F.array_join(F.transform(F.array_sort(kept), lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "&")


def canonical_url(url: Column) -> Column:
    """One form of the addresses of the same page: scheme, host without www, path without trailing
    slashes, parameters that do not track. A blank or null URL gives the empty string, one that
    cannot be parsed its trimmed self."""
    u = F.coalesce(trim(url), F.lit(""))
    full = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))
    bare = F.regexp_replace(path(full), "/+$", "")
    query = F.when(full.contains("?"), _query(full)).otherwise("")
    whole = F.concat(scheme(full), F.lit("://"), without_www(host(full)), F.when(bare == "", "/").otherwise(bare), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(u == "", "").when((scheme(full) != "") & host(full).isNotNull(), whole).otherwise(u)


def hash_id(url: Column, source: Column, title: Column) -> Column:
    """sha256 of the canonical URL, or of source and title without a URL."""
    blank = url.isNull() | (url == "")
    return F.sha2(F.when(blank, F.concat(F.coalesce(source, F.lit("")), F.lit(":"), F.coalesce(title, F.lit("")))).otherwise(canonical_url(url)), 256)


def is_article_url(url: Column) -> Column:
    """Whether the URL may be an article: http(s), no aggregator or blocked host, no home or listing path."""
    h = host(url)
    p = F.regexp_replace(path(url), "/+$", "")
    p = F.when(p == "", "/").otherwise(p)
    listing = F.lower(p).contains(LISTING_PATHS[0])
    for part in LISTING_PATHS[1:]:
        listing = listing | F.lower(p).contains(part)
    ok = scheme(url).isin("http", "https") & h.isNotNull() & ~h.contains(AGGREGATOR_HOST) & ~without_www(h).isin(*BLOCKED_HOSTS) & ~p.isin(*HOME_PATHS) & ~listing
    return F.coalesce(ok, F.lit(False))


def is_publisher_url(url: Column) -> Column:
    """Whether a resolved link may be used: short, without control characters and user, not the aggregator's."""
    h = host(url)
    user = F.regexp_extract(url, _AUTHORITY, 1).contains("@")
    ok = (F.length(url) <= 8192) & ~url.rlike(r"[\x00-\x1f]") & scheme(url).isin("http", "https") & h.isNotNull() & (h != AGGREGATOR_HOST) & ~h.endswith("." + AGGREGATOR_HOST) & ~user
    return F.coalesce(ok, F.lit(False))


def article_token(url: Column) -> Column:
    """Token of an aggregator's article link, null for any other URL."""
    token = F.regexp_extract(path(url), r"/(?:articles|read)/+([^/]+)/*$", 1)
    return F.when((host(url) == AGGREGATOR_HOST) & (token != "") & (F.length(token) <= 4096), token)


def is_skipped(source: Column, url: Column, sources: tuple[str, ...] = ("Motorsport.com",)) -> Column:
    """Whether an item's page is not read at all."""
    return F.coalesce(source.isin(*sources), F.lit(False)) | F.coalesce(without_www(host(url)).isin(*BLOCKED_HOSTS), F.lit(False))
