"""Titles for record linkage: normal form, blocking keys and the comparison of two titles.

Plain Python for use inside Arrow maps; no Spark here.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import xxhash

#: Changed words (characters for Chinese) up to which two titles are nearly the same.
MAX_WORDS, MAX_CHARS = 2, 4
# Labels that are put before a title.
LABELS = (
    "breaking news|breaking|update|updated|exclusive|live updates|live blog|liveblog|live|just in|watch|video|analysis|opinion|comment|report|latest|developing|alert|correction|corrected|urgent|news|photos|gallery|podcast|explainer|interview|feature"
    "|última hora|ultima hora|actualización|actualizado|exclusiva|exclusivo|en directo|en vivo|directo|vídeo|urgente|análisis|opinión|galería"
    "|eilmeldung|eil|aktualisiert|exklusiv|liveticker|ticker|analyse|kommentar|bericht|neu"
    "|dernière minute|flash|mise à jour|exclusif|en direct|direct|vidéo|info|alerte"
    "|快讯|最新|独家|更新|视频|直播|突发|重磅|图集|最新消息|刚刚"
)
# Chinese characters of particles, times, degrees and plain verbs, which make no name of another.
PLAIN_CHARS = frozenset("的地得了着过在再已将把被对与和及并又仍还也都就才从向于为是有没不未无很更最太可能会要应该今日天昨明前后时刻现正刚这那其此本该每各个次名位项起说称道表示指出公布宣布发公开始继续进入做作去来到给让使用他她它们")
_LABEL = re.compile(rf"^\W*(?:(?:{LABELS})\s*(?:[:：|•·!/–—]|-\s|\s-)\s*|[\[【(（〔](?:{LABELS})[\]】)）〕]\s*)+", re.I)
_LABEL_END = re.compile(rf"\s*(?:[\[【(（〔](?:{LABELS})[\]】)）〕]|(?:\s[-–—|]\s|\|)\s*(?:{LABELS}))\W*$", re.I)
#: A leading word or two in capitals with a colon is a label unless the rest is in capitals as well.
_CAPS = re.compile(r"^\W*([A-ZÀ-Þ]{3,}(?: [A-ZÀ-Þ]{2,})?) ?: (?=.*[a-zß-ÿ])")
_HAN = re.compile(r"[㐀-鿿]")
_TOKEN = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
_GERMAN = frozenset("und der die das den dem des nach gegen mit bei eine einen einer von für nicht auf um zum zur wird als aus neue über".split())


@lru_cache(maxsize=4096)
def _outlet(name: str) -> tuple[re.Pattern, re.Pattern]:
    n = r"\s+".join(map(re.escape, name.split()))
    return re.compile(rf"^\W*{n}\s*[:：|–—-]\s*", re.I), re.compile(rf"\s*(?:[|–—•·]|\s-|[(（\[【])\s*{n}\W*$", re.I)


def clean(title: str, outlets: tuple[str, ...] = ()) -> str:
    """A title without entities, invisible characters, labels and outlet names around it."""
    t = html.unescape(title)
    t = "".join(" " if unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cc") else c for c in t if unicodedata.category(c) != "Cf")
    t = " ".join(unicodedata.normalize("NFKC", t).split())
    for _ in range(3):
        was = t
        t = _LABEL_END.sub("", _CAPS.sub("", _LABEL.sub("", t)))
        for o in outlets:
            if o:
                a, b = _outlet(o)
                t = b.sub("", a.sub("", t))
        t = t.strip()
        if t == was or not t:
            return t or was
    return t


def fold(word: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c))


def tagged(title: str, outlets: tuple[str, ...] = ()) -> str:
    """Normal form of a title: folded words, each after a tag. ``f`` is the first word, ``c`` one with
    a capital inside a sentence, ``o`` one without, ``t`` any in a title whose case says nothing."""
    t = clean(title, outlets)
    tokens = _TOKEN.findall(t)
    words = [w for w in tokens if w[0].isalpha()]
    capital = sum(w[0].isupper() for w in words[1:])
    mute = len(words) > 2 and (capital >= 0.85 * len(words[1:]) or t.upper() == t or t.lower() == t) and not _HAN.search(t)
    out = []
    for i, w in enumerate(tokens):
        tag = "o" if _HAN.match(w) or w[0].isdigit() else "t" if mute else "f" if i == 0 else "c" if w[0].isupper() else "o"
        out.append(tag + fold(w))
    return " ".join(out)


def figures(words: list[str]) -> str:
    return ",".join(sorted(d for w in words for d in re.findall(r"\d+", w)))


def _h(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


def _chinese(words: list[str]) -> bool:
    return sum(len(w) == 1 and bool(_HAN.match(w)) for w in words) >= 0.5 * max(1, len(words))


def _ranked(words: list[str]) -> list[str]:
    """Words without figures, the longest first: the order in which titles choose the words of their keys."""
    return sorted({w for w in words if not w.isdigit()}, key=lambda w: (-len(w), w))


def _word_keys(fig: str, best: list[str], singles: bool, pairs: bool) -> list[int]:
    one = [_h("w", fig, w) for w in best[: MAX_WORDS + 1 + (0 if not pairs else MAX_WORDS)]] if singles else []
    two = [_h("p", fig, *sorted((a, b))) for i, a in enumerate(best) for b in best[i + 1 :]] if pairs else []
    return one + two or [_h("w", fig)]


def index_keys(tags: str) -> list[int]:
    """Few keys under which a title is found by :func:`probe_keys` of any nearly equal one. Figures
    never change. Of any four words two survive two changes, so pairs out of the four longest words
    serve, which are rare enough whatever the figures; titles of three words or fewer have each of
    them. Of five pieces of a Chinese title at least one survives four changes."""
    words = [w[1:] for w in tags.split()]
    fig = figures(words)
    if not words:
        return []
    if _chinese(words):
        plain = [w for w in words if not w.isdigit()]
        s, n = "".join(plain), len(plain)
        size, more = divmod(n, MAX_CHARS + 1)
        out, at = set(), 0
        for i in range(MAX_CHARS + 1):
            k = size + (i >= MAX_CHARS + 1 - more)
            if k:
                out.add(_h("z", fig, str(n), s[at : at + k]))
            at += k
        return list(out) or [_h("z", fig, str(n), s)]
    best = _ranked(words)
    short = len(best) <= MAX_WORDS + 1
    return _word_keys(fig, best, True, False) if short else _word_keys(fig, best[: MAX_WORDS + 2], False, True)


def probe_keys(tags: str) -> list[int]:
    """Keys of all titles that may be nearly equal. A word that both titles have falls in rank by one at
    most for each word that was added, so the words of the other title's keys are among the first six."""
    words = [w[1:] for w in tags.split()]
    fig = figures(words)
    if not words:
        return []
    if _chinese(words):
        plain = [w for w in words if not w.isdigit()]
        s, n = "".join(plain), len(plain)
        out = set()
        for m in range(max(1, n - MAX_CHARS), n + MAX_CHARS + 1):
            for size in {m // (MAX_CHARS + 1), m // (MAX_CHARS + 1) + (m % (MAX_CHARS + 1) > 0)}:
                if size:
                    # a piece is moved by at most the number of changes
                    out.update(_h("z", fig, str(m), s[i : i + size]) for i in range(n - size + 1))
        return list(out) or [_h("z", fig, str(n), s)]
    best = _ranked(words)
    singles = len(best) <= 2 * MAX_WORDS + 1
    return _word_keys(fig, best[: 2 * MAX_WORDS + 2], singles, len(best) > 1)


def _script(a: list[str], b: list[str], most: int) -> list[tuple[str, str]] | None:
    """Cheapest changes from ``a`` to ``b`` as pairs (old, new), "" for none; null beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    n, m = len(a), len(b)
    d = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        d[i][0] = i
    for j in range(m + 1):
        d[0][j] = j
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    if d[n][m] > most:
        return None
    out, i, j = [], n, m
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            if a[i - 1] != b[j - 1]:
                out.append((a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            out.append((a[i - 1], ""))
            i -= 1
        else:
            out.append(("", b[j - 1]))
            j -= 1
    return out


def compare(known: str, new: str) -> tuple[int, list[str]] | None:
    """Changes between two tagged titles, and the words that must not be names for the two to be
    nearly the same; null if they are not. A word is given with g: before it if its title is German,
    where nouns have capitals too."""
    a, b = known.split(), new.split()
    wa, wb = [w[1:] for w in a], [w[1:] for w in b]
    if figures(wa) != figures(wb):
        return None
    if _chinese(wa) != _chinese(wb):
        return None
    if wa == wb or "".join(wa) == "".join(wb):
        return 0, []
    if _chinese(wa):
        s = _script(wa, wb, MAX_CHARS)
        # letter case does not tell names: a character that stands for another must be one of words that are no names
        return None if s is None or any(x and y and not (x in PLAIN_CHARS and y in PLAIN_CHARS) for x, y in s) else (len(s), [])
    s = _script(wa, wb, MAX_WORDS)
    if s is None:
        s = _joined(wa, wb)
        if s is None:
            return None
    if len(s) >= min(sum(not w.isdigit() for w in x) for x in (wa, wb)):
        return None
    ta, tb = dict(zip(wa, a)), dict(zip(wb, b))
    german = len(_GERMAN.intersection(wa)) >= 1
    doubtful = []
    for old, word in s:
        for w, tags in ((old, ta), (word, tb)):
            if not w or w.isdigit():
                continue
            tag = tags[w][0] if w in tags else "o"
            if tag != "o":
                doubtful.append(tag + ("g:" if german else ":") + w)
    return len(s), doubtful


def _joined(wa: list[str], wb: list[str]) -> list[tuple[str, str]] | None:
    """Changes if words are written together in one title and apart in the other."""
    out = list(wb)
    for i in range(len(wb) - 1):
        if wb[i] + wb[i + 1] in wa:
            out[i : i + 2] = [wb[i] + wb[i + 1]]
            break
    return _script(wa, out, MAX_WORDS) if len(out) != len(wb) else None
