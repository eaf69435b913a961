"""Text quality figures of each document and its nearest structural profile (problem 10).

Four distributions describe the structure of a text: classes of its tokens (with the function
words of its best language apart), classes of its characters, the characters inside and outside
sentences, and new against repeated word pairs. Profiles of prose by language and of lists,
tables and kinds of junk are means over documents that plain seed rules call typical; they were
fitted once, on a sample of 10,000 documents, and are constants here, so that the class of a document does not
depend on the others. :func:`fit` fits them anew. A document belongs to the profile to which
the sum of its Jensen-Shannon divergences is least. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words (characters for Chinese) by language.
FUNCTION_WORDS = {
    "en": "the of and to in a is that for it was on with as at by from be are this have had has not but they he she who which or an their its will would been after before said one about into no than then there where when while so could because",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está ni aquí otra vez aunque tras",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde hier wir ob",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son aux d l n s qu c été mais ou comme on cette ses ont nous leur était sans ni puis deux même sous entre encore tout jusqu",
    "zh": "的 了 在 是 和 与 也 已 对 就 都 从 被 有 这 为 说 让 由 但 它 我 们 得 到 没 人 不 后 将 于 其 而",
}
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ANY = frozenset().union(*(_SETS[k] for k in ("en", "es", "de", "fr")))
_ZH = re.compile("[" + FUNCTION_WORDS["zh"].replace(" ", "") + "]")
LANGS = tuple(FUNCTION_WORDS)
TOKEN_CLASSES = ("function", "word", "number", "mixed", "symbol")
CHAR_CLASSES = ("letter", "digit", "space", "stop", "mark", "odd")
#: Weights of the four divergences: tokens, characters, sentences, repetition.
WEIGHTS = (1.0, 1.0, 1.5, 0.7)
#: Documents that :func:`fit` reads at most.
SAMPLE = 100_000
# The fitted profiles: shares of TOKEN_CLASSES, then of CHAR_CLASSES, then of characters
# inside and outside sentences, then of new and repeated pairs.
PROFILES = {
    "junk_broken": (0.087, 0.456, 0.007, 0.013, 0.439, 0.32, 0.007, 0.057, 0.15, 0.024, 0.441, 0.7, 0.3, 0.937, 0.063),
    "junk_code": (0.006, 0.199, 0.396, 0.014, 0.385, 0.303, 0.316, 0.077, 0.082, 0.223, 0.0, 0.0, 1.0, 0.913, 0.087),
    "junk_random": (0.001, 0.073, 0.004, 0.89, 0.032, 0.671, 0.26, 0.066, 0.0, 0.002, 0.0, 0.0, 1.0, 1.0, 0.0),
    "junk_repeated": (0.017, 0.47, 0.015, 0.278, 0.22, 0.552, 0.189, 0.094, 0.112, 0.052, 0.0, 0.0, 1.0, 0.043, 0.957),
    "junk_symbols": (0.036, 0.076, 0.215, 0.099, 0.574, 0.127, 0.215, 0.085, 0.127, 0.445, 0.0, 0.015, 0.985, 0.704, 0.296),
    "list_items": (0.086, 0.626, 0.124, 0.0, 0.165, 0.712, 0.027, 0.189, 0.035, 0.036, 0.0, 0.0, 1.0, 0.907, 0.093),
    "list_lines": (0.071, 0.796, 0.117, 0.0, 0.016, 0.814, 0.02, 0.149, 0.014, 0.003, 0.0, 0.0, 1.0, 0.907, 0.093),
    "prose_de": (0.365, 0.586, 0.048, 0.0, 0.001, 0.796, 0.019, 0.159, 0.025, 0.0, 0.0, 0.998, 0.002, 0.909, 0.091),
    "prose_en": (0.36, 0.603, 0.033, 0.002, 0.001, 0.798, 0.014, 0.163, 0.025, 0.0, 0.0, 0.998, 0.002, 0.939, 0.061),
    "prose_es": (0.366, 0.588, 0.044, 0.0, 0.001, 0.796, 0.017, 0.162, 0.024, 0.0, 0.0, 0.998, 0.002, 0.915, 0.085),
    "prose_fr": (0.369, 0.583, 0.047, 0.0, 0.001, 0.786, 0.02, 0.165, 0.029, 0.0, 0.0, 0.998, 0.002, 0.912, 0.088),
    "prose_zh": (0.316, 0.676, 0.007, 0.0, 0.001, 0.845, 0.051, 0.015, 0.088, 0.0, 0.0, 0.997, 0.003, 0.913, 0.087),
    "table": (0.008, 0.226, 0.49, 0.023, 0.252, 0.365, 0.282, 0.141, 0.12, 0.091, 0.0, 0.0, 1.0, 0.926, 0.074),
}

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_HAN = re.compile(r"[㐀-鿿]")
_SEGMENT = re.compile(r"(?<=[.!?…])[\"'”’»“)\]]*\s+|(?<=[。！？])[”’」』）]*|\n")
_ENDS = re.compile(r"(?:[.!?…。！？][\"'”’»“„)\]」』）]*|[。！？…][”」』）]*)\s*$")
_ITEM = re.compile(r"^\s*(?:[-–—•*·‣▪]|\d{1,3}[.)]|\[.?\]|[(（]\d{1,2}[)）])\s*")
_STOPS = ".,;:!?'\"()-–—…“”‘’«»„¿¡。，、；：！？《》（）·　"


def _table() -> dict[int, int]:
    t = {}
    for c in range(0x80):
        t[c] = 0 if chr(c).isalpha() else 1 if chr(c).isdigit() else 2 if chr(c).isspace() else 4
    t.update({ord(c): 3 for c in _STOPS})
    t.update({c: 5 for c in (*range(0x7F, 0xA0), 0xFFFD, 0xA4, 0xC2, 0xC3, 0xAD, *range(0, 9), *range(14, 32))})
    t[0xA0] = 2
    return t


_CLASS = np.zeros(0x3100, np.uint8)
for _c, _k in _table().items():
    if _c < len(_CLASS):  # full-width stops are counted by range
        _CLASS[_c] = _k
for _a, _b, _k in ((0xA1, 0xC0, 4), (0x2000, 0x200B, 2), (0x2010, 0x2070, 4), (0x2070, 0x2E00, 4), (0x3000, 0x3040, 4)):
    _CLASS[_a:_b] = np.where(_CLASS[_a:_b] == 0, _k, _CLASS[_a:_b])


def char_counts(text: str) -> np.ndarray:
    """Characters of ``text`` by CHAR_CLASSES; signs beyond the tables count as letters if they are
    ideographs or kana, U+FFFD and unpaired signs as odd, the rest as marks."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = codes < len(_CLASS)
    n = np.bincount(_CLASS[codes[low]], minlength=6)[:6].astype(float)
    high = codes[~low]
    if len(high):
        letters = ((high >= 0x3400) & (high < 0xD800)).sum()
        odd = ((high == 0xFFFD) | ((high >= 0xE000) & (high < 0xF900))).sum()
        stops = ((high >= 0xFF00) & (high < 0xFF70)).sum()
        n[0] += letters
        n[5] += odd
        n[3] += stops
        n[4] += len(high) - letters - odd - stops
    return n


def figures(text: str) -> dict:
    """All figures of one text."""
    tokens = _TOKEN.findall(text)
    han = _HAN.findall(text)
    kinds = np.zeros(5)
    letters_only = [t for t in tokens if t.isalpha()]
    lower = [t for t in " ".join(letters_only).lower().split(" ") if t and len(t) <= 25 and not (han and _HAN.search(t))]
    kinds[1] = len(lower)
    kinds[3] = sum(len(t) > 25 and not _HAN.match(t) for t in letters_only)
    for t in tokens if len(letters_only) < len(tokens) else ():
        if t.isalpha():
            continue
        if t[0].isalpha() or t[0].isdigit():
            if t.isdigit():
                kinds[2] += 1
            elif not (han and _HAN.search(t)):
                kinds[3] += 1
        elif t.strip(_STOPS):
            kinds[4] += 1
    best, common = ("zh", 0) if han else ("en", 0)
    known = [w for w in lower if w in _ANY]  # mostly short: the languages are tried on these alone
    for k in LANGS[:-1]:
        hits = sum(map(_SETS[k].__contains__, known))
        if hits > common:
            best, common = k, hits
    kinds[0], kinds[1] = common, kinds[1] - common
    if han:
        own = len(_ZH.findall(text))
        # two characters stand for a word
        kinds[0] += own
        kinds[1] += max(0, (len(han) - own) / 2)
        if len(han) > len(lower):
            best = "zh"
    chars = char_counts(text)
    inside, outside, n_lines, ended, items, longest = 0, 0, 0, 0, 0, 0
    for line in text.split("\n"):
        if not line.strip():
            continue
        n_lines += 1
        ended += _ENDS.search(line) is not None
        items += _ITEM.match(line) is not None
        for seg in _SEGMENT.split(line):
            n = len(seg)
            if n >= 6 and _ENDS.search(seg) and (seg.count(" ") >= 3 or len(_HAN.findall(seg)) >= 6):
                inside += n
            else:
                outside += n
    seen = lower if len(lower) >= len(han) else han
    pairs = list(zip(seen, seen[1:])) if len(seen) > 1 else list(zip(tokens, tokens[1:]))
    fresh = len(set(pairs))
    # long texts repeat pairs by nature: repetition is measured within stretches of 100 pairs
    if len(pairs) > 100:
        parts = [len(set(pairs[i : i + 100])) / len(pairs[i : i + 100]) for i in range(0, len(pairs), 100)]
        new = sum(parts) / len(parts)
    else:
        new = fresh / len(pairs) if pairs else 1.0
    n_words = len(lower) + int(kinds[2] + kinds[3]) + (len(han) + 1) // 2
    letters = sum(map(len, lower)) + len(han)
    size = max(1, len(text))
    return {
        "n_words": n_words,
        "mean_word_len": letters / max(1, len(lower) + (len(han) + 1) // 2),
        "symbol_ratio": float(chars[4] + chars[5]) / size,
        "line_end_share": ended / max(1, n_lines),
        "item_share": items / max(1, n_lines),
        "common_share": float(kinds[0] / max(1.0, kinds[0] + kinds[1])),
        "n_lines": n_lines,
        "best_lang": best,
        "tokens": kinds / max(1.0, kinds.sum()),
        "chars": chars / max(1.0, chars.sum()),
        "sentence": inside / max(1, inside + outside),
        "new": new,
    }


_COLUMNS = {
    "n_words": ("int", pa.int32()), "mean_word_len": ("double", pa.float64()), "symbol_ratio": ("double", pa.float64()), "line_end_share": ("double", pa.float64()), "item_share": ("double", pa.float64()),
    "common_share": ("double", pa.float64()), "n_lines": ("int", pa.int32()), "best_lang": ("string", pa.string()),
}
_CUTS = (0, len(TOKEN_CLASSES), len(TOKEN_CLASSES) + len(CHAR_CLASSES), len(TOKEN_CLASSES) + len(CHAR_CLASSES) + 2, len(TOKEN_CLASSES) + len(CHAR_CLASSES) + 4)
_WEIGHT = np.repeat(WEIGHTS, np.diff(_CUTS))


def distributions(found: list[dict]) -> np.ndarray:
    """The four distributions of each text, one after the other in a row."""
    return np.array([[*f["tokens"], *f["chars"], f["sentence"], 1 - f["sentence"], f["new"], 1 - f["new"]] for f in found]).reshape(len(found), _CUTS[-1])


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Weighted sums of the Jensen-Shannon divergences (base 2) of the four distributions, of each row of
    ``p`` to each row of ``q``."""
    a, b = p[:, None, :], q[None, :, :]
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(a > 0, a * np.log2(a / m), 0.0) + np.where(b > 0, b * np.log2(b / m), 0.0)
    return (parts * _WEIGHT).sum(axis=2) / 2


def _texts(df: DataFrame, text: str, key: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike(r"[^\s\x{85}\x{A0}\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]"))


def _seed() -> Column:
    """Typical documents of each profile, by plain rules; null for the rest."""
    t, c, s, new, common = (F.col(x) for x in ("tokens", "chars", "sentence", "new", "common_share"))
    return (
        F.when(c[5] >= 0.12, "junk_broken")
        .when(c[4] >= 0.4, "junk_symbols")
        .when((new <= 0.1) & (F.col("n_words") >= 20), "junk_repeated")
        .when((t[3] >= 0.45) & (s < 0.3), "junk_random")
        .when((s < 0.1) & (c[4] >= 0.2) & (c[0] >= 0.2), "junk_code")
        .when((s < 0.05) & (c[1] >= 0.12) & (F.col("n_lines") >= 3), "table")
        .when((s < 0.05) & (F.col("item_share") >= 0.7) & (F.col("n_lines") >= 4), "list_items")
        .when((s < 0.05) & (F.col("n_lines") >= 4) & (c[0] >= 0.6), "list_lines")
        .when((s >= 0.8) & (common >= 0.12) & (c[5] < 0.02), F.concat(F.lit("prose_"), F.col("best_lang")))
    )


def fit(df: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> dict[str, tuple[float, ...]]:
    """Profiles of the typical documents among at most ``sample`` of ``df``, those with the least hash of ``key``."""
    some = _texts(df, text, key).orderBy(F.xxhash64(F.col("k")), "k").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [figures(t) for t in batch.column("t").to_pylist()]
            arrays = [pa.array([f[n] for f in found], k) for n, (_, k) in _COLUMNS.items()] + [pa.array([list(f[n]) for f in found], pa.list_(pa.float64())) for n in ("tokens", "chars")]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([f[n] for f in found], pa.float64()) for n in ("sentence", "new"))], [*_COLUMNS, "tokens", "chars", "sentence", "new"])

    figs = some.mapInArrow(run, ", ".join(f"{n} {k}" for n, (k, _) in _COLUMNS.items()) + ", tokens array<double>, chars array<double>, sentence double, new double")
    dist = F.concat("tokens", "chars", F.array(F.col("sentence"), 1 - F.col("sentence")), F.array(F.col("new"), 1 - F.col("new")))
    seeds = figs.select(_seed().alias("name"), dist.alias("d")).where("name is not null")
    return {r["name"]: tuple(r["q"]) for r in seeds.groupBy("name").agg(F.array(*[F.avg(F.col("d")[i]) for i in range(_CUTS[-1])]).alias("q")).collect()}  # one row per profile


def text_quality(df: DataFrame, text: str = "text", key: str = "doc_id", profiles: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """``key``, n_words, mean_word_len, symbol_ratio, line_end_share, common_share, best_lang, profile,
    is_prose and divergence of every document with a text, in a narrow map without a shuffle.

    ``profile`` is the nearest one of ``profiles`` (PROFILES if not given), ``is_prose`` whether it is prose. Null,
    empty and blank texts have no row. Repeated rows are kept, columns
    other than the two are ignored; no rows give no rows.
    """
    known = dict(sorted((profiles or PROFILES).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = list(known), np.array(list(known.values()))
        for batch in batches:
            found = [figures(t) for t in batch.column("t").to_pylist()]
            js = divergences(distributions(found), q)
            best = js.argmin(axis=1) if len(found) else np.empty(0, int)
            arrays = [pa.array([f[n] for f in found], k) for n, (_, k) in _COLUMNS.items()]
            arrays += [pa.array([names[i] for i in best], pa.string()), pa.array(js[np.arange(len(found)), best], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *arrays], ["k", *_COLUMNS, "profile", "divergence"])

    kind = df.schema[key].dataType.simpleString()
    out = _texts(df, text, key).mapInArrow(run, f"k {kind}, " + ", ".join(f"{n} {k}" for n, (k, _) in _COLUMNS.items()) + ", profile string, divergence double")
    return out.select(
        F.col("k").alias(key), "n_words", "mean_word_len", "symbol_ratio", "line_end_share", "common_share", "best_lang", "profile", F.col("profile").startswith("prose").alias("is_prose"), "divergence",
    )


def not_prose(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` of the documents whose nearest profile is none of prose; see :func:`text_quality`."""
    return text_quality(df, text, key).where(~F.col("is_prose")).select(key)
