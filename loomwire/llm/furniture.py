"""Main body of a text that mixes it with page furniture (problem 3).

Each text is fed once to the standard library's HTML parser; its events give, for every line, the
characters of text and the number of tags. Plain text that was taken from a page has lost its
tags, but not the marks that the tagged elements leave: separators of menus and breadcrumbs,
counters, arrows, labels and set phrases. These count as tags of the line. The ratio of text to
tags of the lines is smoothed with a Gaussian over the neighbouring lines, so that a heading
follows the paragraphs or the link list it stands in, and the smoothed ratios are parted into two
clusters, content and furniture.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwire.llm.literals import Finder, alternatives
from loomwire.llm.residue import residue

#: Width of the Gaussian in lines.
SIGMA = 1.0
#: Text-to-tag ratios at which a line is surely content or surely furniture.
HIGH, LOW = 1.0, 0.0
UNENDED = 0.6

_END = regex.compile(r"[.!?…。！？][\"'”’»“」』)\]]*\s*$|[。！？…”」]\s*$")
#: The end of a sentence within a line.
_INNER_END = regex.compile(r"\p{Ll}[.!?][\"'”’»“]?\s+[\"'“‘«„]?\p{Lu}|[。！？]")
_CJK = regex.compile(r"\p{Han}")
_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}’'-]*")
_SCORE = regex.compile(r"^[\p{L}].{1,60}?\s?\d{1,3}\s*[,:–-]\s*.{0,60}?\s?\d{1,3}(\s*[(（][^()（）]{1,30}[)）])?\s*$")
_BULLET = regex.compile(r"^\s*(?:[-–—•*·‣▪]\s+|\d{1,3}[.)]\s+|[(（]\d{1,2}[)）]\s*)(?=\S)")
_LIVE = regex.compile(r"^\s*\d{1,2}[:.h]\d{2}\b")

# Marks that menus, breadcrumbs and counters leave in plain text.
_MENU = regex.compile(r"^\s*[\p{L}\p{M} ’'-]{2,24}(?:\s*(?:\s[|/>·•»›:—-]\s|\t|\s{2,})\s*[\p{L}\p{M} ’'-]{2,24})+\s*$")
_COUNTED = regex.compile(r"^\s*[\p{L}\p{M} ’'&-]{2,30}\s*(?:[(（]\d+[)）]|[›»>▾▼+])\s*$")
# Set phrases of page furniture in the five languages.
CUES = (
    # legal notices and footers
    r"©|\(c\) ?\d{4}|^copyright\b|all rights reserved|alle rechte vorbehalten|todos los derechos|tous droits|版权所有|未经.{0,20}(?:许可|同意)|不得转载|禁止转载",
    r"\bterms\b.*\bprivacy\b|\bprivacy\b.*\b(?:terms|contact|home)\b|^about\b.*[·|].*|impressum|datenschutz|aviso legal|privacidad\b.*\|.*|mentions légales|vie privée|隐私|联系我们|网站地图",
    r"\bnot responsible for\b|may not be (?:reproduced|copied|rewritten|republished)|written (?:consent|permission)|is offered under|may be kept for|nachdruck|vervielfältig|prohíbe|se prohíbe|sin permiso por escrito|no se hace responsable|reproduction (?:interdite|de ce)|sans (?:autorisation|accord) écrit|toute reproduction|übernimmt keine (?:haftung|verantwortung)|不承担|书面(?:同意|许可)",
    r"\b(?:media group|publishing|grupo editorial|verlag|groupe (?:de presse|éditorial)|传媒集团|报业集团)\b.*\d{4}|\d{4}.*\b(?:media group|verlag|grupo editorial)\b|^[^.]{2,40} (?:verlag|media group|grupo editorial|groupe) ?(?:[-–·|] ?)?\d{4}",
    # cookies
    r"cookies?\b|similar technolog|tecnologías similares|technologies similaires|ähnliche technologien|kleine dateien|petits fichiers|archivos propios|small files|\b\d+ (?:partners|socios|partenaires|partner|dienste)\b|合作伙伴|accept all|aceptar todo|tout accepter|alle akzeptieren",
    # newsletters, sharing, comments, apps
    r"newsletters?\b|boletín|boletines de|rundbrief|lettre d.info|recevez la lettre|reciba el|订阅|简报|subscribe\b|suscríbase|suscríbete|abonnez|abonnieren|\bab \d+ im monat|\bpour \d+ par mois|\bpor \d+ al mes|\bfor \d+ a month|cancel anytime|alerts on your phone|benachrichtigungen|alertas|alertes|get .{2,30} alerts",
    r"^(?:join|únase a|rejoignez|schon|ya somos) .{0,14}\d+ .{0,30}(?:readers?|lectores|lecteurs|leser|followers)|\breaders of the\b.*\bbriefing\b|readers? folg|leser folgen|briefing\b",
    r"^share\b|shares? so far|^partager\b|\bpartages\b|^compart|veces compartido|compartid[oa]s?\b|diesen beitrag|mal geteilt|分享(?:这篇|本文|到|至)|次分享|转发本文",
    r"^follow\b.{2,60}(?:\bfor\b|\bon\b)|^sigue\s+a\b|^suivez\b|^folgen sie|^folge\b|no pierdas nada|tout savoir sur|nichts mehr verpassen|verpassen sie|^关注.{2,20}[,，]|不错过|扫码|下载(?:客户端|应用)|download (?:our|the) app|descargue|téléchargez|laden sie unsere",
    r"\d+ (?:comments?|kommentare|commentaires?|comentarios)\b|条评论|join the discussion|only registered|registered readers|leave a comment|deja un comentario|únete a la conversación|see the .{1,12}comments",
    # tips, checks, corrections, advertising
    r"have a tip\?|got a tip|write to the .{2,20} desk|¿.{0,40}(?:pista|dato|información)|escriba a la|une information \?|écrivez à|hinweis .{0,20}\?|schreiben sie an|有.{1,8}线索|联系.{2,16}[。.]?$",
    r"^last checked|^relu par|^revisad[oa] por|^zuletzt geprüft|核对$|于\d{1,2}[:：]\d{2}核对|^(?:first )?(?:published|updated|posted|actualizado|publicado|publié|mis à jour|veröffentlicht|aktualisiert)\b|^(?:发布|更新)(?:时间|于)|last (?:updated|modified)|(?:prices|precios|prix|preise) (?:and|y|et|und) .{2,30} (?:were|eran|étaient|waren)\b|^this (?:report|story|article) was first|^este (?:informe|texto) (?:se|fue)|^dieser (?:bericht|text) (?:ging|wurde|erschien)|^cet article (?:a été|est)|本文(?:首发|最初|由)",
    r"^advertis|^ad\b|^ads\b|^sponsored|^promoted|^publicidad\b|^publicité\b|^anzeige\b|^werbung\b|^werben\b|^anúnciese|^anuncio\b|^annonce\b|广告|推广|赞助|^(?:story|article) continues|^continúa|^la suite après|^weiter nach|^scroll\b",
    # bylines, photos, tags
    r"^(?:记者|作者|编辑|文/|文：|责任编辑|撰文|通讯员|本报记者)",
    r"^(?:photo|photograph|picture|image|foto|fotografía|imagen|bild|crédit|credit|photographie|图片|摄影|图/|图：|供图)\w{0,4} ?[:：/ ]|\b(?:pool|getty|agency)\s*$|摄$",
    r"^(?:tags?|topics?|filed under|keywords?|etiquetas|temas|schlagwörter|schlagworte|themen|mots[ -]clés|thèmes|标签|关键词|关键字) ?[:：]",
    # skip links and controls
    r"^(?:skip|jump) (?:to|navigation)|^navigation (?:überspringen|überblättern)$|^无障碍|^(?:saltar|ir) al? |^(?:aller|passer) (?:au|à)|^(?:zum|direkt zum|weiter zum) |^跳(?:到|至|转)|^(?:back to|zurück|volver|retour|haut de|返回|回到)\b.{0,20}$|返回顶部|^(?:open|close|toggle|show|hide|abrir|cerrar|ouvrir|fermer|öffnen|menü|menu|menú|suche|search|buscar|rechercher|搜索|菜单|登录|注册|我的账户)\b.{0,22}$|^(?:打开|关闭|展开)",
    r"^(?:sign in|log in|sign up|register|my account|iniciar sesión|mi cuenta|se connecter|mon compte|anmelden|mein konto|einloggen|registrarse|s.inscrire)\b.{0,14}$",
    # other stories
    r"^(?:read (?:more|also|next)|see also|watch|video|listen|more|lea también|le(?:e|a) más|vea|vídeo|ver también|lire aussi|à lire|voir aussi|vidéo|lesen sie|mehr zum|auch interessant|video|sehen sie|延伸阅读|相关阅读|阅读更多|另见|视频|点击)\b ?[:：]?",
    r"^(?:read more|watch|lire aussi|lea también|lesen sie auch) ",
    r"^(?:most read|popular (?:today|now)|trending|recommended|related|editor.?s.? picks?|you (?:may|might) (?:also )?like|in case you missed|from our partners|more (?:on|from)|top (?:videos|stories)|also in|latest|what to read|don.t miss|around the web)\b.{0,24}$",
    r"^(?:lo (?:más leído|último)|lo más|más (?:noticias|de|sobre|leíd\w*)|también te|te puede|le puede|relacionad\w*|noticias relacionadas|recomendad\w*|destacad\w*|de nuestros|contenidos? patrocinad\w*|en otras|no se pierda|no te lo pierdas|hoy (?:en|se|destacamos)|vídeos? destacad\w*|tendencias)\b.{0,24}$",
    r"^(?:les plus lus|à la une|sur le même|vous aimerez|en ce moment|plus (?:de|sur|d.)|articles? (?:liés|les)|tendances|de nos partenaires|contenus? (?:sponsoris\w*|partenaires?)|nos (?:partenaires|recommandations)|en vidéo|à ne pas|dernières|populaire|recommandé|le choix|à découvrir|dans la même)\b.{0,24}$",
    r"^(?:lesetipps?|meistgelesen|heute beliebt|beliebt|mehr (?:zu|aus|von)|das könnte|auch interessant|ähnliche|weitere|unsere partner|von unseren|gesponserte?|empfohlen|top-?videos|videos? des tages|aus dem ressort|im trend|nicht verpassen|aktuelle?s?|neueste|außerdem)\b.{0,24}$",
    r"^(?:相关(?:阅读|新闻|报道)|热门|最新|推荐|猜你喜欢|更多|编辑推荐|视频精选|精选视频|今日|大家都在看|合作|热点|精选|往期|排行)[一-鿿]{0,8}[:：]?$",
)
_CUES = [c for cue in CUES for c in alternatives(cue)]
_FINDER = Finder(_CUES)
_CUES = [re.compile(c, re.I) for c in _CUES]


def n_cues(line: str) -> int:
    """How often CUES fit in ``line``; only those are tried of which a string that they need is there."""
    return sum(sum(1 for _ in _CUES[i].finditer(line)) for i in _FINDER.candidates(line))


def has_cue(line: str) -> bool:
    """Whether one of the CUES fits ``line``."""
    return any(_CUES[i].search(line) for i in _FINDER.candidates(line))


#: From this length, in characters, a line is a paragraph: a cue in it is one tag among so much text.
PARAGRAPH = 260
#: Longest line in which the outlet's name counts, and the shortest such name, unless it is Chinese.
_OUTLET_SHORT, _OUTLET_LEAST = 140, 6


class _Events(HTMLParser):
    """Characters of text and number of tags by line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)

    def measure(self, text: str) -> tuple[list[str], np.ndarray]:
        self.reset()
        self.lines, self.tags, self.at = [[]], [0], 0
        try:
            self.feed(text)
            self.close()
        except AssertionError:  # hopeless markup is text
            return text.split("\n"), np.zeros(text.count("\n") + 1)
        lines = ["".join(x) for x in self.lines]
        want = text.count("\n") + 1
        if len(lines) != want:  # a line feed inside a tag or comment
            return text.split("\n"), np.array([x.count("<") for x in text.split("\n")], float)
        return lines, np.array(self.tags, float)

    def handle_data(self, data: str) -> None:
        first, *more = data.split("\n")
        self.lines[-1].append(first)
        for x in more:
            self.lines.append([x])
            self.tags.append(0)

    def handle_starttag(self, tag, attrs):
        self.tags[-1] += 1

    def handle_endtag(self, tag):
        self.tags[-1] += 1

    def handle_entityref(self, name):
        self.lines[-1].append(f"&{name};")

    def handle_charref(self, name):
        self.lines[-1].append(f"&#{name};")

    def handle_comment(self, data):
        self.tags[-1] += 1
        for _ in range(data.count("\n")):
            self.lines.append([])
            self.tags.append(0)


def left_tags(line: str, outlet: str) -> float:
    """Number of tags that the marks left in ``line`` stand for: 0 in prose, 1 or more in furniture."""
    x = line.strip()
    if len(x) > PARAGRAPH:
        return n_cues(x) * PARAGRAPH / len(x)
    if has_cue(x) or _BYLINE.match(x):
        return 2.0
    if _BULLET.match(x):
        return 0.0
    if _COUNTED.match(x) or (_MENU.match(x) and not _SCORE.match(x)):
        return 3.0
    if (len(outlet) >= _OUTLET_LEAST or _CJK.match(outlet)) and len(x) <= _OUTLET_SHORT and outlet in x.casefold() and not _SAYS.search(x):
        return 2.0
    return 1.5 if _TITLES.match(x) else 0.0


_SAYS = regex.compile(r"[“”«»„\"]")
#: A name after a word for the author, or a name and a place or desk, with nothing else.
_BYLINE = regex.compile(
    r"^(?:(?i:by|words by|text by|written by|reported by|story by|von|text:|texte ?:|texto de|texto:|por|par|redaktion:|redacción:|rédaction :) ?\p{Lu}[\p{L}’'-]+ \p{Lu}[\p{L}’'-]+(?:[,|·–/-].{0,50}| (?:in|en|à|aus|IN|EN|À) \p{Lu}.{1,30})?"
    r"|\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+(?:,| in| en| à) \p{Lu}[\p{L} ]{2,40})$"
)
#: Three words or more, all capitalised, or short Chinese words between blanks, without a mark: a menu.
_TITLES = regex.compile(r"^(?:\p{Lu}[\p{L}’'-]*(?: (?:in|al|sesión|account|tiempo|connecter|cuenta|compte|und|y|et))?(?:\s+|$)){3,}$|^\p{Han}{2,4}(?: \p{Han}{2,4})+$")


def ratio(line: str, tags: float, outlet: str) -> float:
    """Text-to-tag ratio of a line, scaled to 0 (furniture) ... 1 (content). Lines that are no
    sentences and bear no mark stand between: long ones like headlines below, short ones like
    sub-headings above the middle; their neighbours decide."""
    n = left_tags(line, outlet) + tags
    x = line.strip()
    if len(x) > PARAGRAPH:
        return HIGH / (1 + n)
    if n >= 2:
        return LOW
    if n >= 1.5:
        return 0.2
    han = len(_CJK.findall(x))
    size = han + len(_WORD.findall(x))
    if _END.search(x) or _SCORE.match(x) or _BULLET.match(x) or _LIVE.match(x):
        return HIGH / (1 + n)
    if size > (60 if han > 5 else 30) or (size >= 10 and _INNER_END.search(x)):
        return HIGH / (1 + n)
    head = x.split(":")[0].split("：")[0]
    short = len(_CJK.findall(head)) <= 9 if han > 2 else len(_WORD.findall(head)) <= 5 and size <= 9
    single = size <= 4 if han else size == 1
    return 0.55 if short and not single else 0.3


@lru_cache(maxsize=1 << 16)
def _cached(line: str, outlet: str) -> float:
    return ratio(line, 0.0, outlet)


_DIGIT = re.compile(r"\d")


def _smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    if len(values) < 2 or sigma <= 0:
        return values
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[reach:-reach] / np.convolve(np.ones(len(values)), kernel)[reach:-reach]


def _threshold(values: np.ndarray) -> float:
    """Border of two clusters on a line, from the fixed ends HIGH and LOW; two rounds of means."""
    t = (HIGH + LOW) / 2
    for _ in range(2):
        up, down = values[values >= t], values[values < t]
        a = (up.sum() + HIGH) / (len(up) + 1)
        b = (down.sum() + LOW) / (len(down) + 1)
        t = (a + b) / 2
    return t


def line_ratios(text: str, outlet: str = "", parser: _Events | None = None) -> tuple[list[int], np.ndarray]:
    """Indices (from 0) of the non-blank lines of ``text`` and their text-to-tag ratios."""
    lines, tags = (parser or _Events()).measure(text) if "<" in text else (text.split("\n"), None)
    rows = [i for i, x in enumerate(lines) if x.strip("​⁠﻿").strip()]
    if not rows:
        return [], np.empty(0)
    name = outlet.casefold().strip()
    # lines that recur but for their digits are measured once; run lengths stay, and so do the digits if the outlet's name has some
    folded = (lambda x: x) if _DIGIT.search(name) else (lambda x: _DIGIT.sub("7", x))
    # paragraphs hardly ever recur, so they are measured as they are
    r = np.array([_cached(folded(lines[i]), name) if len(lines[i]) <= PARAGRAPH and (tags is None or not tags[i]) else ratio(lines[i], 0.0 if tags is None else tags[i], name) for i in rows])
    return rows, r


def body_mask(text: str, outlet: str = "", sigma: float = SIGMA, parser: _Events | None = None) -> tuple[list[int], list[bool]]:
    """Numbers (from 1) of the non-blank lines of ``text``, and whether each belongs to the body."""
    rows, r = line_ratios(text, outlet, parser)
    if not rows:
        return [], []
    if (len(r) == 1 or r[-2] >= HIGH) and 0.2 < r[-1] < HIGH:
        r[-1] = UNENDED  # after a paragraph or alone, the last line is one that was cut rather than a headline
    mixed = 0.5 * r + 0.5 * _smooth(r, sigma)
    t = _threshold(mixed)
    return [i + 1 for i in rows], [bool(x) for x in mixed >= t]


def line_classes(df: DataFrame, text: str = "raw", key: str = "item_id", source: str = "source_name", sigma: float = SIGMA) -> DataFrame:
    """``key``, line_no, is_body of every non-blank line, in a narrow map without a shuffle.

    ``line_no`` counts the pieces between line feeds from 1. Null, empty and blank texts have no
    line; a null source only lacks its outlet's name as a mark. Repeated rows are read each by
    itself, columns other than the three are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _Events()
        for batch in batches:
            at, no, body = [], [], []
            for i, (t, o) in enumerate(zip(batch.column("t").to_pylist(), batch.column("o").to_pylist())):
                n, b = body_mask(t, o or "", sigma, parser)
                at += [i] * len(n)
                no += n
                body += b
            keys = batch.column("k").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(no, pa.int32()), pa.array(body, pa.bool_())], ["k", "line_no", "is_body"])

    kind = df.schema[key].dataType.simpleString()
    src = df.select(F.col(key).alias("k"), F.col(source).cast("string").alias("o"), F.col(text).alias("t")).where("t is not null and t <> ''")
    return src.mapInArrow(run, f"k {kind}, line_no int, is_body boolean").withColumnRenamed("k", key)


def furniture_lines(df: DataFrame, text: str = "raw", key: str = "item_id", source: str = "source_name") -> DataFrame:
    """``key``, line_no of the non-blank lines that are not main body; records that
    :func:`loomwire.llm.residue.residue` names have none. See :func:`line_classes`."""
    out = residue(df, text, key, source).select(F.col(key).alias("__key"))
    lines = line_classes(df, text, key, source).where(~F.col("is_body"))
    return lines.join(out, F.col(key) == F.col("__key"), "left_anti").select(key, "line_no")


def main_body(df: DataFrame, text: str = "raw", key: str = "item_id", source: str = "source_name", sigma: float = SIGMA) -> DataFrame:
    """``key`` and body: the lines of the main body of each text, with the blank lines between them;
    null for a null text, empty if nothing is body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _Events()
        for batch in batches:
            out = []
            for t, o in zip(batch.column("t").to_pylist(), batch.column("o").to_pylist()):
                if t is None:
                    out.append(None)
                    continue
                drop = {n for n, b in zip(*body_mask(t, o or "", sigma, parser)) if not b}
                kept = "\n".join(x for n, x in enumerate(t.split("\n"), 1) if n not in drop)
                out.append(regex.sub(r"\n\s*\n\s*\n+", "\n\n", kept).strip())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, pa.string())], ["k", "body"])

    kind = df.schema[key].dataType.simpleString()
    src = df.select(F.col(key).alias("k"), F.col(source).cast("string").alias("o"), F.col(text).alias("t"))
    return src.mapInArrow(run, f"k {kind}, body string").withColumnRenamed("k", key)
