"""Template residue, filler, error pages and script notices in place of content (problem 1).

Lines are counted by host in normalised form; what recurs there is boilerplate and is taken out
of a record that has other lines. What is left of a record is its residual, and the evidence is
read from the residual only: a slot, an unset value, filler or a bare status line in any line of
it; text of an error page or a demand for scripts where a good part of the residual's sentences
is of that kind, however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwire.functions.urls import host
from loomwire.llm.lines import MIN_ROWS, MIN_SHARE, frequent_lines, line_identity
from loomwire.llm.literals import Finder, alternatives, required

#: Least share of the sentences of a residual that are text of an error page or notice.
PAGE_SHARE = 1 / 3
#: Least share of filler words in a line of filler, and the least number of its words.
FILLER_SHARE, FILLER_WORDS = 0.25, 4
#: A line of so many words, nearly all in lower case, is prose only if it has a function word.
PROSE_WORDS, LOWER_SHARE = 6, 0.7

# What unfilled slots look like in the usual template languages and newsroom notes.
SLOT = (
    r"\{\{|\}\}|\{%|%\}|<%|%>|[$#]\{|\{[a-z]+(?:_[a-z]+)*\}|\[\[[^\]]*\]\]|\[(?:/|)(?:if|each|for|end)\b[^\]]*\]|@@\w+@@"
    r"|%[A-Z][A-Z_]{2,}%|__[A-Z][A-Z_]+__|\[[A-Z_ ]+ TK\]|\bTK TK\b|\[INSERT [^\]]+\]|<[a-z_ ]+ goes here>|\[object Object\]|\bNaN\b"
)
UNSET = r"\[object Object\]|\b(?:null|None|undefined|NaN|nil|N/A)\b"
# Words of the customary pseudo-Latin filler.
FILLER = "lorem ipsum dolor sit amet consectetur consec adipiscing adipe elit elitu tempor magnis magna velit tolis aliqua"
# Sentences that stand in for a text, in the five languages.
STAND_IN = (
    r"(?i)^\W*(?:(?:placeholder|sample|dummy|filler) (?:copy|text|paragraph|content)\b|(?:your |the )?(?:story |body |article )?text (?:goes )?here\b"
    r"|replace this text|platzhalter\b|blindtext\b|hier steht (?:(?:der|ihr|ein) )?(?:blind|platzhalter)?text|texto de (?:ejemplo|relleno|muestra)\b|aquí va el texto|ici le (?:corps|texte)\b"
    r"|texte (?:à remplacer|d.exemple|ici)\b|正文占位|(?:此处|这里|以下)?(?:为|是)?示例文(?:字|本)|此处(?:填写|输入)|占位(?:文字|文本|内容))"
)
# How error, block and check pages begin, and the log lines of servers.
PAGE = (
    r"(?i)^\W*(?:(?:http )?(?:error |status )?(?:4[0-3]\d|5[0-2]\d)\b(?! ?(?:million|people|fans|members|comments?|comentarios?|commentaires?|kommentare?))|access (?:to this \w+ has been )?denied\b|you (?:have been blocked|do not have permission)"
    r"|(?:automated|unusual) traffic|your (?:request|browser) (?:looks|was|has)|(?:sorry|oops|we are sorry|we.re sorry|well, this is awkward)[,:! ]"
    r"|the (?:requested|page you|server is|site is)\b|page not found|checking your browser|just a moment\b|one more step\b|verifying you are|press and hold|complete the (?:check|captcha)"
    r"|are you (?:a robot|human)|too many requests|upstream connect|bad gateway|gateway time|service unavailable|internal server error|fatal error\b|warning: |error establishing|\w*(?:exception|error): |traceback \("
    r"|(?:your )?session (?:has )?(?:expired|timed out)|(?:diese )?seite (?:wurde )?(?:nicht|gibt es nicht)|der dienst ist|(?:(?:ihre|die|deine) )?sitzung (?:ist )?abgelaufen|zugriff (?:verweigert|nicht)"
    r"|página no encontrada|la página (?:que busca|solicitada)|no se ha podido|(?:(?:su|la|tu) )?sesión (?:ha |está )?(?:caducad[oa]|expirad[oa])|acceso denegado|servicio (?:temporalmente )?no disponible"
    r"|page introuvable|cette page n|service momentanément|(?:votre|la) session (?:a|est) expiré|votre session|accès refusé|erreur \d{3}"
    r"|(?:页面|网页).{0,8}(?:失败|出错|错误|无法|不存在)|错误(?:代码|码)|抱歉|对不起|服务器(?:繁忙|错误)|系统繁忙|登录(?:状态)?已(?:过期|失效)|会话已?(?:过期|超时)|访问(?:过于频繁|被拒绝|受限)|页面不存在|您的访问|请完成验证|您没有权限)"
)
# Words for scripts, and a demand for them, in the five languages; none if it is for comments beside an article.
SCRIPT_WORDS = r"javascript|\bscript(?:s|ing)?\b|\bskripte?\b|脚本"
DEMAND = (
    r"(?:enable|turn on|switch on|allow|activate|requires?|needs?|without|only with|without your|active|habilite|permita|activer|nécessite|autorisez|autorisez les|permita los|aktivieren sie|benötigt|ohne|erlauben sie"
    r"|启用|开启|需要|未开启|请启用) ?(?:javascript|scripts?|scripting|skripte?|脚本)"
)
FOR_COMMENTS = r"comments?\b|kommentar|commentaire|comentario|评论"
# Function words of the four languages that are written with blanks.
FUNCTION = (
    "the of and to in a is that for it was on with as at by from be are this have had has not but they he she who which or an their its will would "
    "de la que el en y los se del las un por con no una su para es al lo como más sin sobre este ya "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am "
    "le et les du une est pour qui dans par plus pas au sur ne ce il sont avec son aux mais ou comme on"
)
# A whole line that is a server's answer or the log of a program, wherever it stands.
STATUS = (
    r"^\W*(?:http )?(?:error |status )*(?:code )?[45]\d\d[ :–-]+(?:bad request|unauthori[sz]ed|payment required|forbidden|(?:page |file )?not found|method not allowed|not acceptable|request time-?out|conflict|gone|too many requests|internal server error"
    r"|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)\W*$|^\W*http (?:error|status) [45]\d\d\W*$|^\W*(?:fatal error|warning|notice|parse error): .*\bline \d+\W*$|^\W*traceback \(most recent call last\)|^\W*upstream connect error\b"
)
# What error pages say after their first sentence.
AFTER = (
    r"^\W*(?:please (?:try|check|wait|go back|contact|reload|refresh|complete|stand by)|(?:if|should) (?:the|this) (?:problem|error)|try (?:again|reload)|(?:your )?(?:request|incident|reference|ray|error|support|event) (?:id|no|number|code)\b|this process is|you (?:will be|can return|may (?:need|not))"
    r"|(?:go )?back to|return to|contact (?:us|the)|reload|refresh|(?:nginx|apache|cloudflare|varnish|openresty)\b|at \S+\(.*\)$|file \".*\", line|#\d+ |bitte (?:versuchen|melden|warten|laden|prüfen|später)|(?:por favor|inténtelo|vuelva|inicie|espere|regrese)\b"
    r"|(?:veuillez|réessayez|merci de|reconnectez|retour)\b|请(?:稍后|重新|刷新|返回|联系|检查|重试))"
)


_IN_PART = {"slot": re.compile(SLOT), "filler": re.compile(STAND_IN), "error": re.compile(STATUS, re.I)}
_UNSET, _PAGE, _AFTER, _SCRIPT_WORD = re.compile(UNSET), re.compile(PAGE), re.compile(AFTER, re.I), re.compile(SCRIPT_WORDS, re.I)
_DEMAND, _FOR_COMMENTS = re.compile(DEMAND, re.I), re.compile(FOR_COMMENTS, re.I)
_FILLER, _FUNCTION = frozenset(FILLER.split()), frozenset(FUNCTION.split())
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
#: A line that begins with the code of an answer.
_CODE = re.compile(r"\W*(?:http )?(?:error |status )*(?:code )?[45]\d\d\b", re.I)
_STOPS = str.maketrans(".,;:!?", "      ")


def _page_parts() -> list[str]:
    """The alternatives of PAGE and STATUS that do not begin with a code, which need strings of their own."""
    page = alternatives(PAGE[PAGE.index("(?:") + 3 : -1])
    return [x for x in (*page, *alternatives(STATUS)) if not any(s.isdigit() or s == "http " for s in required(x)) and "[45]" not in x]


def is_filler(line: str) -> bool:
    """Whether a line is pseudo-Latin: by its words, or because it reads like prose without one function
    word of the languages written here."""
    words = line.lower().translate(_STOPS).split()
    prose = _FUNCTION.isdisjoint(words) and len(words) >= PROSE_WORDS
    if not prose and _FILLER.isdisjoint(words):
        return False
    known = _WORD.findall(line)
    if len(known) >= FILLER_WORDS and sum(w.lower() in _FILLER for w in known) >= FILLER_SHARE * len(known):
        return True
    return prose and len(known) >= PROSE_WORDS and sum(w[0].islower() for w in known) >= LOWER_SHARE * len(known)


def in_part(line: str) -> str | None:
    """Kind of evidence that counts in any line of the residual, else null."""
    if _UNSET.search(line) and sum(map(len, _WORD.findall(_UNSET.sub("", line)))) <= 8:
        return "unset"
    for kind, pattern in _IN_PART.items():
        if pattern.search(line):
            return kind
    return "filler" if is_filler(line) else None


def as_page(sentence: str) -> str | None:
    """Kind of page that ``sentence`` begins or demands, else null."""
    if _SCRIPT_WORD.search(sentence) and _DEMAND.search(sentence) and not _FOR_COMMENTS.search(sentence):
        return "scripts"
    return "error" if _PAGE.match(sentence) else None


def _pieces(line: str) -> tuple[int, int, str | None]:
    """Sentences of a line, how many of them are text of an error page or notice, and the first kind."""
    parts = [x for x in _SENTENCE.split(line) if x.strip()]
    kinds = [as_page(x) for x in parts]
    first = next((k for k in kinds if k), None)
    return len(parts), sum(k is not None or _AFTER.match(x) is not None for k, x in zip(kinds, parts)), first


def _suspects(df: DataFrame, text: str, key: str, source: str) -> DataFrame:
    """key, source, line_no, line, part, page, n and of (sentences of the line, and those of a page) of
    all non-blank lines of the texts of which one line bears evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder([SLOT, UNSET, STAND_IN.removeprefix("(?i)"), SCRIPT_WORDS, *_page_parts()])
        names = ["line_no", "line", "part", "page", "n", "of"]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column("t").to_pylist()):
                lines = t.split("\n")
                if not finder.any(t) and not any(_CODE.match(x) or is_filler(x) for x in lines):
                    continue
                found = [(n, x, in_part(x), *_pieces(x)) for n, x in enumerate(lines, 1) if x.strip("\u200b\u2060\ufeff \t\r") and x.strip()]
                if any(f[2] or f[5] for f in found):
                    at += [i] * len(found)
                    out += [(n, x, part, page, size, of) for n, x, part, size, of, page in found]
            rows = pa.array(at, pa.int64())
            arrays = [b.column("k").take(rows), b.column("s").take(rows), *(pa.array([o[j] for o in out], k) for j, k in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "source", *names])

    columns = f"key {df.schema[key].dataType.simpleString()}, source {df.schema[source].dataType.simpleString()}, line_no int, line string, part string, page string, n int, of int"
    return df.select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(text).alias("t")).where("t <> ''").mapInArrow(run, columns)


def residue(df: DataFrame, text: str = "raw", key: str = "item_id", source: str = "source_name", min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, url: str = "url") -> DataFrame:
    """``key``, kind (slot, unset, filler, scripts, error) and line_no of the first evidence of each
    record to leave out; one row per record.

    The host is that of ``url`` where ``df`` has such a column and a host can be read, else ``source``.
    ``key`` must be unique. Records with a null, empty or blank text have no row. Lines that recur
    at the host are no evidence unless the record has nothing else. A null host is a host of
    its own; other columns are ignored; no rows give no rows.
    """
    at = F.coalesce(host(F.col(url)), F.col(source).cast("string")) if url in df.columns and df.schema[url].dataType.typeName() == "string" else F.col(source)
    df = df.select(F.col(key).alias("key"), at.alias("source"), F.col(text).alias("text"))
    often = frequent_lines(df, "text", "source", min_rows, min_share).select(F.col("source").alias("os"), F.col("k1").alias("o1"))
    lines = _suspects(df, "text", "key", "source").select("*", line_identity(F.col("line"))[0]).drop("line")
    marked = lines.join(often, F.col("source").eqNullSafe(F.col("os")) & (F.col("k1") == F.col("o1")), "left")
    own = F.col("o1").isNull()
    first = {"part": F.struct("line_no", F.col("part").alias("kind")), "page": F.struct("line_no", F.col("page").alias("kind"))}
    whole = marked.groupBy("key").agg(
        F.bool_or(own).alias("has_own"),
        *[F.sum(F.when(own, F.col(c))).alias(f"{c}_own") for c in ("n", "of")],
        *[F.sum(c).alias(f"{c}_any") for c in ("n", "of")],
        *[F.min(F.when(own & F.col(c).isNotNull(), x)).alias(f"{c}_own") for c, x in first.items()],
        *[F.min(F.when(F.col(c).isNotNull(), x)).alias(f"{c}_any") for c, x in first.items()],
    )
    n, of, part, page = (F.when(F.col("has_own"), F.col(f"{c}_own")).otherwise(F.col(f"{c}_any")) for c in ("n", "of", "part", "page"))
    found = whole.select("key", F.coalesce(part, F.when(of >= F.lit(PAGE_SHARE) * n, page)).alias("e")).where("e is not null")
    return found.select(F.col("key").alias(key), F.col("e.kind").alias("kind"), F.col("e.line_no").alias("line_no"))


def without_residue(df: DataFrame, text: str = "raw", key: str = "item_id", source: str = "source_name") -> DataFrame:
    """The rows of ``df`` that :func:`residue` does not name, with all their columns; a null key is kept."""
    out = residue(df, text, key, source).select(F.col(key).alias("__key"))
    return df.join(out, df[key] == out["__key"], "left_anti")
