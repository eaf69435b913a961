"""Batched AI clients and what is done with their replies."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire.schema import DEDUPE_REPLY, SUMMARY_REPLY

# How many bullets a summary has, and their least length.
BULLETS, BULLET_CHARS = (2, 5), 10
#: Items of a request, new and known ones each.
REQUEST_ITEMS = 200

#: What a client is told about its task; {language} is filled in.
DEDUPE_TASK = (
    'The input is an object with "fetched" and "covered", two lists of news items. Name the hash_id of every item of fetched that should not be shown: items about an event that an item of covered reports, '
    "unless they bring a development that clearly changes the story; and, of several items of fetched about one event, all but the one with the latest state of affairs. "
    'Items that merely share a topic are different. Answer with JSON alone: {{"ids": [...]}}, an empty list if nothing is to go.'
)
SUMMARY_TASK = (
    'The input is a list of news items with their texts. Answer with JSON alone: {{"items": [...]}}, one entry for each item, in the same order, with its hash_id unchanged, a telling title in {language}, and '
    "two to four bullets in {language}, each a full sentence with facts of the text, none twice. Use typographic quotation marks inside the texts. Add nothing that the item does not say."
)
# The shapes of the replies, as JSON schemas.
DEDUPE_SHAPE = {"type": "object", "properties": {"ids": {"type": "array", "items": {"type": "string"}}}, "required": ["ids"], "additionalProperties": False}
_ITEM_SHAPE = {
    "type": "object",
    "properties": {"hash_id": {"type": "string", "minLength": 1}, "title": {"type": "string", "minLength": 1}, "bullets": {"type": "array", "items": {"type": "string", "minLength": BULLET_CHARS}, "minItems": BULLETS[0], "maxItems": BULLETS[1]}},
    "required": ["hash_id", "title", "bullets"], "additionalProperties": False,
}
SUMMARY_SHAPE = {"type": "object", "properties": {"items": {"type": "array", "items": _ITEM_SHAPE}}, "required": ["items"], "additionalProperties": False}


class AIClient(Protocol):
    """Anything that answers a batch of prompts; it must be picklable. One that has with_task(instruction,
    shape), as :class:`loomwire.clients.HttpAIClient`, is told its task; others know it."""

    def ask(self, prompts: list[str]) -> list[str]: ...


def _tasked(client: AIClient, task: str, shape: dict, language: str = "English") -> AIClient:
    return client.with_task(task.format(language=language), shape) if hasattr(client, "with_task") else client


class FakeAIClient:
    """Deterministic client for tests and offline runs: a function of the decoded payload."""

    def __init__(self, answer: Callable[[dict | list], dict]) -> None:
        self.answer = answer

    def ask(self, prompts: list[str]) -> list[str]:
        return [json.dumps(self.answer(json.loads(p)), ensure_ascii=False) for p in prompts]


def same_titles(payload: dict) -> dict:
    """Fake answer to a dedupe request: the items whose title is covered already."""
    known = {x.get("title") for x in payload["covered"]}
    return {"ids": [x["hash_id"] for x in payload["fetched"] if x.get("title") in known]}


def repair_json(text: str) -> str:
    """Near-JSON made JSON: fences and talk around it go, so do trailing commas; open brackets are closed."""
    t = re.sub(r"^.*?```(?:json)?\s*|\s*```.*$", "", text, flags=re.S) if "```" in text else text
    start = min((i for i in (t.find("{"), t.find("[")) if i >= 0), default=-1)
    if start < 0:
        return text
    t = t[start:]
    try:
        json.loads(t)
        return t
    except ValueError:
        t = _plain_json(t)
    t = re.sub(r",\s*([}\]])", r"\1", t)
    stack, inside, escaped, end = [], False, False, len(t)
    for i, c in enumerate(t):
        if inside:
            inside, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            if not stack:
                end = i + 1
                break
    return re.sub(r",\s*$", "", t[:end] + ('"' if inside else "")) + "".join(reversed(stack))


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|//[^\n]*|/\*.*?\*/|[A-Za-z_$][\w$]*(?=\s*:)|\b(?:True|False|None|undefined)\b', re.S)


def _plain_json(text: str) -> str:
    """Texts in single quotes, keys without quotes, comments and names of other languages' constants made JSON."""
    names = {"True": "true", "False": "false", "None": "null", "undefined": "null"}

    def one(m: re.Match) -> str:
        x = m[0]
        if x[0] == '"':
            return x
        if x[0] == "'":
            return json.dumps(x[1:-1].replace("\\'", "'"), ensure_ascii=False)
        return "" if x[0] == "/" else names.get(x) or json.dumps(x)

    return _TOKEN.sub(one, text)


def valid_dedupe(reply: Column) -> Column:
    """ids of a sound reply, null for any other."""
    ids = F.from_json(reply, DEDUPE_REPLY)["ids"]
    return F.when(ids.isNotNull() & F.forall(ids, lambda x: x.isNotNull()), ids)


def valid_summary(reply: Column) -> Column:
    """items of a sound reply: ids and titles that are not empty, two to five bullets of ten characters or
    more; null for any other."""
    items = F.from_json(reply, SUMMARY_REPLY)["items"]
    sound = F.forall(items, lambda x: (x["hash_id"] != "") & (x["title"] != "") & F.size(x["bullets"]).between(*BULLETS) & F.forall(x["bullets"], lambda b: F.length(b) >= BULLET_CHARS))
    return F.when(F.coalesce(sound, F.lit(False)), items)


def _payload(items: DataFrame, order: list[str], most: int | None = None) -> DataFrame:
    """category, chunk, items: the items of a category as one list, or as lists of about ``most`` by the hash
    of their hash_id, so that no list grows with the category."""
    fields = [c for c in ("hash_id", "url", "title", "source_date", "source_name", "category", "bullets", "raw") if c in items.columns]
    if most is None:
        items = items.withColumn("__chunk", F.lit(0))
    else:
        counts = items.groupBy(F.col("category").alias("__c")).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("__k"))
        items = items.join(counts, F.col("category") == F.col("__c")).withColumn("__chunk", F.pmod(F.xxhash64("hash_id"), F.col("__k")).cast("int"))
    rows = items.groupBy("category", F.col("__chunk").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("x")))).alias("rows"))
    return rows.select("category", "chunk", F.transform("rows", lambda r: r["x"]).alias("items"))


def dedupe_by_event(items: DataFrame, history: DataFrame, client: AIClient, order: tuple[str, ...] = ("source_ord", "item_ord"), most: int = REQUEST_ITEMS) -> DataFrame:
    """Items less those that the client calls known events, by category. A category of one item without
    history is not asked; ids that are unknown are ignored; an unsound reply fails the job.

    Up to ``most`` items and as many of the history go into a request. A larger category is asked about in
    pieces, each piece of its items against each piece of its history, so no request and no row grows
    with the tables; items of different pieces are then not held against each other."""
    new = _payload(items, list(order), most)
    old = _payload(history, ["hash_id"], most).drop("chunk").withColumnsRenamed({"items": "covered", "category": "c2"})
    both = new.join(old, F.col("category") == F.col("c2"), "left").where((F.size("items") > 1) | (F.size("covered") > 0))
    covered = F.coalesce(F.to_json("covered"), F.lit("[]"))
    prompts = both.select("category", F.concat(F.lit('{"fetched":'), F.to_json("items"), F.lit(',"covered":'), covered, F.lit("}")).alias("prompt"))
    replies = _ask(prompts, _tasked(client, DEDUPE_TASK, DEDUPE_SHAPE))
    ids = replies.select("category", F.coalesce(valid_dedupe(F.col("reply")), F.raise_error(F.lit("unsound dedupe reply")).cast("array<string>")).alias("ids"))
    gone = ids.select("category", F.explode("ids").alias("hash_id")).distinct()
    return items.join(gone, ["category", "hash_id"], "left_anti")


def _ask(prompts: DataFrame, client: AIClient) -> DataFrame:
    def run(frames):
        for f in frames:
            yield pd.DataFrame({"category": f["category"], "reply": [repair_json(r) for r in client.ask(list(f["prompt"]))]})

    return prompts.mapInPandas(run, "category string, reply string")


def summarize(items: DataFrame, client: AIClient, order: tuple[str, ...] = ("source_ord", "item_ord"), language: str = "English") -> DataFrame:
    """Items with the titles and bullets of the client's reply, one prompt by category. A reply is matched
    by hash_id, or by position where it is as long as the request and its id is unknown; items
    without a match stay as they are. An unsound reply fails the job."""
    asked = _payload(items, list(order))
    replies = _ask(asked.select("category", F.to_json("items").alias("prompt")), _tasked(client, SUMMARY_TASK, SUMMARY_SHAPE, language))
    return match_replies(items, replies, order)


def match_replies(items: DataFrame, replies: DataFrame, order: tuple[str, ...] = ("source_ord", "item_ord")) -> DataFrame:
    """Items with what ``replies`` (category, reply) say of them; see :func:`summarize`."""
    keyed = items.groupBy("category").agg(F.array_sort(F.collect_list(F.struct(*order, "hash_id"))).alias("rows"))
    sound = replies.select(F.col("category").alias("rc"), F.coalesce(valid_summary(F.col("reply")), F.raise_error(F.lit("unsound summary reply")).cast("array<struct<hash_id:string,title:string,bullets:array<string>>>")).alias("said"))
    both = keyed.join(sound, F.col("category") == F.col("rc")).select("category", F.transform("rows", lambda r: r["hash_id"]).alias("ids"), "said")
    at = both.select("category", "ids", "said", F.posexplode("said").alias("pos", "s"))
    known = F.array_contains("ids", F.col("s.hash_id"))
    target = F.when(known, F.col("s.hash_id")).when(F.size("ids") == F.size("said"), F.get("ids", F.col("pos")))
    said = at.select("category", target.alias("hash_id"), (~known).alias("guess"), "pos", F.col("s.title").alias("t"), F.col("s.bullets").alias("b")).where("hash_id is not null")
    best = said.groupBy("category", "hash_id").agg(F.min_by(F.struct("t", "b"), F.struct("guess", "pos")).alias("x"))
    j = items.join(best, ["category", "hash_id"], "left")
    return j.withColumns({"title": F.coalesce("x.t", "title"), "bullets": F.coalesce("x.b", "bullets")}).select(*items.columns)
