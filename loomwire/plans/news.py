"""The standard pipeline: from fetched items to a digest, its delivery and the store."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwire import ai
from loomwire.operators import digest, items, pages
from loomwire.operators.fetch import fetch_items
from loomwire.plans.pipeline import ERROR_CODES, Pipeline, Stage, StageError
from loomwire.scratch import materialize
from loomwire.sources import pages as web


def _fetch(given, services, options):
    return {"fetched": fetch_items(services["registry"], services["listings"], options["as_of"], given["categories"], services.get("resolved"), options.get("fetch_max_decode_items", 5))}


#: First stage of a run that begins with the registry's listing pages instead of fetched items.
FETCH = Stage("fetch_news", _fetch, {"categories": None}, ("fetched",), ERROR_CODES["fetch"])


def _recency(name: str) -> Stage:
    def apply(given, services, options):
        return {"kept": items.filter_recency(given["items"], options["as_of"], options.get("filter_recency_td_hours", 24), keep_undated=options.get("keep_undated", False))}

    return Stage(name, apply, {"items": None}, ("kept",), ERROR_CODES["recency"])


def _history(given, services, options):
    return {"history": items.history_window(services["store"].read(), given["categories"], options["as_of"], options.get("history_time_window_days", 3))}


def _dedupe(given, services, options):
    new = items.drop_known(given["items"], given["history"])
    # written once, so that a failing client fails this stage
    return {"new": materialize(ai.dedupe_by_event(new, given["history"], services["ai"]), "new") if services.get("ai") else new}


def _truncate(given, services, options):
    return {"first": items.truncate(given["items"], options.get("truncate_max_items_per_category", 5))}


def _read(given, services, options):
    # written once: neither the pages nor the client of the stage before are asked again by what follows
    read = pages.read_items(given["items"], services["pages"], F.lit(options["as_of"]), options.get("read_max_body_chars"))
    return {"read": materialize(read, "read")}


def _summarize(given, services, options):
    # written once: two sinks follow, and the client must not be asked twice
    return {"summarized": materialize(ai.summarize(given["items"], services["ai"], language=options.get("language", "English")), "summaries")}


def _format(given, services, options):
    known = given["items"].sparkSession.createDataFrame([(c,) for c in given["categories"]], "category string")
    return {"text": digest.format_digest(given["items"], known, options["as_of"], options.get("language", "English"), options.get("time_zone", "UTC"))}


def _send(given, services, options):
    text = given["text"].first()["text"]  # one row by construction
    for channel in given["channels"]:
        services["sink"].send(channel, digest.split_message(text, options.get("send_chunk_size", 4000)))
    return {"sent": True}


def _save(given, services, options):
    services["store"].upsert(given["items"])
    return {"saved": True}


def _success(given, services, options):
    return {"success": given["sent"] and given["saved"]}


def news_pipeline(on_error=None, timeout: float | None = None, fetch: bool = False) -> Pipeline:
    """fetched → recency → less what is known → first of each category → page texts → recency → summaries →
    {digest → delivery, store} → success. Inputs: fetched, categories, channels; services: store, pages,
    ai, sink; options: as_of and those of the stages. With ``fetch`` the items come from services
    registry, listings and resolved, and fetched is no input."""
    return Pipeline(
        [
            *([FETCH] if fetch else []),
            _recency("post_fetch_filter").map_input("items", "fetched").map_output("kept", "recent"),
            Stage("history_news", _history, {"categories": None}, ("history",), ERROR_CODES["history"]),
            Stage("dedupe_news", _dedupe, {"items": None, "history": None}, ("new",), ERROR_CODES["dedupe"]).map_input("items", "recent"),
            Stage("truncate_news", _truncate, {"items": None}, ("first",), ERROR_CODES["truncate"]).map_input("items", "new"),
            Stage("read_news", _read, {"items": None}, ("read",), ERROR_CODES["read"]).map_input("items", "first"),
            _recency("post_read_filter").map_input("items", "read").map_output("kept", "still_recent"),
            Stage("summarize_news", _summarize, {"items": None}, ("summarized",), ERROR_CODES["summarize"]).map_input("items", "still_recent"),
            Stage("format_news", _format, {"items": None, "categories": None}, ("text",), ERROR_CODES["format"]).map_input("items", "summarized"),
            Stage("send_news", _send, {"text": None, "channels": None}, ("sent",), ERROR_CODES["send"]),
            Stage("save_news", _save, {"items": None}, ("saved",), ERROR_CODES["save"]).map_input("items", "summarized"),
            Stage("merge_status", _success, {"sent": None, "saved": None}, ("success",), ERROR_CODES["merge_status"]),
        ],
        on_error,
        timeout,
    )


def digest_of(fetched: DataFrame, history: DataFrame, as_of: datetime, hours: float = 24, n: int = 5, language: str = "English") -> DataFrame:
    """The relational core of the pipeline in one lazy plan, without clients and sinks: category and section
    of recent new items, the first ``n`` of each category."""
    recent = items.filter_recency(fetched, as_of, hours)
    return digest.format_sections(items.truncate(items.drop_known(recent, history), n), language)


def run_news(fetched: DataFrame, categories: list[str], channels: list[str], services: dict[str, Any], options: dict[str, Any], on_error=None) -> bool:
    """Runs the standard pipeline; False if any stage failed."""
    out = news_pipeline(on_error, options.get("dag_timeout")).run({"fetched": fetched, "categories": categories, "channels": channels}, ["success"], services, options)
    return bool(out["success"])


def run_registry(registry: DataFrame, services: dict[str, Any], options: dict[str, Any], on_error=None) -> bool:
    """As :func:`run_news` from the pages of a registry's sources, which are fetched here, as are the items'
    pages. That no source could be read is an error of the first stage."""
    known = {"categories": options["categories"], "channels": options["channels"]}
    wanted = registry.where(F.col("category").isin(options["categories"]))
    timeout, agent = options.get("fetch_timeout", 30000) / 1000, options.get("fetch_user_agent") or web.USER_AGENT
    listings = materialize(web.fetch(wanted.select("url").distinct(), timeout=timeout, agent=agent), "listings")

    def read(given, services, options):
        if listings.where("html is not null").isEmpty():
            raise StageError(ERROR_CODES["fetch"], "no source could be read")
        return _fetch(given, services, options)

    def pages_of(given, services, options):
        items_ = materialize(given["items"], "first")
        urls = items_.where(pages.route(F.col("source_name"), F.col("url")).isNotNull()).select("url").distinct()
        got = web.fetch(urls, timeout=options.get("read_timeout", 30000) / 1000, agent=options.get("read_user_agent") or web.USER_AGENT, parallel=options.get("read_concurrency", 5))
        return _read({**given, "items": items_}, {**services, "pages": materialize(got, "pages").where("html is not null").select("url", "html")}, options)

    line = news_pipeline(on_error, options.get("dag_timeout") and options["dag_timeout"] / 1000, fetch=True).set_debug(options.get("debug", False))
    line.stages = [replace(s, apply={"fetch_news": read, "read_news": pages_of}.get(s.name, s.apply)) for s in line.stages]
    out = line.run(known, ["success"], {**services, "registry": registry, "listings": listings}, options)
    return bool(out["success"])
