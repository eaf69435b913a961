"""Settings from a dotenv file or a mapping, typed once."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from typing import Any

# Name, type and default of every option; ... marks one that must be given.
OPTIONS: dict[str, tuple[type, Any]] = {
    "categories": (list, ...), "channels": (list, ...), "error_channels": (list, ""), "fetch_timeout": (int, 30000), "fetch_max_decode_items": (int, 5), "fetch_user_agent": (str, None),
    "read_timeout": (int, 30000), "read_user_agent": (str, None), "read_max_body_chars": (int, None), "read_concurrency": (int, 5), "history_time_window_days": (float, 3.0),
    "filter_recency_td_hours": (float, 24.0), "truncate_max_items_per_category": (int, 5), "language": (str, "English"), "time_zone": (str, None), "send_parse_mode": (str, "MarkdownV2"),
    "send_chunk_size": (int, 4000), "cron_expr": (str, None), "dag_timeout": (float, None), "debug": (bool, False),
    "ai_api_key": (str, None), "ai_base_url": (str, None), "ai_model": (str, None), "ai_timeout": (int, 300000), "ai_max_retries": (int, 3), "ai_reasoning_effort": (str, "medium"), "ai_provider_type": (str, "openai-compatible"),
    "database_host": (str, "localhost"), "database_port": (int, 5432), "database_user": (str, None), "database_password": (str, None), "database_name": (str, None), "telegram_token": (str, None),
}
_POSITIVE = ("history_time_window_days", "filter_recency_td_hours", "truncate_max_items_per_category", "send_chunk_size", "read_concurrency", "dag_timeout", "ai_timeout", "ai_max_retries", "database_port")
# The only values of some options.
_CHOICES = {"ai_reasoning_effort": ("low", "medium", "high", "xhigh", "max"), "ai_provider_type": ("openai", "anthropic", "openai-compatible"), "send_parse_mode": ("MarkdownV2", "HTML", "Markdown")}


def load_config(source: str | Mapping[str, str]) -> dict[str, Any]:
    """Typed options; lists are cut at commas and trimmed, any text but the empty one is true for a flag.
    A missing or impossible value is an error that names the option."""
    if isinstance(source, str):
        lines = (x.split("=", 1) for x in Path(source).read_text().splitlines() if "=" in x and not x.lstrip().startswith("#"))
        source = {k.strip(): v.strip().strip("\"'") for k, v in lines}
    out: dict[str, Any] = {}
    for name, (kind, default) in OPTIONS.items():
        text = source.get(name, default)
        if text is ...:
            raise ValueError(f"{name} must be given")
        try:
            out[name] = [x.strip() for x in text.split(",")] if kind is list else text if text is None else bool(text) if kind is bool else kind(text)
        except (TypeError, ValueError) as e:
            raise ValueError(f"{name}: {e}") from e
        if name in _CHOICES and out[name] not in _CHOICES[name]:
            raise ValueError(f"{name} must be one of {', '.join(_CHOICES[name])}")
        if name in _POSITIVE and out[name] is not None and out[name] <= 0:
            raise ValueError(f"{name} must be above 0")
    return out
