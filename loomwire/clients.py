"""Clients of services on the network, over the standard library's HTTP: AI and messages."""

from __future__ import annotations

import json
import logging
import time
import traceback
import urllib.error
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

log = logging.getLogger(__name__)
#: Pause before the first further try, in seconds; it doubles.
PAUSE = 0.5


def post(url: str, body: Mapping[str, Any], headers: Mapping[str, str], timeout: float, retries: int) -> dict:
    """The reply to a JSON request. Overload, server errors and lost connections are tried again."""
    request = urllib.request.Request(url, json.dumps(body, ensure_ascii=False).encode(), {"Content-Type": "application/json", **headers})
    for left in reversed(range(retries + 1)):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.loads(r.read())
        except urllib.error.HTTPError as e:
            if not left or e.code not in (408, 409, 429) and e.code < 500:
                raise RuntimeError(f"{url} answered {e.code}: {e.read()[:500].decode('utf-8', 'replace')}") from e
        except OSError:
            if not left:
                raise
        time.sleep(PAUSE * 2 ** (retries - left))
    raise AssertionError


@dataclass(frozen=True)
class HttpAIClient:
    """An AI service by its HTTP interface: chat (messages to chat/completions, as many servers offer),
    responses (input and instructions), or messages (with the system text apart). Times in milliseconds."""

    key: str
    base_url: str
    model: str
    kind: str = "chat"
    timeout: int = 300_000
    retries: int = 3
    effort: str | None = "medium"
    instruction: str = ""
    shape: dict | None = None
    #: Most tokens of a reply, which the messages interface wants named.
    max_tokens: int = 32_000

    def with_task(self, instruction: str, shape: dict | None) -> HttpAIClient:
        return replace(self, instruction=instruction, shape=shape)

    def ask(self, prompts: list[str]) -> list[str]:
        return [self.one(p) for p in prompts]

    def one(self, prompt: str) -> str:
        form, read = {"chat": (self._chat, _chat_text), "responses": (self._responses, _responses_text), "messages": (self._messages, _messages_text)}[self.kind]
        path, headers, body = form(prompt)
        reply = post(f"{self.base_url.rstrip('/')}/{path}", {"model": self.model, **body}, headers, self.timeout / 1000, self.retries)
        try:
            text = read(reply)
        except (KeyError, IndexError, TypeError):
            text = None
        if not isinstance(text, str) or not text:
            raise RuntimeError(f"no text in the reply: {json.dumps(reply)[:500]}")
        return text

    def _chat(self, prompt: str) -> tuple[str, dict, dict]:
        system = [{"role": "system", "content": self.instruction}] if self.instruction else []
        shape = {"response_format": {"type": "json_schema", "json_schema": {"name": "reply", "schema": self.shape}}} if self.shape else {}
        effort = {"reasoning_effort": self.effort} if self.effort else {}
        return "chat/completions", {"Authorization": f"Bearer {self.key}"}, {"messages": [*system, {"role": "user", "content": prompt}], **shape, **effort}

    def _responses(self, prompt: str) -> tuple[str, dict, dict]:
        told = {"instructions": self.instruction} if self.instruction else {}
        shape = {"text": {"format": {"type": "json_schema", "name": "reply", "schema": self.shape}}} if self.shape else {}
        effort = {"reasoning": {"effort": self.effort}} if self.effort else {}
        return "responses", {"Authorization": f"Bearer {self.key}"}, {"input": prompt, **told, **shape, **effort}

    def _messages(self, prompt: str) -> tuple[str, dict, dict]:
        told = "\n".join(x for x in (self.instruction, "The reply must follow this JSON schema: " + json.dumps(self.shape) if self.shape else "") if x)
        return "messages", {"x-api-key": self.key, "anthropic-version": "2023-06-01"}, {"max_tokens": self.max_tokens, "messages": [{"role": "user", "content": prompt}], **({"system": told} if told else {})}


def _chat_text(reply: dict) -> str | None:
    return reply["choices"][0]["message"]["content"]


def _responses_text(reply: dict) -> str | None:
    return "".join(c["text"] for o in reply["output"] if o["type"] == "message" for c in o["content"] if c["type"] == "output_text")


def _messages_text(reply: dict) -> str | None:
    return "".join(c["text"] for c in reply["content"] if c["type"] == "text")


# The interface of each provider type.
PROVIDERS = {"openai": "responses", "anthropic": "messages", "openai-compatible": "chat"}


def ai_client(options: Mapping[str, Any]) -> HttpAIClient:
    """The client that the ai_* options name."""
    return HttpAIClient(
        options["ai_api_key"], options["ai_base_url"], options["ai_model"], PROVIDERS[options["ai_provider_type"]],
        options.get("ai_timeout") or 300_000, options.get("ai_max_retries") or 3, options.get("ai_reasoning_effort") or "medium",
    )


@dataclass(frozen=True)
class BotSink:
    """Messages through a bot's HTTP interface (sendMessage with chat_id, text, and a parse mode)."""

    token: str
    base_url: str = "https://api.telegram.org"
    parse_mode: str | None = "MarkdownV2"
    timeout: float = 30.0
    retries: int = 2

    def send(self, channel: str, chunks: list[str]) -> None:
        for chunk in chunks:
            mode = {"parse_mode": self.parse_mode} if self.parse_mode else {}
            post(f"{self.base_url.rstrip('/')}/bot{self.token}/sendMessage", {"chat_id": channel, "text": chunk, **mode}, {}, self.timeout, self.retries)


class ErrorChannels:
    """Error handler that reports to channels; each is tried, and a failure is only logged."""

    def __init__(self, sink: Any, channels: list[str], limit: int = 4000) -> None:
        self.sink, self.channels, self.limit = sink, [c for c in channels if c], limit

    def __call__(self, error: Any) -> None:
        from loomwire.operators.digest import split_message

        cause = error.cause
        trace = "".join(traceback.format_exception(cause)) if isinstance(cause, BaseException) else ""
        text = f"The news run failed with code {error.code}.\n\n{cause}\n\n{trace}".strip()
        for channel in self.channels:
            try:
                self.sink.send(channel, split_message(text, self.limit))
            except Exception as e:
                log.error("error channel %s: %s", channel, e)
