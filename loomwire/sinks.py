"""Where digests and errors go."""

from __future__ import annotations

import time
from typing import Protocol


class MessageSink(Protocol):
    def send(self, channel: str, chunks: list[str]) -> None: ...


class MemorySink:
    """Keeps what it is sent; channels in ``broken`` fail."""

    def __init__(self, broken: tuple[str, ...] = ()) -> None:
        self.sent: list[tuple[str, int, str]] = []
        self.broken = broken

    def send(self, channel: str, chunks: list[str]) -> None:
        if channel in self.broken:
            raise ConnectionError(channel)
        self.sent += [(channel, i, c) for i, c in enumerate(chunks)]


class DeliveryLog:
    """A sink over another that never fails: every channel is tried, and what happened is kept. Chunks
    of a channel go one after the other with a pause between them."""

    def __init__(self, sink: MessageSink, pause: float = 0.5) -> None:
        self.sink, self.pause = sink, pause
        self.log: list[tuple[str, str]] = []

    def send(self, channel: str, chunks: list[str]) -> None:
        try:
            for i, chunk in enumerate(chunks):
                if i:
                    time.sleep(self.pause)
                self.sink.send(channel, [chunk])
            self.log.append((channel, "ok"))
        except Exception as e:
            self.log.append((channel, f"{type(e).__name__}: {e}"))
