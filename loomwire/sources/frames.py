"""Replies of a link resolver: nested JSON arrays in lines of a response."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwire.functions.urls import is_publisher_url


def walk_arrays(value: object) -> Iterator[list]:
    """Every array in ``value``, itself first, in pre-order."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            yield x
            stack.extend(reversed(x))


def candidates(body: str | None, marker: tuple[str, str] = ("wrb.fr", "Fbv4je"), kind: str = "garturlres") -> list[str]:
    """URLs of the frames that bear the marker, in order; lines that are no JSON are passed over."""
    out = []
    for line in (body or "").split("\n"):
        try:
            frame = json.loads(line)
        except ValueError:
            continue
        for node in walk_arrays(frame):
            if len(node) >= 3 and tuple(node[:2]) == marker:
                try:
                    inner = json.loads(node[2])
                except (TypeError, ValueError):
                    continue
                if isinstance(inner, list) and len(inner) > 1 and inner[0] == kind and isinstance(inner[1], str):
                    out.append(inner[1])
    return out


def resolved_url(body: Column) -> Column:
    """First usable URL of a resolver's response, null if there is none."""
    found = F.udf(lambda b: candidates(b), "array<string>", useArrow=True)
    return F.get(F.filter(found(body), is_publisher_url), F.lit(0))


def decode_params(page: Column) -> Column:
    """timestamp and signature that a resolver's page carries; null if one is missing."""
    ts = F.nullif(F.regexp_extract(page, r'data-n-a-ts="(\d+)"', 1), F.lit(""))
    sg = F.nullif(F.regexp_extract(page, r'data-n-a-sg="([^"]+)"', 1), F.lit(""))
    return F.when(ts.isNotNull() & sg.isNotNull(), F.struct(ts.alias("timestamp"), sg.alias("signature")))
