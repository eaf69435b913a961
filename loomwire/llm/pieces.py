"""Cutting oversized texts at natural boundaries by pointer doubling (problem 5).

Every position where a piece may end is a node. One vectorised search joins each node to its
farthest legal successor, i.e. the end of the piece that would start ``overlap`` characters
before it. The table of successors is then squared: jumps of 1, 2, 4, ... pieces give all cuts
of a text in a logarithmic number of array gathers, with no walk from cut to cut. The nodes of
a text stay in one row, so nothing is shuffled; only texts above the limit reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 200
#: A boundary of a higher rank is taken only if the piece gets at least so full.
MIN_FILL = 0.5
#: Ranks of boundaries, the most natural first; a boundary lies where the match ends.
BOUNDARIES = (
    regex.compile(r"\n\s*\n\s*"),
    regex.compile(r"\n"),
    regex.compile(r"[.!?…]+[\"'”’»“)\]]*(?=\s)|[。！？…]+[”’」』）]*"),
    regex.compile(r"\s+|[，、；：]"),
)
#: No cut before a mark that belongs to the character before it, nor after a joiner.
_INSIDE = regex.compile(r"(?=[\p{M}‍️])|(?<=‍)")


def boundaries(text: str, reach: int) -> list[np.ndarray]:
    """Sorted end positions by rank. The last rank fills gaps of ``reach`` or more characters
    without a boundary with every position in them, so that each node has a successor."""
    n = len(text)
    found = [np.unique(np.fromiter((m.end() for m in p.finditer(text)), np.int64)) for p in BOUNDARIES]
    known = np.unique(np.concatenate([np.array([0, n], np.int64), *found]))
    wide = np.flatnonzero(np.diff(known) >= reach)
    fill = [np.arange(known[i] + 1, known[i + 1]) for i in wide]
    free = np.concatenate(fill) if fill else np.empty(0, np.int64)
    if len(free):
        inside = np.fromiter((m.start() for m in _INSIDE.finditer(text)), np.int64)
        kept = free[~np.isin(free, inside)]
        free = kept if len(kept) and not (np.diff(np.unique(np.concatenate([known, kept]))) >= reach).any() else free
    return [*found, free]


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, min_fill: float = MIN_FILL) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of ``text``; they cover it, none is longer than ``limit``,
    and each starts exactly ``overlap`` characters before the end of the one before."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    n = len(text)
    if n <= limit:
        return np.array([0]), np.array([n])
    ranks = boundaries(text, limit // 2 - overlap)
    nodes = np.unique(np.concatenate([np.array([0, n], np.int64), *ranks]))
    starts = np.where(nodes == 0, 0, nodes - overlap)
    end = np.full(len(nodes), -1, np.int64)
    end[starts + limit >= n] = n
    least = np.maximum(starts + int(limit * min_fill), nodes + 1)
    for rank in ranks:
        if len(rank):
            last = rank[np.maximum(np.searchsorted(rank, starts + limit, "right") - 1, 0)]
            end = np.where((end < 0) & (last >= least) & (last <= starts + limit), last, end)
    # fewer characters than min_fill, but still a boundary and an advance
    last = nodes[np.searchsorted(nodes, starts + limit, "right") - 1]
    end = np.where((end < 0) & (last > nodes), last, end)
    end = np.where(end < 0, np.minimum(starts + limit, n), end)
    succ = np.searchsorted(nodes, end)
    path, jump = np.array([0]), succ
    while nodes[path[-1]] != n:
        path = np.concatenate([path, jump[path]])  # 1, 2, 4, ... pieces known
        jump = jump[jump]
    ends = np.unique(nodes[path])[1:]
    return np.concatenate([[0], ends[:-1] - overlap]), ends


def split_oversized(df: DataFrame, text: str = "raw", key: str = "item_id", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``key`` and ``pieces`` (an array of piece_no, start, end, piece) of each text of more than
    ``limit`` code points.

    Pieces end at a paragraph, line, sentence or word, in this order of preference, where there
    is one, else between two characters; ``start`` and ``end`` count code points from 0. Texts
    up to the limit, null and empty ones have no row. Repeated rows are cut each by itself, other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("__text").to_pylist():
                a, b = cuts(t, limit, overlap)
                rows.append([{"piece_no": i, "start": int(x), "end": int(y), "piece": t[x:y]} for i, (x, y) in enumerate(zip(a, b), 1)])
            kind = pa.list_(pa.struct([("piece_no", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("piece", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(rows, kind)], ["__key", "pieces"])

    kind = df.schema[key].dataType.simpleString()
    src = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.length("__text") > limit)
    out = src.mapInArrow(run, f"__key {kind}, pieces array<struct<piece_no:int,start:bigint,end:bigint,piece:string>>")
    return out.withColumnRenamed("__key", key)


def piece_rows(df: DataFrame, text: str = "raw", key: str = "item_id", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: ``key``, piece_no, start, end, piece."""
    return split_oversized(df, text, key, limit, overlap).select(key, F.inline("pieces"))
