"""Corpus encoding with a public byte-level BPE vocabulary (problem 8) and its inverse.

Texts reach Python as Arrow batches of bytes, the token ids return as one flat buffer with
offsets, so no Python list of integers is ever built. A rank file is read once per Python
worker. Long texts are cut before encoding where the split pattern must start a new piece
whatever surrounds it; the ids of the parts then concatenate to the ids of the whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern published with the byte_bpe vocabularies.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_DIR = "/opt/tokenizers"
#: Characters above which a text is encoded in parts.
LONG_TEXT = 1 << 16
#: A single space between two other characters always opens a piece; so does a change from a
#: letter to a symbol. Neither can lie inside a piece of SPLIT_PATTERN.
SAFE_CUT = regex.compile(r"(?<=\S)(?= \S)|(?<=\p{L})(?=[^\s\p{L}\p{N}])")


def rank_file(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("TOKENIZER_DIR", DEFAULT_DIR), f"{name}.tiktoken")


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """Encoding without special tokens: their strings are ordinary text."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """Parts of about ``size`` characters, cut only at SAFE_CUT; a text without one stays whole."""
    at = 0
    while len(text) - at > size:
        m = SAFE_CUT.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(text: str, enc: tiktoken.Encoding) -> np.ndarray:
    if len(text) <= LONG_TEXT:
        return enc.encode_to_numpy(text)
    return np.concatenate([enc.encode_to_numpy(p) for p in parts(text)])


def _encoder(path: str, keep: list[str], ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            found = [encode(t.decode("utf-8", "replace"), enc) if t else np.empty(0, np.uint32) for t in texts]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            if ids:
                offsets = np.concatenate([[0], lengths.cumsum()]).astype(np.int32)
                flat = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
                out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            else:
                out = pa.array(lengths)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), out], [*keep, "ids" if ids else "n_tokens"])

    return run


def _mapped(df: DataFrame, text: str, keep: list[str], tokenizer: str, folder: str | None, ids: bool) -> DataFrame:
    name = "ids" if ids else "n_tokens"
    if name in keep:
        raise ValueError(f"a kept column is already called {name}")
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"{name} {'array<int>' if ids else 'bigint'}"])
    return src.mapInArrow(_encoder(rank_file(tokenizer, folder), keep, ids), schema)


def encode_corpus(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``keep`` and ``ids`` of every row of ``df``, in a narrow map without a shuffle.

    Null and empty texts get the empty list; blank texts get the ids of their white space.
    Invalid UTF-8 is read with U+FFFD. Columns that are not kept never reach Python; a kept
    column named ``ids`` is an error. Repeated rows stay repeated; no rows give no rows.
    """
    return _mapped(df, text, list(keep), tokenizer, folder, True)


def token_counts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """As :func:`encode_corpus`, with ``n_tokens`` instead of the ids; 0 for null and empty texts."""
    return _mapped(df, text, list(keep), tokenizer, folder, False)


def decode_corpus(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``keep`` and ``text`` from token ids. The bytes of all tokens are joined before they are
    decoded, since one character may be spread over tokens. Null ids give a null text, an empty
    list the empty text; an id outside the vocabulary fails the job."""
    path, names = rank_file(tokenizer, folder), list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            texts = [None if x is None else enc.decode_bytes(x).decode("utf-8", "replace") for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, "text"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), "text string"])
    return df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{ids}`").alias("__ids")).mapInArrow(run, schema)
