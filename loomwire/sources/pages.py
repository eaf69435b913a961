"""Pages from snapshots or from the web, as (url, html, error)."""

from __future__ import annotations

import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TIMEOUT = 30.0
USER_AGENT = "Mozilla/5.0 (compatible; loomwire)"


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Pages kept as Parquet with url and html."""
    return spark.read.parquet(path).select("url", "html")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One page per file; its path is the url."""
    from pyspark.sql import functions as F

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def fetch(urls: DataFrame, url: str = "url", timeout: float = TIMEOUT, agent: str = USER_AGENT, parallel: int | None = None) -> DataFrame:
    """url, html, error of every row: one of html and error is null. Failures never fail the job, so a
    site that is down costs only its own rows. ``parallel`` bounds the requests at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html, error = [], []
            for u in b.column("url").to_pylist():
                try:
                    if not (u or "").startswith(("http://", "https://")):
                        raise ValueError("not an http(s) URL")
                    with urllib.request.urlopen(urllib.request.Request(u, headers={"User-Agent": agent}), timeout=timeout) as r:
                        html.append(r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"))
                    error.append(None)
                except Exception as e:
                    html.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("url"), pa.array(html, pa.string()), pa.array(error, pa.string())], ["url", "html", "error"])

    rows = urls.select(urls[url].alias("url"))
    return (rows.repartition(parallel) if parallel else rows).mapInArrow(run, "url string, html string, error string")
