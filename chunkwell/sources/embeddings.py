"""Embedding providers: from a table, or from an HTTP service called by the executors."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_WORKERS = 4


def workers(value: str | None, jobs: int) -> int:
    """Calls at a time: the setting if it is a positive number, else 4; no more than there are jobs."""
    try:
        n = int(value or "")
    except ValueError:
        n = 0
    return max(1, min(n if n > 0 else DEFAULT_WORKERS, jobs))


class HttpProvider:
    """POST {model, prompt} to <url>/api/embeddings; the answer has embedding, or error.

    An answer other than 200, one that isn't JSON, or one with an error fails the task, and so in the end the job.
    """

    def __init__(self, url: str, model: str, timeout: float = 60.0, max_workers: str | None = None):
        self.endpoint = (url[:-1] if url.endswith("/") else url) + "/api/embeddings"
        self.model, self.timeout, self.max_workers = model, timeout, max_workers

    @classmethod
    def from_environment(cls) -> HttpProvider | None:
        url, model = os.environ.get("EMBEDDING_URL", ""), os.environ.get("EMBEDDING_MODEL", "")
        if not url or not model:
            return None
        timeout = os.environ.get("EMBEDDING_TIMEOUT_SECONDS", "")
        return cls(url, model, float(timeout) if timeout.isdigit() and int(timeout) > 0 else 60.0, os.environ.get("EMBEDDING_MAX_WORKERS"))

    def one(self, sentence: str) -> list[float]:
        request = urllib.request.Request(self.endpoint, json.dumps({"model": self.model, "prompt": sentence}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            if answer.status != 200:
                raise RuntimeError(f"embedding service returned {answer.status}")
            body = json.load(answer)
        if body.get("error"):
            raise RuntimeError(f"embedding service returned an error: {body['error']}")
        return [float(x) for x in body.get("embedding") or []]

    def __call__(self, sentences: list[str]) -> list[list[float]]:
        if not sentences:
            return []
        with ThreadPoolExecutor(workers(self.max_workers, len(sentences))) as pool:
            return list(pool.map(self.one, sentences))


def embed(rows: DataFrame, provider: Callable[[list[str]], list[list[float]]], column: str = "sentence") -> DataFrame:
    """Adds embedding by calling the provider for each Arrow batch of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(embedding=provider(batch[column].tolist()) if len(batch) else pd.Series([], dtype=object))

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def embed_from_table(rows: DataFrame, table: DataFrame, on: str | list[str]) -> DataFrame:
    """Adds embedding by joining a table that has it by key; missing ones are null."""
    keys = [on] if isinstance(on, str) else on
    return rows.join(table.select(*keys, F.col("embedding").cast("array<double>").alias("embedding")), keys, "left")
