"""Model steps behind a protocol, with a rule-based stub that needs no model."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.sources import storage


class Provider(Protocol):
    name: str

    def classify(self, header: str, samples: list[str]) -> str: ...

    def describe(self, title: str, columns: list[str]) -> str: ...

    def embed(self, text: str) -> list[float]: ...


#: Classes of the stub by a pattern of the header.
RULES = [(r"date|time|_ts$", "TemporalColumn"), (r"price|cost|acctbal|amount|total", "PriceColumn"), (r"qty|quantity|count|size", "QuantityColumn"), (r"(_|^)id$|key$", "IdentifierColumn"), (r"name|title", "NameColumn"), (r"url|uri|link", "UriColumn")]


class Rules:
    """Deterministic: classes from headers, descriptions from a template, vectors from hashed words."""

    name, size = "rules", 64

    def classify(self, header: str, samples: list[str]) -> str:
        return next((c for p, c in RULES if re.search(p, header.lower())), "Column")

    def describe(self, title: str, columns: list[str]) -> str:
        return f"{title} with {len(columns)} columns: {', '.join(columns)}"

    def embed(self, text: str) -> list[float]:
        v = np.zeros(self.size)
        for w in re.findall(r"\w{2,}", text.lower()):
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            v[h % self.size] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()


def prompt_key(model: str, prompt: str) -> str:
    return hashlib.md5(f"{model}:{prompt}".encode()).hexdigest()


def classified(columns: DataFrame, provider: Provider) -> DataFrame:
    """table_id, column_index, class of (table_id, column_index, header, sample_values)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"table_id": b["table_id"], "column_index": b["column_index"], "class": [provider.classify(h, list(s) if s is not None else []) for h, s in zip(b["header"], b["sample_values"], strict=True)]})

    return columns.select("table_id", "column_index", "header", "sample_values").mapInPandas(run, "table_id string, column_index int, class string")


def described(tables: DataFrame, provider: Provider) -> DataFrame:
    """table_id, description of (table_id, title, columns)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"table_id": b["table_id"], "description": [provider.describe(t or "", list(c)) for t, c in zip(b["title"], b["columns"], strict=True)]})

    return tables.select("table_id", "title", "columns").mapInPandas(run, "table_id string, description string")


def embedded(rows: DataFrame, key: str, text: str, provider: Provider) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "embedding": [provider.embed(t or "") for t in b["text"]]})

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, embedding array<double>")


class Stopped(RuntimeError):
    """Too many calls failed one after another."""


def called(prompts: DataFrame, model: str, call: Callable[[str], str], cache: str | None = None, attempts: int = 3, pause: float = 0.0, in_row: int = 10) -> DataFrame:
    """key, answer, error of every different prompt (column ``prompt``). Answers in the relation at ``cache`` are taken from
    there, and new ones are added to it; a call is tried again after a pause that doubles; a task stops the job after so
    many failures in a row, as a model that is down fails them all. Failed calls are not cached."""
    spark = prompts.sparkSession
    asked = prompts.select("prompt").distinct().withColumn("key", F.md5(F.concat(F.lit(f"{model}:"), "prompt")))
    at = spark._jvm.org.apache.hadoop.fs.Path(cache) if cache else None
    known = spark.read.parquet(cache) if at and at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
    new = asked.join(known.select("key"), "key", "left_anti") if known is not None else asked

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for batch in batches:
            rows = []
            for key, prompt in zip(batch["key"], batch["prompt"], strict=True):
                answer, error, wait = None, None, pause
                for n in range(attempts):
                    try:
                        answer, error = call(prompt), None
                        break
                    except Exception as e:  # noqa: BLE001  (whatever a model's client raises)
                        error = f"{type(e).__name__}: {e}"
                        if n + 1 < attempts:
                            time.sleep(wait)
                            wait *= 2
                failed = failed + 1 if error else 0
                if failed >= in_row:
                    raise Stopped(f"{failed} calls failed one after another; the last: {error}")
                rows.append((key, answer, error))
            yield pd.DataFrame(rows, columns=["key", "answer", "error"])

    got = storage.checkpointed(new.select("key", "prompt").mapInPandas(run, "key string, answer string, error string"))
    if cache:
        got.where("error is null").select("key", "answer").write.mode("append").parquet(cache)
    old = known.join(asked.select("key"), "key", "left_semi").select("key", "answer", F.lit(None).cast("string").alias("error")) if known is not None else None
    return got if old is None else got.unionByName(storage.checkpointed(old))


def error_share(results: DataFrame, most: float = 0.5, least: int = 20) -> None:
    """Raises if more than the given share of at least ``least`` results are errors (column ``error``)."""
    n, bad = results.agg(F.count("*"), F.count("error")).first()
    if n >= least and bad / n > most:
        raise RuntimeError(f"{bad} of {n} calls failed")
