"""Vectors from any provider: batched calls with pacing, retries and resumption.

A provider is any object with ``embed(texts) -> vectors`` that can be sent to the workers. Each partition calls it with batches of ``size`` texts, waits between calls, and repeats a call
that fails with a passing error (429 and 5xx) after growing pauses. Finished slices are committed, so a run that
ends early goes on where it stopped and no row is embedded twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import tables


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ProviderError(Exception):
    """A failed call with its HTTP status."""

    def __init__(self, status: int, message: str = "") -> None:
        super().__init__(status, message)
        self.status = status

    @property
    def passing(self) -> bool:
        return self.status == 429 or 500 <= self.status < 600


@dataclass(frozen=True)
class Calls:
    """Texts a call. Seconds between calls of one partition; calls of one batch at most; first and longest pause after a passing error."""

    size: int = 25
    pace: float = 0.0
    attempts: int = 5
    pause: float = 1.0
    longest: float = 60.0


def call(provider: Provider, texts: list[str], calls: Calls, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """One batch; passing errors are retried after pauses that double, others are raised."""
    for attempt in range(calls.attempts):
        try:
            vectors = provider.embed(texts)
        except ProviderError as error:
            if not error.passing or attempt + 1 == calls.attempts:
                raise
            sleep(min(calls.longest, calls.pause * 2**attempt))
            continue
        if len(vectors) != len(texts):
            raise ValueError(f"{len(texts)} texts gave {len(vectors)} vectors")
        return vectors
    raise ValueError("no attempt is allowed")


def embed(rows: DataFrame, provider: Provider, id_col: str = "id", text_col: str = "text", calls: Calls = Calls()) -> DataFrame:
    """``id_col, v`` of every row; null texts count as empty. Ids are carried as strings through the workers and cast back."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), calls.size):
                part = batch.iloc[a : a + calls.size]
                yield pd.DataFrame({"i": part["i"].to_numpy(), "v": call(provider, part["t"].tolist(), calls)})
                if calls.pace:
                    time.sleep(calls.pace)

    found = rows.select(F.col(id_col).cast("string").alias("i"), F.coalesce(text_col, F.lit("")).alias("t")).mapInPandas(run, "i string, v array<double>")
    return found.select(F.col("i").cast(kind).alias(id_col), "v")


def embed_resumed(spark: SparkSession, rows: DataFrame, path: str, provider: Provider, id_col: str = "id", text_col: str = "text", calls: Calls = Calls(), slices: int = 8) -> DataFrame:
    """Vectors of all rows, kept under ``path``: rows that it holds already are not asked for again. Work is committed by slices of the ids; rows without an id can't be resumed and are left out."""
    rows = rows.where(F.col(id_col).isNotNull())
    for s in range(slices):
        part = rows.where(F.pmod(F.xxhash64(id_col), F.lit(slices)) == s)
        tables.resume(spark, part, path, id_col, lambda left: embed(left, provider, id_col, text_col, calls))
    return spark.read.parquet(path)
