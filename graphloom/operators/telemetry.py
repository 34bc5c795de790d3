"""Traces of the steps of a run: what each took, gave and came from, as rows."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..sources import tables

SCHEMA = "number int, step string, latency_ms double, n_rows long, columns string, after string"


class Recorder:
    """Takes the place of ``tables.cut`` in a run. Rows are counted by an observation while the step is written, so nothing is computed for the trace alone, unless runs stand for others."""

    def __init__(self) -> None:
        self.steps: list[tuple] = []
        self.kept: list[DataFrame] = []

    def cut(self, df: DataFrame, step: str = "") -> DataFrame:
        seen, began = Observation(), time.perf_counter()
        kept = tables.written(df.observe(seen, F.count(F.lit(1)).alias("n_rows")))
        took = (time.perf_counter() - began) * 1000
        after = self.steps[-1][1] if self.steps else ""
        self.steps.append((len(self.steps) + 1, step, took, int(seen.get["n_rows"]), ", ".join(df.columns), after))
        self.kept.append(kept)
        return kept

    def rows(self, spark: SparkSession, same: DataFrame | None = None) -> DataFrame:
        """A row for each step so far: ``number, step, latency_ms, n_rows, columns, after``; ``after`` names the step before.

        With ``same`` (``run, as_run``) the rows of a run count once for each run that it stands for; steps name their runs ``run`` or ``qid``.
        """
        steps = spark.createDataFrame(self.steps, SCHEMA)
        if same is None:
            return steps
        each = [kept.select(F.lit(step[0]).alias("number"), F.col("run" if "run" in kept.columns else "qid").alias("as_run")) for step, kept in zip(self.steps, self.kept, strict=True)]
        rows = reduce(DataFrame.unionByName, each).groupBy("number", "as_run").agg(F.count(F.lit(1)).alias("n"))
        counts = rows.join(same.groupBy("as_run").agg(F.count(F.lit(1)).alias("runs")), "as_run").groupBy("number").agg(F.sum(F.col("n") * F.col("runs")).alias("total"))
        return steps.join(counts, "number", "left").withColumn("n_rows", F.coalesce("total", F.lit(0).cast("long"))).select(*steps.columns)
