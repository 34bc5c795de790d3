"""Approximate and exact cosine neighbours by an inverted-file index, stored as a table.

Centroids are fitted on a bounded sample; every vector belongs to the list of its nearest centroid. A search takes the lists nearest to each
query: as many as queries of the sample needed to reach a recall, so vectors without clusters are searched more widely. Rows and queries meet in cells of bounded size: a list is split by a hash of its ids into parts and its queries into blocks, so neither a hot list
(copies of one vector) nor many queries of one list land in one task. All blocks share one scan of the index. The exact search then follows the lists that
the angle bound can't exclude, so it gives what ``vectors.knn`` gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources import tables

#: Rows of an index and queries that meet in one task's group.
CELL_ROWS, CELL_QUERIES = 4096, 1024
#: Slack of the angle bound, for vectors that are of unit length but for single precision.
SLACK = 2e-3


def _matrix(v: pa.Array) -> np.ndarray:
    return v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(v), -1)


def spherical_centroids(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of unit vectors by Lloyd's rounds on the cosine. The first ones are spread over the sample, so a fit is repeatable."""
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(sample[a : a + 4096] @ centroids.T, 1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centroids)
    return centroids


def needed_probes(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """How many nearest lists hold the share ``recall`` of the k nearest rows of the sample, over its first rows as queries."""
    nearest = np.concatenate([np.argmax(sample[a : a + 4096] @ centroids.T, 1) for a in range(0, len(sample), 4096)])
    ranks = []
    for a in range(0, min(queries, len(sample)), 32):
        asked = sample[a : min(a + 32, queries)]
        cosine = asked @ sample.T
        cosine[np.arange(len(asked)), np.arange(a, a + len(asked))] = -2  # not the query itself
        best = np.argpartition(-cosine, min(k, len(sample) - 1) - 1, 1)[:, :k] if len(sample) > 1 else np.zeros((len(asked), 0), int)
        order = np.argsort(np.argsort(-(asked @ centroids.T), 1, kind="stable"), 1, kind="stable")
        ranks.append(np.take_along_axis(order, nearest[best], 1).ravel())
    found = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0)
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) + 1 if len(found) else len(centroids)


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: list, id, v, stored by list; the centroids, for each list its number of rows and largest angle to its centroid, and how many lists a search takes."""

    rows: DataFrame
    centroids: np.ndarray
    counts: np.ndarray
    radius: np.ndarray
    probes: int


def build(vectors: DataFrame, path: str, lists: int | None = None, most_lists: int = 4096, sample_bytes: int = 64 << 20, k: int = 20, recall: float = 0.96) -> VectorIndex:
    """Index unit vectors ``id, v`` under ``path``. Null vectors are left out.

    The sample is the rows with the smallest hashes of their ids: at most 64 a list and ``sample_bytes`` in all. ``lists`` is the square root of the number of
    rows unless given, at most ``most_lists``. A search takes as many lists as give the sample's queries the ``recall`` of their k neighbours in the sample.
    """
    spark, vectors = vectors.sparkSession, vectors.where("v IS NOT NULL").select("id", "v")
    n = vectors.count()
    dims = vectors.select(F.size("v").alias("d")).first()["d"] if n else 1
    lists = max(1, min(lists or round(n**0.5), most_lists, n or 1))
    most = max(lists, min(64 * lists, sample_bytes // (8 * dims)))
    sample = np.array([r["v"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(most).select("v").collect()], float).reshape(-1, dims)
    centroids = spherical_centroids(sample, lists) if n else np.zeros((1, dims))
    probes = needed_probes(sample, centroids, k, recall) if n else 1
    kind = vectors.schema["id"].dataType.simpleString()
    shipped = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cosine = _matrix(batch.column(1)) @ shipped.value.T
                best = np.argmax(cosine, 1)
                angle = np.arccos(np.clip(cosine[np.arange(len(best)), best], -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), batch.column(0), batch.column(1), pa.array(angle)], names=["list", "id", "v", "angle"])

    found = vectors.mapInArrow(assign, f"list int, id {kind}, v {vectors.schema['v'].dataType.simpleString()}, angle double")
    # ranges of (list, hash) split a hot list over files; files sorted by list are skipped by their statistics
    found.repartitionByRange(F.col("list"), F.xxhash64("id")).sortWithinPartitions("list").write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centroids)], "list int, centroid array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that ``build`` stored. The driver holds the centroids and two numbers a list."""
    rows = spark.read.parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    centroids = np.array([r["centroid"] for r in stored], float)
    counts, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("a")).collect():
        counts[r["list"]], radius[r["list"]] = r["n"], r["a"]
    return VectorIndex(rows.select("list", "id", "v"), centroids, counts, radius, stored[0]["probes"])


def _probe(queries: DataFrame, index: VectorIndex, probes: int, bounded: bool) -> DataFrame:
    """Queries with the lists to search: the nearest ``probes``, or, with a column ``bound``, the others that may hold a vector within that angle."""
    kind, vec = (queries.schema[c].dataType.simpleString() for c in ("qid", "v"))
    shipped = queries.sparkSession.sparkContext.broadcast((index.centroids, index.counts, index.radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, counts, radius = shipped.value
        for batch in batches:
            if not len(batch) or not counts.any():
                continue
            angle = np.arccos(np.clip(_matrix(batch.column(1)) @ centroids.T, -1, 1))
            angle[:, counts == 0] = np.inf
            rank = np.argsort(np.argsort(angle, 1, kind="stable"), 1, kind="stable")
            wanted = rank < probes
            if bounded:
                bound = batch.column(2).to_numpy(zero_copy_only=False)[:, None]
                wanted = ~wanted & (angle - radius <= bound + SLACK)
            wanted &= counts > 0
            at, lists = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(lists.astype(np.int32))], names=["qid", "v", "list"])

    return queries.select("qid", "v", *(["bound"] if bounded else [])).mapInArrow(run, f"qid {kind}, v {vec}, list int")


def _meet(asked: DataFrame, index: VectorIndex, k: int, digits: int) -> DataFrame:
    """Distances of queries ``qid, v, list`` to the rows of their lists: the best k of each cell, ``qid, id, distance``."""
    spark = asked.sparkSession
    asked = tables.cut(asked)
    per_list = asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a list
    schema = f"qid {asked.schema['qid'].dataType.simpleString()}, id {index.rows.schema['id'].dataType.simpleString()}, distance double"
    if not per_list:
        return spark.createDataFrame([], schema)
    sizes = [(r["list"], int(-(-index.counts[r["list"]] // CELL_ROWS)), -(-r["n"] // CELL_QUERIES)) for r in per_list]
    cells = F.broadcast(spark.createDataFrame(sizes, "list int, parts int, blocks int"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    left = asked.join(cells, "list").withColumn("block", mine("qid", "blocks")).select("list", every("parts").alias("part"), "block", "qid", "v")
    right = index.rows.join(cells, "list").withColumn("part", mine("id", "parts")).select("list", "part", every("blocks").alias("block"), "id", "v")

    def compare(_, queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return pa.table({"qid": queries.column("qid").slice(0, 0), "id": rows.column("id").slice(0, 0), "distance": pa.array([], pa.float64())})
        rows = rows.sort_by("id")
        v, ids = _matrix(rows.column("v").combine_chunks()), rows.column("id").combine_chunks()
        q = _matrix(queries.column("v").combine_chunks())
        distance = np.round(1 - q @ v.T, digits)
        best = np.argsort(distance, 1, kind="stable")[:, :k]
        at = np.repeat(np.arange(len(q)), best.shape[1])
        return pa.table({"qid": queries.column("qid").take(pa.array(at)), "id": ids.take(pa.array(best.ravel())), "distance": np.take_along_axis(distance, best, 1).ravel()})

    keys = ["list", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(queries: DataFrame, index: VectorIndex, k: int, probes: int | None = None, exact: bool = False, digits: int = 6) -> DataFrame:
    """Neighbours of unit queries ``qid, v``: ``qid, id, distance, similarity, rank``. Distances are rounded, then ties go to the smaller id.

    The ``probes`` nearest lists of each query are searched (the index's own number unless given); with ``exact`` also every list that may hold a row nearer than the k-th found, so nothing is missed.
    """
    queries, probes = queries.where("v IS NOT NULL").select("qid", "v"), probes or index.probes
    found = [_meet(_probe(queries, index, probes, False), index, k, digits)]
    if exact:
        first = tables.cut(_best(found[0], k))
        last = first.groupBy("qid").agg(F.max("distance").alias("d"), F.count(F.lit(1)).alias("n"))
        # rounding hides up to half a digit; too few neighbours exclude nothing
        bound = F.when(F.col("n") == k, F.acos(F.greatest(F.lit(-1.0), F.lit(1.0) - F.col("d") - 10.0**-digits))).otherwise(F.lit(4.0))
        rest = queries.join(last, "qid", "left").withColumn("bound", F.coalesce(bound, F.lit(4.0)))
        found = [first.drop("rank"), _meet(_probe(rest, index, probes, True), index, k, digits)]
    best = _best(reduce(DataFrame.unionByName, found), k)
    return best.select("qid", "id", "distance", F.greatest(F.lit(0.0), F.round(1 - F.col("distance"), digits)).alias("similarity"), "rank")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``n_queries, n_neighbours, recall``: the share of the true neighbours ``qid, id`` that were found."""
    hits = truth.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hits.agg(F.countDistinct("qid").alias("n_queries"), F.count(F.lit(1)).alias("n_neighbours"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
