"""Edges stored for look-ups from both ends.

An adjacency is two tables: edges bucketed and sorted by source, and by target. A join or an aggregate on that end reads its buckets where they lie, so only the asked keys are
shuffled, however large the graph; Bloom filters in the files let look-ups of single keys skip row groups. The edges of a hub
(a vertex with more than ``hub_edges`` of them at that end) would make one bucket hot, so they are kept apart without buckets. Keys of the two parts are disjoint: what is
done by key is done to each part and united (``per_key``).
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import cut, fresh_path

#: Rows of a bucket, when the number of buckets is not given.
BUCKET_ROWS = 2_000_000


@dataclass(frozen=True)
class Side:
    """The edges seen from one end: those of plain vertices in buckets, and those of hubs, if there are any."""

    plain: DataFrame
    hubs: DataFrame | None

    def whole(self) -> DataFrame:
        return self.plain if self.hubs is None else self.plain.unionByName(self.hubs)


@dataclass(frozen=True)
class Adjacency:
    out: Side
    into: Side


def bucketed(df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed and sorted by ``key``, with a Bloom filter on it. One task writes one bucket."""
    spark = df.sparkSession
    # a join on more keys than the bucket's may use the buckets too
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    n = buckets or max(8, -(-df.count() // BUCKET_ROWS))
    table = f"graphloom_{name}_{uuid.uuid4().hex}"
    rows = df.repartition(n, key).sortWithinPartitions(key)
    rows.write.format("parquet").option(f"parquet.bloom.filter.enabled#{key}", "true").option("path", fresh_path(spark, name)).bucketBy(n, key).sortBy(key).saveAsTable(table)
    atexit.register(drop, spark, table)
    return spark.table(table)


def drop(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:
        pass  # the session has ended already


def _side(edges: DataFrame, key: str, name: str, hub_edges: int, buckets: int | None) -> Side:
    hubs = cut(edges.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub_edges).select(key))  # at most the edges / hub_edges rows
    if not hubs.take(1):
        return Side(bucketed(edges, key, name, buckets), None)
    plain = bucketed(edges.join(hubs, key, "left_anti").select(*edges.columns), key, name, buckets)
    table = f"graphloom_{name}_hubs_{uuid.uuid4().hex}"
    edges.join(hubs, key, "left_semi").select(*edges.columns).write.format("parquet").option("path", fresh_path(edges.sparkSession, name)).saveAsTable(table)
    atexit.register(drop, edges.sparkSession, table)
    return Side(plain, edges.sparkSession.table(table))


def write_adjacency(edges: DataFrame, hub_edges: int = 100_000, buckets: int | None = None) -> Adjacency:
    """Store ``src_type, src_id, edge_type, dst_type, dst_id`` by both ends. The tables go when the driver exits. Keys are the ids, which carry their type."""
    return Adjacency(_side(edges, "src_id", "out", hub_edges, buckets), _side(edges, "dst_id", "into", hub_edges, buckets))


def per_key(edges: DataFrame | Adjacency, end: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on the edges seen from ``end`` (out, into); it must treat every vertex of that end apart."""
    if isinstance(edges, DataFrame):
        return work(edges)
    side: Side = getattr(edges, end)
    return work(side.plain) if side.hubs is None else work(side.plain).unionByName(work(side.hubs))


def all_edges(edges: DataFrame | Adjacency) -> DataFrame:
    return edges if isinstance(edges, DataFrame) else edges.out.whole()
