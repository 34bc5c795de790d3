"""A keyed table that is upserted bucket by bucket.

Rows lie in buckets by a hash of their key. A manifest names the folder that holds each bucket's rows now. An upsert rewrites the buckets that its batch touches into new
folders and commits them all at once by creating the next manifest, which fails if another writer has created it. Folders that no manifest
names are leftovers of writers that failed; readers never see them. The driver holds the manifest (a line a bucket), never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


class KeyedStore:
    """Rows of a fixed schema under ``path``, one for each value of ``keys``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.empty = spark.createDataFrame([], schema)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, dict[str, str]]:
        """(generation, folder by bucket) of the newest manifest; generation 0 is the empty store."""
        folder = self._path(f"{self.path}/manifests")
        found = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        newest = max((int(n.removesuffix(".json")) for n in found if n.endswith(".json")), default=0)
        if not newest:
            return 0, {}
        text = self.spark.read.text(f"{folder.toString()}/{newest:08d}.json", wholetext=True).first()[0]
        return newest, json.loads(text)

    def _commit(self, generation: int, folders: dict[str, str]) -> None:
        """Create the manifest as a whole: its text is written aside and renamed, which must not replace another one."""
        where = self._path(f"{self.path}/manifests/{generation:08d}.json")
        aside = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if self._fs.exists(where) or not self._fs.rename(aside, where):
            self._fs.delete(aside, False)
            raise RuntimeError(f"another writer has committed generation {generation}")

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.empty.schema).parquet(*folders) if folders else self.empty

    def read(self) -> DataFrame:
        return self._rows(sorted(set(self._manifest()[1].values())))

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))

    def last_writes(self, batch: DataFrame, seq: str | None = None) -> DataFrame:
        """One row a key: the last by ``seq``; without one, or on ties, the largest by the other columns. Rows with a null in the key are rows of that key."""
        rest = [c for c in self.empty.columns if c not in self.keys]
        order = F.struct(*([seq] if seq else []), *rest) if rest or seq else F.lit(0)
        best = batch.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order).alias("_r")) if rest else batch.select(*self.keys).distinct()
        return best.select(*(F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in self.empty.columns))

    def upsert(self, batch: DataFrame, seq: str | None = None) -> int:
        """Put the batch's rows over the stored ones; returns how many buckets were rewritten."""
        from .tables import cut

        generation, folders = self._manifest()
        new = cut(self.last_writes(batch, seq).withColumn("_bucket", self._bucket()))
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())
        if not touched:
            return 0
        old = self._rows([folders[str(b)] for b in touched if str(b) in folders])
        kept = old.join(new.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys))), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)], "left_anti")
        target = f"{self.path}/data/{generation + 1:08d}-{uuid.uuid4().hex}"
        rows = kept.withColumn("_bucket", self._bucket()).unionByName(new)
        rows.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(target)
        self._commit(generation + 1, folders | {str(b): f"{target}/_bucket={b}" for b in touched})
        return len(touched)
