"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Spark 4.1's partitioning of unions can be wrong for the aggregates and windows above them
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:
        pass  # the session has ended already


_STAGED: list[str] = []


def staged_so_far() -> int:
    return len(_STAGED)


def release(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Delete the tables staged after the first ``since``, but for the last ``but``: nothing may read them any more."""
    paths = _STAGED[since : len(_STAGED) - but]
    del _STAGED[since : len(_STAGED) - but]
    for path in paths:
        _forget(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back. The files go when the driver exits."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def staged_slim(df: DataFrame, name: str) -> DataFrame:
    """staged() for rows of a few numbers each: shuffle partitions are as many as texts need, so an eighth of them, but at least 16, write such a table without small files."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.coalesce(max(16, parts // 8)), name)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def as_text(column: str) -> Column:
    """A column as a string for the way through Python workers: pandas has no nullable 64-bit integers of its own. Cast back, it is the same."""
    return F.col(column).cast("string")


def free_names(df: DataFrame, n: int) -> list[str]:
    """Column names that ``df`` doesn't have, in any case."""
    taken, found = {c.lower() for c in df.columns}, []
    while len(found) < n:
        name = f"_k{len(found)}"
        while name in taken:
            name += "_"
        found.append(name)
    return found


def row_keys(id_col: str, text_col: str, first: str, second: str) -> list[Column]:
    """Two 64-bit hashes of identifier and text that tell rows apart; never null."""
    text = text_or_empty(text_col)
    return [F.xxhash64(as_text(id_col), text).alias(first), F.xxhash64(text, F.lit(second), as_text(id_col)).alias(second)]


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Bound what one Arrow batch to a Python worker holds, in rows and bytes, unless the session has set less. Both stay set for the session: batches are cut when a plan runs."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        try:
            now = int(str(spark.conf.get(key, str(most))).rstrip("bB") or most)
        except ValueError:
            now = most
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
