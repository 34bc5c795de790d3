"""Vector operators: exact kNN, truncation, projection, pooling, checks.

kNN takes the queries in bounded blocks to the workers; each Arrow batch keeps its own best k a
query, so the shuffle holds k rows for each query and batch whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once; inside a lambda Spark would compute it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalized(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    return bound(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def layer_normed(v: Column, eps: float = 1e-5) -> Column:
    """Zero mean and unit variance, without scale and shift."""
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")) / n
    centred = bound(mean, lambda m: F.transform(v, lambda x: x.cast("double") - m))
    deviation = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x) / n + eps)
    return bound(centred, lambda c: bound(deviation(c), lambda d: F.transform(c, lambda x: x / d)))


def truncated(v: Column, dims: int, most: int = 768) -> Column:
    """The first dims values as a unit vector."""
    if not 0 < dims <= most:
        raise ValueError(f"dimensions must be 1 to {most}")
    return l2_normalized(F.slice(v, 1, dims))


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors under the mask; the divisor is 1e-9 at least."""
    kept = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, x: a + x.cast("double")), F.lit(1e-9))
    first = F.transform(F.try_element_at(tokens, F.lit(1)), lambda x: F.lit(0.0))
    pairs = F.arrays_zip(tokens.alias("t"), mask.alias("m"))
    total = F.aggregate(pairs, first, lambda a, p: F.zip_with(a, p["t"], lambda x, y: x + y.cast("double") * p["m"].cast("double")))
    return bound(kept, lambda k: F.transform(total, lambda x: x / k))


def projected(df: DataFrame, v_col: str, matrix: np.ndarray, out: str = "projected") -> DataFrame:
    """Adds the vector times a matrix (two linear layers fold into one)."""

    @F.pandas_udf("array<double>")
    def times(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(v.to_numpy()).astype(float) @ matrix))

    return df.withColumn(out, times(v_col))


def query_blocks(queries: DataFrame, rows: int) -> Iterator[tuple[list, np.ndarray]]:
    """The stated queries in blocks of about ``rows``, one at a time on the driver."""
    n = queries.count()
    blocks = max(1, -(-n // rows))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        found = sorted((r["qid"], r["v"]) for r in part.collect())
        if found:
            yield [q for q, _ in found], np.array([v for _, v in found], float)


def knn(queries: DataFrame, corpus: DataFrame, k: int, block: int = 4096, digits: int = 6) -> DataFrame:
    """Exact cosine neighbours of unit vectors: ``qid, id, distance, similarity, rank``.

    queries: ``qid, v``; corpus: ``id, v``. Distances are rounded, then ties go to the smaller id. A query isn't its own neighbour only
    if the caller filters it out beforehand or asks for k + 1.
    """
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, distance double"

    def search(ids: list, matrix: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                at, order = batch["id"].to_numpy(), np.argsort(batch["id"].to_numpy(), kind="stable")
                at, v = at[order], np.stack(batch["v"].to_numpy()[order]).astype(float)
                for a in range(0, len(ids), 256):
                    d = np.round(1 - matrix[a : a + 256] @ v.T, digits)
                    best = np.argsort(d, axis=1, kind="stable")[:, :k]
                    n = best.shape[1]
                    yield pd.DataFrame({"qid": np.repeat(ids[a : a + 256], n), "id": at[best].ravel(), "distance": np.take_along_axis(d, best, 1).ravel()})

        return run

    found = [corpus.select("id", "v").mapInPandas(search(ids, m), schema) for ids, m in query_blocks(queries.select("qid", "v"), block)]
    if not found:
        return queries.sparkSession.createDataFrame([], schema + ", similarity double, rank int")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    best = reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("qid", "id", "distance", F.greatest(F.lit(0.0), F.round(1 - F.col("distance"), digits)).alias("similarity"), "rank")


def documents_of(seeds: DataFrame, doc_col: str = "doc", most: int = 50) -> DataFrame:
    """Best chunk a document: ``qid, doc, best_rank, doc_rank``."""
    best = seeds.where(F.coalesce(F.col(doc_col).cast("string"), F.lit("")) != "").groupBy("qid", F.col(doc_col).alias("doc")).agg(F.min("rank").alias("best_rank"))
    return best.withColumn("doc_rank", F.row_number().over(Window.partitionBy("qid").orderBy("best_rank"))).where(F.col("doc_rank") <= most)


def vector_checks(vectors: DataFrame, dims: int, id_col: str = "id", v_col: str = "v", tolerance: float = 1e-3) -> DataFrame:
    """One row of counts: rows, distinct ids, wrong sizes, non-finite, zero and non-unit vectors."""
    v = F.col(v_col)
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).alias("i"), F.size(v).alias("n"), finite.alias("f"), norm(v).alias("l"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("i").alias("n_ids"),
        F.count_if(F.col("n") != dims).alias("wrong_size"),
        F.count_if(~F.col("f")).alias("not_finite"),
        F.count_if(F.col("l") == 0).alias("zero"),
        F.count_if(F.abs(F.col("l") - 1) > tolerance).alias("not_unit"),
    )
