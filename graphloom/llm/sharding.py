"""Sharding by weighted rendezvous hashing of stable record keys (DataFrame functions only).

Every (key, shard) pair has a hash u in (0, 1); a record goes to the shard with the
largest ``-weight / ln(u)``. A pair's score does not depend on other shards, so
a new shard takes rows only into itself and a removed one gives away only its own; shard j gets
``weight_j / sum(weights)`` of the keys in expectation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import text_or_empty


def pair_score(key: Column, shard: int, weight: float = 1.0) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return F.lit(-float(weight)) / F.log(u)


def rendezvous(key: Column, weights: list[float], first: int = 0) -> Column:
    """struct(score, neg): the best pair's score and minus its shard, so ties go to the smaller shard."""
    pairs = [F.struct(pair_score(key, j, w).alias("score"), F.lit(-j).alias("neg")) for j, w in enumerate(weights, first)]
    return F.array_max(F.array(*pairs))


COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def carried_names(carry: tuple[str, ...]) -> list[str]:
    found = list(COLUMNS)
    for c in carry:
        while c.lower() in (x.lower() for x in found):
            c = f"carried_{c}"
        found.append(c)
    return found[len(COLUMNS) :]


def shard(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", added_weight: float = 1.0, slot_buckets: int = 1024, carry: tuple[str, ...] = ()) -> DataFrame:
    """Shard and slot of every row under the ``key`` law, and the shard if one more came.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and the ``carry`` columns; one of these named like a column
    before it, in any case, is returned as ``carried_<name>``. Size is the text's UTF-8 bytes plus 1, of texts of any length; a null text counts as empty. Null identifiers share one
    key and so a shard. Repeated rows fall into one shard with different slots, and ties in identifier, text and size are numbered in any order, which no column tells. Slots are
    gapless from 0 within a shard: rows are numbered within hash buckets (of identifier and text) of a shard and
    shifted by the counts of the buckets before, so no task holds a whole shard.
    The bucket offsets are broadcast; they number ``len(weights) * slot_buckets`` at most. An empty table gives no rows.
    """
    key = F.col(id_col)
    text = text_or_empty(text_col)
    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)),
        key.alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        rendezvous(key, weights).alias("best"),
        pair_score(key, len(weights), added_weight).alias("added"),
        F.pmod(F.xxhash64(key, text, F.lit("slot")), F.lit(slot_buckets)).alias("bucket"),
    ).select("*", (-F.col("best.neg")).cast("int").alias("shard"))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"),
        F.when(F.col("added") > F.col("best.score"), F.lit(len(weights))).otherwise(F.col("shard")).cast("int").alias("grown_shard"),
        *(F.col(f"_c{i}").alias(name) for i, name in enumerate(carried_names(carry))),
    )
