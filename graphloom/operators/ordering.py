"""Positions, comparisons of sequences and exact percentiles over rows that no single task can hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import cut

#: Small tables up to this many rows (of a key and a few numbers) are brought to the rows that they go with.
FEW = 100_000


def positions(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """``df`` with the number of each row in the order, from 1. Rows are dealt by ranges and written once; only a count for each range goes through one task. Ties have neighbouring numbers in any order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut(dealt).withColumns({"_part": F.shiftright("_at", 33), "_i": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    return dealt.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").select(*df.columns, (F.col("_before") + F.col("_i") + 1).alias(name))


def compare_sequences(a: DataFrame, b: DataFrame, key: str, order: str, mode: str) -> DataFrame:
    """One row on two runs as sequences: rows, places whose keys differ, the first such place, and how many modes each run mixes; ``same`` if keys stand alike and each run has one mode, the same one."""
    placed = [positions(df.select(key, order, mode), order, key) for df in (a, b)]
    left, right = placed[0].select("position", F.col(key).alias("_a"), F.lit(True).alias("_in_a")), placed[1].select("position", F.col(key).alias("_b"), F.lit(True).alias("_in_b"))
    differs = ~(F.col("_a").eqNullSafe(F.col("_b")) & F.col("_in_a").eqNullSafe(F.col("_in_b")))
    places = left.join(right, "position", "full_outer").agg(F.count("_in_a").alias("n_a"), F.count("_in_b").alias("n_b"), F.count_if(differs).alias("n_differ"), F.min(F.when(differs, F.col("position"))).alias("first_difference")).withColumn("one", F.lit(1))
    modes = lambda df, side: df.agg(F.countDistinct(mode).alias(f"modes_{side}"), F.min(mode).alias(f"_mode_{side}")).withColumn("one", F.lit(1))
    rows = places.join(modes(a, "a"), "one").join(modes(b, "b"), "one")
    same = (F.col("n_differ") == 0) & (F.greatest("modes_a", "modes_b") <= 1) & F.col("_mode_a").eqNullSafe(F.col("_mode_b"))
    return rows.select("n_a", "n_b", "n_differ", "first_difference", "modes_a", "modes_b", same.alias("same"))


def exact_percentiles(df: DataFrame, key: str, value: str, shares: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Exact, linearly interpolated percentiles: ``key, share, percentile``; null values don't count, and a key without any has no row.

    A mergeable sketch brackets the two ranks of each percentile; a second pass counts the values below the bracket and collects the distinct ones in it, some six in ``accuracy`` of a
    key's rows. Should a bracket have missed its ranks, the pass is repeated with wider ones, at last with all values.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_v"))
    for grain in (accuracy, 100, 0):
        margin = 3.0 / grain if grain else 1.0
        at = lambda s: F.min("_v") if s <= 0 else F.max("_v") if s >= 1 else F.percentile_approx("_v", F.lit(s), F.lit(max(grain, 1)))  # noqa: B023, E731
        ends = [F.struct(F.lit(float(s)).alias("share"), at(s - margin).alias("lo"), at(s + margin).alias("hi")) for s in shares]
        brackets = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.array(*ends).alias("e"))
        brackets = cut(brackets.select("_key", "n", F.explode("e").alias("e")).select("_key", "n", "e.*"))
        near = F.broadcast(brackets) if brackets.count() <= FEW else brackets
        met = rows.join(near.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k"))).where("_v <= hi")
        # all values below the bracket count as one
        seen = met.select("_key", "share", "n", F.when(F.col("_v") < F.col("lo"), F.lit(None)).otherwise(F.col("_v")).alias("v")).groupBy("_key", "share", "n", "v").agg(F.count(F.lit(1)).alias("c"))
        up_to = F.sum("c").over(Window.partitionBy("_key", "share").orderBy(F.col("v").asc_nulls_first()))
        place = F.col("share") * (F.col("n") - 1)
        rank = lambda r: F.min(F.when(F.col("u") > r, F.struct("u", "v")))["v"]
        found = seen.withColumn("u", up_to).groupBy("_key", "share", "n").agg(rank(F.floor(place)).alias("a"), rank(F.ceil(place)).alias("b"))
        found = cut(found)
        if not found.where("a IS NULL OR b IS NULL").take(1):
            break
    lower, upper = F.floor(place), F.ceil(place)
    mixed = F.when(lower == upper, F.col("a")).otherwise((upper - place) * F.col("a") + (place - lower) * F.col("b"))
    return found.select(F.col("_key").alias(key), "share", mixed.alias("percentile"))
