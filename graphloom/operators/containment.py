"""Which texts contain all of a query's needles, as an equi-join.

Every text is listed under its grams (substrings of one length); a query looks up the gram that the fewest texts hold, of those of its needles, and the texts found are
checked against all needles. Texts of a very frequent gram are split by a hash of their key, so no gram is a hot key, and no pair is looked at that
doesn't share the rarest gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import cut

GRAM = 6
#: Texts of a gram in one task, and how many grams are split at most: a gram past that number has less than this share of all listings.
PART_ROWS, MOST_SPLIT = 100_000, 1000
#: Asked grams (8 bytes each) up to this number are brought to the texts.
FEW_GRAMS = 1_000_000
#: Signs whose grams are made at once: their hashes stay in a core's cache.
SIGNS = 100_000


def _hashes(signs: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hash of the substring of that size at each place), sizes of 1 and more: a hash is made of the one that is shorter by a sign."""
    h = np.zeros(len(signs), np.uint64)
    for i in range(min(max(sizes, default=0), len(signs))):
        h = h[: len(signs) - i]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += signs[i:]
        if i + 1 in sizes:
            mixed = h + np.uint64(i + 1)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            yield i + 1, mixed


def grams(texts: list[str], sizes: list[int], wanted: np.ndarray | None = None, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each substring of ``sizes`` signs of ``texts``; shorter texts have none, and for size 0 every text has one. With ``wanted`` (sorted) and the ``marks`` of its first 22 bits only those."""
    signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if 0 in sizes and (wanted is None or 0 in wanted):
        rows, hashes = [np.arange(len(texts))], [np.zeros(len(texts), np.int64)]
    for size, h in _hashes(signs, [k for k in sizes if k]):
        at = np.arange(len(h)) if marks is None else np.flatnonzero(marks[h >> np.uint64(42)])  # most grams that nobody asks fall through here
        found = h[at].view(np.int64)
        if wanted is not None:
            exact = wanted[np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)] == found
            at, found = at[exact], found[exact]
        row = np.searchsorted(ends, at, side="right")
        whole = at + size <= ends[row]
        rows.append(row[whole])
        hashes.append(found[whole])
    return np.concatenate(rows), np.concatenate(hashes)


def rolled(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """``grams`` of one size, all of them."""
    return grams(texts, [size])


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``SIGNS`` signs together, with the place of their first."""
    first = total = 0
    for k, t in enumerate(texts):
        if total and total + len(t) > SIGNS:
            yield first, texts[first:k]
            first, total = k, 0
        total += len(t)
    if first < len(texts):
        yield first, texts[first:]


def listing(texts: pd.Series, sizes: list[int], wanted: np.ndarray | None) -> list[np.ndarray]:
    """The distinct hashes of each text's substrings of these sizes; those of ``wanted`` (sorted) only, if it is given. Null texts have none."""
    found = [np.zeros(0, np.int64)] * len(texts)
    known, marks = texts.notna().to_numpy(), None
    if wanted is not None:
        if not len(wanted):
            return found
        marks = np.zeros(1 << 22, bool)
        marks[wanted.view(np.uint64) >> np.uint64(42)] = True
    for first, part in _slices(["" if t is None else t for t in texts]):
        rows, hashes = grams(part, sizes, wanted, marks)
        keep = known[first + rows]
        rows, hashes = rows[keep], hashes[keep]
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[new], hashes[new]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        for a, b in zip(starts, np.append(starts[1:], len(rows))):
            found[first + rows[a]] = hashes[a:b]
    return found


def _listed(text: Column, sizes: list[int], wanted: Broadcast | None = None) -> Column:
    @F.pandas_udf("array<bigint>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(listing(texts, sizes, None if wanted is None else wanted.value), dtype=object)

    return of(text)


def containing(asked: DataFrame, texts: DataFrame, needles: str = "needles", text: str = "text", key: str = "key", size: int = GRAM) -> DataFrame:
    """Pairs of ``asked`` rows and ``texts`` rows whose text contains all needles, with the columns of both.

    needles: an array of strings; null ones and null texts match nothing, an empty needle is in every text, and so is an empty array. Queries that
    repeat should be made distinct before. ``key`` names the texts' column that splits frequent grams.
    """
    ask = asked.where(F.col(needles).isNotNull() & ~F.exists(needles, lambda n: n.isNull()))
    filled = F.when(F.size(needles) == 0, F.array(F.lit(""))).otherwise(F.col(needles))
    ask = ask.withColumn("_id", F.sha2(F.to_json(F.struct(*ask.columns)), 256)).withColumn("_needles", filled)
    ask = cut(ask)  # read four times below
    # a query is looked up by its needles of ``size`` signs and more; one without any by all its needles, as they may be rare where the longest isn't
    longest = F.array_max(F.transform("_needles", F.length))
    short = F.when(longest >= size, size).otherwise(F.least(F.lit(1), longest))
    each = ask.select("_id", F.explode(F.filter("_needles", lambda n: F.length(n) >= short)).alias("_needle")).withColumn("_size", F.least(F.lit(size), F.length("_needle")))
    lengths = [r["n"] for r in each.select(F.col("_size").alias("n")).distinct().collect()]  # at most ``size`` + 1 rows
    if not lengths:
        return ask.select(*asked.columns).crossJoin(texts.limit(0))
    parts = [each.where(F.col("_size") == k).select("_id", F.explode(_listed(F.col("_needle"), [k])).alias("_gram")) for k in lengths]
    wanted = cut(reduce(DataFrame.unionByName, parts).distinct())

    def only(grams: DataFrame) -> DataFrame:
        """Listings of these grams; before any shuffle, if the grams are few."""
        few = grams.select("_gram").distinct()
        if few.count() <= FEW_GRAMS:
            sent = texts.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in few.collect()], np.int64)))  # 8 bytes each
            return texts.withColumn("_gram", F.explode(_listed(F.col(text), lengths, sent)))
        return texts.withColumn("_gram", F.explode(_listed(F.col(text), lengths))).join(few, "_gram", "left_semi")

    counts = only(wanted).groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = wanted.join(counts, "_gram", "left").groupBy("_id").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_gram")).alias("r")).select("_id", "r._n", "r._gram").where("_n > 0")
    rarest = cut(rarest)  # a row a query; the listing is counted once
    often = rarest.select("_gram", F.ceil(F.col("_n") / PART_ROWS).alias("_parts")).where("_parts > 1").distinct().orderBy(F.desc("_parts"), "_gram").limit(MOST_SPLIT)
    looked_up = ask.join(rarest.drop("_n"), "_id").join(F.broadcast(often), "_gram", "left")
    looked_up = looked_up.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts", "_id")
    split = only(rarest).join(F.broadcast(often), "_gram", "left").withColumn("_part", F.pmod(F.xxhash64(key), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    found = looked_up.join(split, ["_gram", "_part"]).where(F.forall("_needles", lambda n: F.col(text).contains(n)))
    return found.select(*asked.columns, *texts.columns)
