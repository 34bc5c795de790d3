"""Exact dedup by a tree merge of sorted digest runs.

Every text becomes a digest entry ``(digest, n_bytes, keep, n)``. Records are dealt
over ``runs`` leaf runs by a hash of their identifier, so copies of a hot text
spread evenly, and each leaf run is sorted by digest and merged to one entry a
digest. Then ``fan`` partner runs at a time exchange entries: a round sorts what
partners hold of one digest slice and merges it in one streaming multiway pass
(one carried entry of state). After ``ceil(log_fan(runs))`` rounds one run is left, dealt
over digest slices. As in a binomial reduce-scatter, a group of ``fan**r`` runs is
dealt over ``fan**r`` slices, so tasks stay as many and as small in every round,
and an entry is seen at most ``fan`` times by a merge however hot its text is.

The surviving identifier is verified at every level: an entry is merged with the
next one only if SHA-256 *and* byte length agree, and the merge keeps the
largest (or smallest) identifier seen together with the number of rows.

The way back is salted by the leaf run: leaf entries (one for each run and digest)
look up the merged entry, and records look up their own leaf entry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import staged, text_or_empty


def merge_sorted(pick: str):
    """A streaming merge of entries sorted by (slot, digest, n_bytes). Arrow keeps 64-bit identifiers exact beside nulls."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            if not len(rows):
                continue
            # groups come in the order in which they are first met
            found = rows.group_by(["slot", "digest", "n_bytes"], use_threads=False).aggregate([("keep", pick), ("n", "sum")])
            found = found.rename_columns([c.removesuffix("_sum").removesuffix(f"_{pick}") for c in found.column_names]).select(rows.column_names).cast(rows.schema)
            held = found.slice(len(found) - 1)
            yield from found.slice(0, len(found) - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    return merge


def digest_entries(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """One slim row a document: identifier, leaf run, digest, length."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(runs)).alias("run"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def tree_merge(entries: DataFrame, runs: int, fan: int = 16, keep: str = "max") -> tuple[DataFrame, DataFrame]:
    """(leaf entries by run, merged entries by digest) of rows ``id, run, digest, n_bytes``."""
    best = F.max if keep == "max" else F.min
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # leaf level: map-side partial aggregation sends one entry for each run and digest of a task
    leaves = staged(entries.groupBy("run", "digest", "n_bytes").agg(best("id").alias("keep"), F.count(F.lit(1)).alias("n")), "dedup-leaves")
    entry = f"slot long, digest binary, n_bytes long, keep {leaves.schema['keep'].dataType.simpleString()}, n long"
    level, width = leaves.select("run", "digest", "n_bytes", "keep", "n"), 1
    for _ in range(max(1, math.ceil(math.log(max(2, runs), fan)))):
        width *= fan
        # partners of a group exchange: the group's digest slice names the task
        slice_of = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(min(width, runs)))
        group = F.floor(F.col("run") / width).cast("long")
        level = (
            level.withColumn("slot", (group * F.lit(runs) + slice_of).cast("long"))
            .repartition(parts, "slot", "digest")
            .sortWithinPartitions("slot", "digest", "n_bytes")
            .select("slot", "digest", "n_bytes", "keep", "n")
            .mapInArrow(merge_sorted(keep), entry)
            .withColumn("run", F.floor(F.col("slot") / runs).cast("long") * width)
            .drop("slot")
        )
    return leaves, level.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", runs: int = 64, fan: int = 16) -> DataFrame:
    """Groups of equal texts, one row per input row.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``. A null text is
    empty; rows with a null identifier count in their group, and keep_id is null only
    if all identifiers of the group are. Of equal texts the largest (or smallest) identifier wins; rows repeated with the same identifier
    and text all count, and each is ``kept`` if the identifier is the group's. Identifiers may be integers of any size or strings. Whole
    texts of any length are hashed in the JVM and never shuffled. An empty table gives no rows. Other columns are ignored,
    so clashing names cannot matter.
    """
    rows = digest_entries(docs, id_col, text_col, runs)
    leaves, merged = tree_merge(rows, runs, fan, keep)
    found = leaves.select("run", "digest", "n_bytes").join(merged, ["digest", "n_bytes"])
    return (
        rows.join(found, ["run", "digest", "n_bytes"])
        .select(
            F.col("id").alias("doc_id"),
            F.col("keep").alias("keep_id"),
            F.col("n").alias("group_size"),
            F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )
