"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. In every stage own columns pass with their names and types, whatever
they are called; null and empty texts count as empty, long texts are read whole, rows with null identifiers are rows like others, and
an empty table gives an empty one. What ties and repeated rows do is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, mixing, near_copies, sharding, toxicity
from graphloom.llm.common import release, staged, staged_so_far, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. The model learns from the labelled rows of the stage's own input. A score at the threshold goes; repeated rows go or stay together."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of 5-word shingles 0.8 or more) stays: the one with the smallest identifier. Repeated rows stay once; texts without words are copies of each other."""
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Repeated rows go or stay together; an empty benchmark lets all stay."""
    return decontaminate.keep_free(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by their raked probabilities. Repeated rows are kept or dropped together; rows without an identifier are decided by their text."""
    return mixing.sample(docs)


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot; an own column named like one of these comes back as ``carried_<name>``. Repeated rows share a shard and have slots of their own."""
    return sharding.shard(docs, weights=[1.0] * 16, carry=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_rows),
]

#: The learnt toxicity model and the edit matching are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each result is written before the next stage reads it, and a stage's own tables go with it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = staged_so_far()
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, since=before, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
