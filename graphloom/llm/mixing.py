"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Documents fall into cells (source, language, topic). The cells' token weights are raked: in each
round, for each dimension in turn, every weight is scaled so that the dimension's
totals meet their targets, until all marginals are met to a tolerance. A document's inclusion probability is its cell's ratio of raked to
present weight, over the largest such ratio, so expected token shares follow the raked table exactly. A hash of
the identifier decides.

Only the cell table is iterated on. Its size is the number of distinct cells, whatever the number of rows;
a hot source is summed map-side.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import free_names, staged, text_or_empty


def topic_of(text: Column) -> Column:
    """A coarse topic from surface marks; null counts as empty."""
    n = F.octet_length(text)
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("!! "), "shout")
        .when(text.contains("$$$ ") | text.contains("%%% "), "symbols")
        .when(n < 600, "short")
        .when(n < 6000, "prose")
        .otherwise("long")
    )


def tokens_of(text: Column) -> Column:
    """Token estimate: a token for every four bytes, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("long")


def uniform(id_col: Column, salt: str, text: Column | None = None) -> Column:
    """A number in [0, 1) from the identifier alone; from the text where that is null."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("") if text is None else F.concat(F.lit("text:"), F.md5(text))), F.lit(":" + salt)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def tempered_targets(cells: DataFrame, dim: str, temper: float) -> DataFrame:
    """Target shares of a dimension's values: present token shares to the power ``temper``, scaled to add up to one."""
    shares = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("raw"))
    total = shares.agg(F.sum("raw")).first()[0] or 1.0
    return shares.select(dim, (F.col("raw") / F.lit(total)).alias(f"target_{dim}"))


def given_targets(spark: SparkSession, dim: str, shares: dict[str, float]) -> DataFrame:
    """Given shares of a dimension's values, scaled to add up to one."""
    total = sum(shares.values())
    if not shares or min(shares.values()) < 0 or total <= 0:
        raise ValueError(f"targets of {dim} must be shares of some values, none negative")
    return spark.createDataFrame([(k, v / total) for k, v in shares.items()], f"{dim} string, target_{dim} double")


def rake(cells: DataFrame, dims: list[str], targets: dict[str, DataFrame], rounds: int = 48, tolerance: float = 1e-12, at_once: int = 8) -> tuple[DataFrame, float]:
    """(``cells`` with ``weight``, residual) of rows of distinct ``dims`` with ``tokens``; targets: by dimension, rows ``dim, target_dim``.

    Runs ``at_once`` rounds at a time until no marginal is further than ``tolerance`` (relative) from its target, at most ``rounds``; the residual says how
    far the furthest one is. Cells without a target get weight 0; targets that no cell can meet leave a residual.
    """
    table = cells
    for dim in dims:
        table = table.join(targets[dim], dim, "left")
    table, done, off = table.withColumn("weight", F.col("tokens").cast("double")), 0, float("inf")
    while done < rounds and off > tolerance:
        for _ in range(min(at_once, rounds - done)):
            for dim in dims:
                total = F.sum("weight").over(Window.partitionBy(dim))
                table = table.withColumn("weight", F.when(total > 0, F.col("weight") * F.coalesce(f"target_{dim}", F.lit(0.0)) / total).otherwise(0.0))
            done += 1
        table = staged(table, "raked")
        gaps = [F.abs(F.sum("weight").over(Window.partitionBy(dim)) / F.col(f"target_{dim}") - 1).alias(dim) for dim in dims]
        off = max([x for x in table.select(*gaps).agg(*(F.max(F.when(F.col(dim) < float("inf"), F.col(dim))) for dim in dims)).first() if x is not None], default=0.0)
    return table.select(*dims, "tokens", "weight"), off


def probabilities(raked: DataFrame) -> DataFrame:
    """Adds ``prob`` to raked cells, a table that is read twice: weight by token, over the largest."""
    ratio = F.col("weight") / F.col("tokens")
    most = raked.agg(F.max(ratio)).first()[0] or 1.0
    return raked.withColumn("prob", ratio / F.lit(most))


DIMS = ["mix_source", "mix_lang", "mix_topic"]


def cell_columns(source_col: str, lang_col: str, text_col: str, topic: Column | None) -> dict[str, Column]:
    text = text_or_empty(text_col)
    of = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return {"mix_source": of(F.col(source_col)), "mix_lang": of(F.col(lang_col)), "mix_topic": of(topic_of(text) if topic is None else topic), "mix_tokens": tokens_of(text)}


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    targets: dict[str, dict[str, float]] | None = None,
    temper: dict[str, float] | None = None,
    rounds: int = 48,
    tolerance: float = 1e-12,
    salt: str = "mix",
    broadcast_cells: int = 100_000,
    source_col: str = "source",
    lang_col: str = "lang",
    text_col: str = "text",
    topic: Column | None = None,
) -> DataFrame:
    """All rows with ``mix_source, mix_lang, mix_topic, mix_tokens, mix_prob, mix_u, mix_kept`` added.

    ``targets`` gives token shares by dimension and value, ``{"mix_source": {"web": 0.7, "books": 0.3}}``; values that it doesn't name get none. A dimension
    without targets is tempered: its present shares to the power ``temper``. ``topic`` is a column of the rows' topics, surface marks of the text by default.
    Warns if the marginals aren't met within ``rounds``. Null sources, languages and topics form a value of their own (empty); null and empty texts have one token, and whole texts of any length are
    counted. Rows with one identifier share a decision within a cell; rows without one are decided by their text. Repeated rows are kept or dropped
    together. Own columns of any other name pass; one named like an added column is replaced. An empty table gives no rows.
    """
    temper = {"mix_source": 0.8, "mix_lang": 0.8, "mix_topic": 0.9} | (temper or {})
    found, given = cell_columns(source_col, lang_col, text_col, topic), targets or {}
    cells = staged(docs.select(*(c.alias(k) for k, c in found.items())).groupBy(*DIMS).agg(F.sum("mix_tokens").alias("tokens")), "mix-cells")
    goals = {d: given_targets(docs.sparkSession, d, given[d]) if d in given else tempered_targets(cells, d, temper[d]) for d in DIMS}
    raked, off = rake(cells, DIMS, goals, rounds, tolerance)
    if off > tolerance:
        warnings.warn(f"the target marginals are met to {off:.2g} only", stacklevel=2)
    table = probabilities(staged(raked, "mix-raked")).select(*DIMS, F.col("prob").alias("mix_prob"))
    side = F.broadcast(table) if cells.count() <= broadcast_cells else table  # otherwise a shuffled join, whose skew Spark splits
    added = [*DIMS, "mix_tokens", "mix_prob"]
    own = [c for c in docs.columns if c.lower() not in (*added, "mix_u", "mix_kept")]
    rows = docs.withColumns(found).join(side, DIMS)
    decided = uniform(F.col(id_col), salt, text_or_empty(text_col))
    return rows.select(*(F.col(f"`{c}`") for c in own), *added, decided.alias("mix_u")).withColumn("mix_kept", F.col("mix_u") < F.col("mix_prob"))


def sample(docs: DataFrame, **how) -> DataFrame:
    """The rows that ``mix`` keeps, with all their own columns, whatever their names."""
    spare = free_names(docs, len(docs.columns))
    renamed = docs.toDF(*spare)
    columns = {k: spare[docs.columns.index(how.get(k, v))] for k, v in (("id_col", "doc_id"), ("source_col", "source"), ("lang_col", "lang"), ("text_col", "text"))}
    return mix(renamed, **(how | columns)).where("mix_kept").select(*(F.col(a).alias(b) for a, b in zip(spare, docs.columns, strict=True)))
