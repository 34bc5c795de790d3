"""Merkle dataset manifest: a tree for each group, a tree over the groups, and a proof for each row.

A row's leaf hashes its fields. Leaves of a group, in order of their identifiers, are reduced by runs of eight until one node is
left, the group's subroot; the subroots are reduced likewise to the root.

Rows are numbered by a range partitioning (group, identifier, leaf) that is written once, and the offsets of its parts, so a hot group spreads over
as many tasks as it has rows. Large blocks of 512 consecutive nodes are reduced where they lie, and each block is
written as one row with its inner levels; rounds of such blocks follow until few nodes are left. The driver builds this top tree and broadcasts, for each of its
nodes, the path to the root: the siblings to the left and right on every level. Executors put a row's own
siblings before its block's path, hash the proof, and fold the row's leaf (or one computed from changed fields) up to the root.
All hashing but the driver's is done by Spark's own functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged

FAN = 8
#: Levels of a block: 8 ** 3 = 512 nodes.
LEVELS = 3

PATH = "array<struct<l:string,r:string>>"


def leaf(columns: Sequence[Column]) -> Column:
    """Hash of the values, each as ``-`` if null, else its UTF-8 length, ``:`` and the value."""
    text = lambda c: c.cast("string")
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns)), 256)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _offsets(rows: DataFrame, key: str) -> DataFrame:
    """``key, part, first, before, total``: where a part's rows of a key begin in the part and in the key, and how many the key has. As many rows as parts and keys at most, in all."""
    parts = rows.groupBy(key, "part").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select(key, "part", "first", before.alias("before"), F.sum("n").over(w).alias("total"))


def numbered(rows: DataFrame, key: str, order: Sequence[str], name: str, broadcast_rows: int = 100_000) -> DataFrame:
    """``rows`` with ``pos``, the number of a row in its key by the order (from 0), and ``total``, the rows of its key. Written once, so that a lost executor can't change it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).withColumn("at", at)
    dealt = staged(dealt.withColumns({"part": F.shiftright("at", 33), "i": F.col("at").bitwiseAND((1 << 33) - 1)}).drop("at"), name)
    offsets = staged(_offsets(dealt, key), f"{name}-offsets")
    if offsets.count() <= broadcast_rows:
        offsets = F.broadcast(offsets)
    pos = (F.col("i") - F.col("first") + F.col("before")).cast("long")
    return dealt.join(offsets.withColumnRenamed(key, "_key"), (F.col(key).eqNullSafe(F.col("_key"))) & (dealt["part"] == offsets["part"])).select(*(c for c in rows.columns), pos.alias("pos"), "total")


def _upper(level: Column) -> Column:
    """The level above: runs of eight become their hash."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * FAN + 1, F.lit(FAN)), ""), 256))


def _siblings(level: Column, at: Column) -> Column:
    """The others of the run of node ``at``, before and after it."""
    begin = (F.floor(at / FAN) * FAN).cast("int")
    left = F.array_join(F.slice(level, begin + 1, at - begin), "")
    return F.struct(left.alias("l"), F.array_join(F.slice(level, at + 2, begin + FAN - 1 - at), "").alias("r"))


def reduce_blocks(nodes: DataFrame, carry: Sequence[str], name: str) -> DataFrame:
    """One row for each block of 512 nodes ``grp, pos, total, digest`` (and what is carried): ``grp, block, rows, l0, l1, l2, levels, node, above``.

    A group of one node stays as it is; one of up to 512 nodes ends with as many levels as it needs; others have three. ``above`` is the number of nodes that the group has then.
    """
    size = FAN**LEVELS
    row = F.struct("pos", "digest", *carry)
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / size).cast("long")).groupBy("grp", "block").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.max("total").alias("total"))
    blocks = blocks.withColumn("l0", F.col("rows.digest"))
    more = lambda below, times: F.when(F.col("total") > FAN**times, _upper(F.col(below)))
    # levels of their own columns, so that none is computed twice
    blocks = blocks.withColumn("l1", more("l0", 0)).withColumn("l2", more("l1", 1)).withColumn("l3", more("l2", 2))
    top = F.element_at(F.coalesce("l3", "l2", "l1", "l0"), 1)
    levels = sum((F.when(F.col("total") > FAN**i, 1).otherwise(0) for i in range(1, LEVELS)), F.when(F.col("total") > 1, 1).otherwise(0))
    return staged(blocks.select("grp", "block", "rows", "l0", "l1", "l2", levels.alias("levels"), top.alias("node"), F.ceil(F.col("total") / size).cast("long").alias("above")), name)


def _inner_path(at: Column) -> Column:
    """Siblings on the levels inside a block, of the node at index ``at`` in it."""
    step = lambda level, i: F.when(F.col("levels") > i, F.array(_siblings(F.col(level), (at / FAN**i).cast("int"))))
    none = F.array().cast(PATH)
    return F.concat(*(F.coalesce(step(level, i), none) for i, level in enumerate(("l0", "l1", "l2"))))


def top_paths(nodes: Sequence[tuple[str | None, str]]) -> tuple[list[list[tuple[str, str]]], list[str], str | None]:
    """(path, subroot) of each of the nodes, and the root. Nodes ``(group, digest)`` come by group and position."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]
    groups: list[list[int]] = []
    for i, (group, _) in enumerate(nodes):
        if not i or group != nodes[i - 1][0]:
            groups.append([])
        groups[-1].append(i)

    def fold(digests: list[str], members: list[list[int]]) -> str:
        while len(digests) > 1:
            above, merged = [], []
            for a in range(0, len(digests), FAN):
                run = digests[a : a + FAN]
                for k in range(len(run)):
                    step = ("".join(run[:k]), "".join(run[k + 1 :]))
                    for i in members[a + k]:
                        paths[i].append(step)
                above.append(_sha("".join(run)))
                merged.append([i for m in members[a : a + FAN] for i in m])
            digests, members = above, merged
        return digests[0]

    subroots = [fold([nodes[i][1] for i in g], [[i] for i in g]) for g in groups]
    of_node = [s for s, g in zip(subroots, groups, strict=True) for _ in g]
    root = fold(subroots, groups) if subroots else None
    return paths, of_node, root


def _top(nodes: DataFrame) -> tuple[DataFrame, str | None]:
    """Path and subroot of the few nodes that are left, by way of the driver."""
    found = nodes.select("grp", "block", "node").orderBy(F.col("grp").asc_nulls_first(), "block").collect()
    paths, subroots, root = top_paths([(r["grp"], r["node"]) for r in found])
    rows = [(r["grp"], r["block"], s, p) for r, s, p in zip(found, subroots, paths, strict=True)]
    return nodes.sparkSession.createDataFrame(rows, f"grp string, block long, subroot string, path {PATH}"), root


def _with_path(blocks: DataFrame, paths: DataFrame, small: bool) -> DataFrame:
    paths = F.broadcast(paths) if small else paths
    paths = paths.select(F.col("grp").alias("_grp"), F.col("block").alias("_block"), "subroot", F.col("path").alias("rest"))
    return blocks.join(paths, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_block")))


def _tree(nodes: DataFrame, carry: Sequence[str], most: int) -> tuple[list[DataFrame], DataFrame, bool]:
    """Rounds of blocks until at most ``most`` nodes are left, or none is left to join in any group: (rounds, nodes, few)."""
    rounds, level = [], nodes
    while True:
        blocks = reduce_blocks(level, carry if not rounds else (), f"merkle-round{len(rounds)}")
        rounds.append(blocks)
        left, joined = blocks.agg(F.count(F.lit(1)), F.max("above")).first()
        if left <= most or (joined or 0) <= 1:
            return rounds, blocks, left <= most
        level = blocks.select("grp", F.col("block").alias("pos"), F.col("above").alias("total"), F.col("node").alias("digest"))


def _down(rounds: list[DataFrame], paths: DataFrame, small: bool) -> DataFrame:
    """Paths of the blocks of the first round from those of the last."""
    for blocks in reversed(rounds[1:]):
        found = _with_path(blocks, paths, small)
        size = FAN**LEVELS
        own = F.transform("rows", lambda r: F.struct(r["pos"].alias("pos"), F.concat(_inner_path((r["pos"] % size).cast("int")), F.col("rest")).alias("path")))
        paths = found.select("grp", "subroot", F.explode(own).alias("r")).select("grp", F.col("r.pos").alias("block"), "subroot", "r.path")
        small = False
    return paths


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", tampered: Column | None = None, changed: dict[str, Column] | None = None, most: int = 4096) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row.

    The leaf hashes ``columns`` in their order. Groups come with the null one first, then by their bytes; leaves of a group by identifier (null first), rows with one identifier
    by their leaf, so repeated rows have places of their own. Rows for which ``tampered`` is true are verified with the columns in ``changed`` replaced (null columns stay null);
    ``folded_root`` is what their leaf and the original siblings fold to. Empty texts hash as ``0:``, whole texts are hashed however long, and only digests
    are shuffled. An empty table gives no rows. Other columns aren't read. At most ``most`` nodes reach the driver: if there are more groups than that, the tree over
    the groups is reduced by blocks as well.
    """
    changed = changed or {}
    flag = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    new = leaf([F.when(F.col(c).isNotNull(), changed[c]) if c in changed else F.col(c) for c in columns])
    leaves = docs.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("id"), leaf([F.col(c) for c in columns]).alias("digest"), F.when(flag, new).alias("changed"))
    leaves = staged(leaves, "merkle-hashes")  # the sampling of ranges reads digests instead of hashing the texts again
    # "null first, then bytewise" is Spark's own ascending order of strings
    placed = numbered(leaves, "grp", ["id", "digest"], "merkle-leaves")
    rounds, nodes, few = _tree(placed, ["id", "changed"], most)
    if few:
        paths, root = _top(nodes)
    else:  # every group has come to its subroot; the tree over the groups is one group
        subs = numbered(nodes.select(F.lit("").alias("one"), "grp", F.col("node").alias("digest")), "one", ["grp"], "merkle-groups")
        upper, last, _ = _tree(subs.select(F.col("one").alias("grp"), "pos", "total", "digest", F.col("grp").alias("lang")), ["lang"], most)
        over, root = _top(last)
        first = _with_path(upper[0], _down(upper, over, len(upper) == 1), len(upper) == 1)
        own = F.transform("rows", lambda r: F.struct(r["lang"].alias("grp"), r["digest"].alias("subroot"), F.concat(_inner_path((r["pos"] % FAN**LEVELS).cast("int")), F.col("rest")).alias("path")))
        paths = first.select(F.explode(own).alias("r")).select("r.grp", F.lit(0).cast("long").alias("block"), "r.subroot", "r.path")
    blocks = _with_path(rounds[0], _down(rounds, paths, few), few and len(rounds) == 1)
    size = FAN**LEVELS

    def proved(r: Column) -> Column:
        path = F.concat(_inner_path((r["pos"] % size).cast("int")), F.col("rest"))
        return F.struct(r["id"].alias("id"), r["digest"].alias("leaf"), r["changed"].alias("changed"), path.alias("path"))

    rows = blocks.select("subroot", F.explode(F.transform("rows", proved)).alias("r")).select("subroot", "r.*")
    folded = F.aggregate("path", F.coalesce("changed", "leaf"), lambda at, s: F.sha2(F.concat(s["l"], at, s["r"]), 256))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    out = rows.select(F.col("id").alias(id_col), "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
