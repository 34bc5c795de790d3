"""SimHash near-dedup with pigeonhole blocks.

Fingerprints are taken once a text and then only distinct ones are linked, so
groups of exact copies cost one row. Two fingerprints at distance k or less that are cut into
b > k blocks agree on b - k blocks at least, so every choice of b - k blocks is a join
key: pairs that share a key are verified by their Hamming distance. More
blocks make keys longer and buckets smaller; b is taken from the number of distinct
fingerprints, so that unrelated fingerprints seldom share a key at any size.

A bucket is a sorted run in one task, read as a stream. Its links are merged in a local union-find, so a
task sends a spanning forest of real links, flushed by size, never all pairs of a group. Large
buckets are searched by growing components: each step compares one member
with those not reached yet. The forests are then joined into components by
alternating large-star and small-star rounds on DataFrames, each round
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, free_names, row_keys, staged, staged_slim, text_or_empty

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle's UTF-8, as rows of 8 big-endian bytes."""
    tokens = text.encode().translate(LOWER).split()  # bytes.split() cuts at \x20 and \x09-\x0D only
    if not tokens:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(tokens)
    if len(tokens) < words:
        return np.frombuffer(xxhash.xxh64_digest(joined, 42), np.uint8).reshape(1, 8)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[:-1]))[: len(tokens) - words + 1].tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)]), np.uint8).reshape(-1, 8)


def fingerprint(text: str, words: int = 4) -> int:
    """Unsigned 64-bit SimHash; a bit is set if it is set in more than half the hashes; 0 for a text without words."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprint_of(rows: np.ndarray) -> int:
    if not len(rows):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 16384):
        ones += np.unpackbits(rows[at : at + 16384], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, carry: list[Column] | None = None) -> DataFrame:
    """``doc_id, fp`` of every row (fp: the 64 bits as a signed long), and the ``carry`` columns."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), *(carry or []), fp(text_or_empty(text_col)).alias("fp"))


def blocks_for(n: int, k: int) -> int:
    """Blocks so that a key has at least about log2(n) bits, or k + 4 blocks."""
    for b in range(k + 1, k + 5):
        if 64 * (b - k) / b >= np.log2(max(n, 2)) + 1:
            return b
    return k + 4


def bucket_keys(b: int, k: int) -> list:
    """Columns of the keys of ``fp``: for each choice of b - k blocks, their bits under the choice's number."""
    edges = [round(64 * i / b) for i in range(b + 1)]
    if b == 1:
        return [F.col("fp")]
    block = lambda i: F.shiftrightunsigned(F.col("fp"), edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    keys = []
    for number, chosen in enumerate(combinations(range(b), b - k)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(block(i))
        keys.append(key)
    return keys


class Forest:
    """Union-find that remembers the pairs that joined trees: a spanning forest of real links."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, a: int) -> int:
        up = self.up
        while (b := up.setdefault(a, a)) != a:
            up[a] = up[b]
            a = b
        return a

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))

    def take(self, most: int = 0) -> Iterator[pd.DataFrame]:
        """The links found since the last call, once there are ``most``; the forest is then forgotten, which may only repeat links."""
        if len(self.links) > most:
            yield pd.DataFrame(self.links, columns=["u", "v"], dtype="int64")
            self.up, self.links = {}, []


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def link_bucket(fp: np.ndarray, rep: np.ndarray, k: int, forest: Forest) -> None:
    """Join all members that links of at most k bits connect."""
    left = np.arange(len(fp))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = hamming(fp[left], fp[at]) <= k
            reached, left = left[near], left[~near]
            for x in reached:
                forest.join(int(rep[at]), int(rep[x]))
            todo += reached.tolist()


def link_buckets(k: int, small: int = 16, most_links: int = 100_000):
    """Rows sorted by key -> links ``u, v`` of at most k bits that span each bucket's components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, held = Forest(), []  # the open bucket's rows, joined once it ends
        for batch in batches:
            if not len(batch):
                continue
            rows = batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64), batch["rep"].to_numpy()
            cut = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
            if held and held[-1][0][-1] != rows[0][0]:
                cut = np.concatenate(([0], cut))
            if not len(cut):
                held.append(rows)
                continue
            key, fp, rep = (np.concatenate([*(h[c] for h in held), rows[c][: cut[-1]]]) for c in range(3))
            held = [tuple(r[cut[-1] :] for r in rows)]
            if len(key):
                _link_all(key, fp, rep, k, small, forest)
                yield from forest.take(most_links)
        if held:
            _link_all(*(np.concatenate([h[c] for h in held]) for c in range(3)), k, small, forest)
        yield from forest.take()

    return run


def _link_all(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, k: int, small: int, forest: Forest) -> None:
    starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
    _link_runs(fp, rep, starts, np.diff(np.append(starts, len(key))), k, small, forest)


def _link_runs(fp: np.ndarray, rep: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int, small: int, forest: Forest) -> None:
    for lag in range(1, small):
        at = starts[(sizes > lag) & (sizes <= small)]
        if not len(at):
            break
        size = sizes[(sizes > lag) & (sizes <= small)] - lag
        i = np.repeat(at, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        near = i[hamming(fp[i], fp[i + lag]) <= k]
        for a, b in zip(rep[near].tolist(), rep[near + lag].tolist(), strict=True):
            forest.join(a, b)
    for a, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        link_bucket(fp[a : a + n], rep[a : a + n], k, forest)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node that links reach) of all nodes that ``u, v`` rows name, but for the components' smallest.

    Large-star and small-star rounds until the links are stars: about the logarithm of a component's longest path.
    """
    edges = staged_slim(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while _unfinished(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        edges = staged_slim(small, "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or one smaller and one larger: links u > v that are stars have none."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return bool(ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").take(1))


def near_pairs(distinct: DataFrame, k: int) -> DataFrame:
    """Links ``u, v`` that span all components of fingerprints at most k bits apart; distinct: a row ``fp, rep`` for each fingerprint."""
    b = blocks_for(distinct.count(), k)
    keyed = distinct.select("fp", "rep", F.explode(F.array(*bucket_keys(b, k))).alias("key"))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInPandas(link_buckets(k), "u long, v long")


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, k: int = 4) -> DataFrame:
    """Fingerprint and component of every row: ``doc_id, fingerprint, component_id``.

    Null, empty and blank texts have fingerprint zero and are linked like others; whole texts of any length are read.
    Repeated rows and texts share a fingerprint and so a component. Fingerprints are linked whether their rows have
    identifiers or not; component_id is the smallest identifier of a component, null if it has none. Identifiers of any type and size pass
    unchanged. An empty table gives no rows. Other columns are not read, so clashing names don't matter.
    """
    found = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = staged_slim(found.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct-fingerprints")
    groups = components(near_pairs(distinct.select("fp", F.col("fp").alias("rep")), k))  # the fingerprints themselves are the nodes
    joined = distinct.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("part"))
    least = joined.groupBy("part").agg(F.min("id").alias("component_id"))
    named = joined.join(least, "part").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, k: int = 4) -> DataFrame:
    """One row, with its own columns, of each component of fingerprints at most k bits apart: the one with the smallest identifier.

    Of rows repeated with one identifier and text one stays. A row with a null identifier stays only where no
    row of its component has one. Column names may clash with those used here.
    """
    a, b = free_names(docs, 2)
    ids = row_keys(id_col, text_col, a, b)
    marked = docs.withColumns({a: ids[0], b: ids[1]})
    fps = fingerprints(docs, id_col, text_col, words, carry=ids)
    found = staged(fps, "fingerprints")
    groups = components(near_pairs(staged(found.groupBy("fp").agg(F.min("fp").alias("rep")), "distinct-fingerprints"), k))
    part = found.join(groups, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("component", "fp").alias("part"))
    kept = part.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", a, b)).alias("r")).select(f"r.{a}", f"r.{b}")
    return marked.join(kept, [a, b], "left_semi").dropDuplicates([a, b]).drop(a, b)
