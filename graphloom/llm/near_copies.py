"""SimHash near-dedup verified and completed: every pair of texts whose word shingles have Jaccard similarity of 4/5 or more.

Candidates come from two sides. SimHash fingerprints give pairs by pigeonhole blocks (``simhash.near_pairs``), which joins
most copies at once. But at similarity 0.8 two 64-bit fingerprints differ by ten bits on average and now and then by
twenty, and no radius that blocks can search covers those, so a prefix join completes them: sets of n and m shingles that
similar share ceil(4n/5) of the n at least, so, in any order of all shingles, their first
n - ceil(4n/5) + 1 and m - ceil(4m/5) + 1 share one. Those prefixes are the keys of runs. The order only
decides the cost: shingles that a bounded sample shows to be common come last.

Runs are sorted streams. Small ones give all pairs that sizes and positions allow. Large ones give a star around a member that a hash of key and
member picks, so the runs of a group try many centres; runs of shingles that the sample shows to be hot are salted, and their centres meet.
Parity sketches rule out most candidates (never a right one); of the others the closest of each text is verified first, and then those that
still lie between components. Last, the large runs whose members are not yet one component are compared
exhaustively in cells of bounded size. So a group of copies costs what its rows cost, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, free_names, row_keys, staged, staged_slim, text_or_empty
from .simhash import components, fingerprint_of, near_pairs, shingle_hashes

#: The least similarity as a fraction, documents sampled for the order, and common shingles kept of them.
NUM, DEN = 4, 5
SAMPLED, COMMON = 8_000, 200_000
#: The largest run whose pairs are all tried at once, members of a cell, salts of a hot key and the share of sampled texts that makes one.
SMALL, CELL, SALTS, HOT = 16, 2_048, 32, 1 / 100


def shingle_set(text: str, words: int) -> np.ndarray:
    """Distinct shingle hashes as sorted signed longs; none for a text without words."""
    return set_of(shingle_hashes(text, words))


def set_of(hashes: np.ndarray) -> np.ndarray:
    return np.unique(np.ascontiguousarray(hashes).view(">i8").ravel().astype(np.int64))


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of which a set this similar shares one, their sampled counts); a set without shingles has the key 0."""
    n = len(shingles)
    if not n:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    most = n + 1 + (-NUM * n) // DEN
    if not len(common):
        return shingles[:most], np.zeros(most, np.int64)
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    seen = np.where(common[at] == shingles, counts[at], 0)
    order = np.argsort(seen, kind="stable")[:most]
    return shingles[order], seen[order]


def text_node(text_col: str = "text") -> Column:
    return F.xxhash64(text_or_empty(text_col))


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes and sampled counts of common shingles, and the number of texts sampled."""
    every = max(1, texts.count() // SAMPLED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch["text"]:
                yield pd.DataFrame({"shingle": shingle_set(t, words)})

    sample = texts.where(F.pmod("node", F.lit(every)) == 0).dropDuplicates(["node"]).select("text")
    rows = sample.mapInPandas(run, "shingle long")
    top = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(COMMON).toPandas().sort_values("shingle")
    return top["shingle"].to_numpy(np.int64), top["n"].to_numpy(np.int64), sample.count()


#: What the join needs of a text: its number of shingles, fingerprint, parity sketch, and the prefix with a salt for each key (0: not hot).
TEXT = "node long, n int, fp long, sketch array<long>, keys array<long>, salts array<int>"


def read_texts(words: int, common: np.ndarray, counts: np.ndarray, hot: float, most: int = 50_000):
    """Texts -> TEXT, one pass over each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            rows, held = [], 0
            for node, t in zip(batch["node"].tolist(), batch["text"], strict=True):
                if node in seen:
                    continue
                if len(seen) >= 1_000_000:  # repeated texts only cost rows
                    seen.clear()
                seen.add(node)
                hashes = shingle_hashes(t, words)
                s = set_of(hashes)
                keys, often = prefix(s, common, counts)
                rows.append((node, len(s), int(np.uint64(fingerprint_of(hashes)).view(np.int64)), sketch(s), keys, np.where(often >= hot, 1 + (node & (SALTS - 1)), 0)))
                held += len(keys)
                if held >= most:
                    yield pd.DataFrame(rows, columns=["node", "n", "fp", "sketch", "keys", "salts"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["node", "n", "fp", "sketch", "keys", "salts"])

    return run


def possible(n: np.ndarray, pos: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles whose first common one stands at these positions can be similar enough."""
    return sizes_fit(n, m) & ((DEN + NUM) * np.minimum(n - pos, m - at) >= NUM * (n + m))


def sizes_fit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)


#: v set: a candidate pair. v null: u is a member of a large run under ``key``; ``centre`` marks a salt's centre.
CANDIDATE = "u long, v long, key long, n int, pos int, centre boolean"


def pairs_frame(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    found = np.unique(np.sort(np.stack([u, v], axis=1), axis=1), axis=0)
    return pd.DataFrame({"u": found[:, 0], "v": pd.array(found[:, 1], "Int64"), "key": 0, "n": 0, "pos": 0, "centre": False})


def members_frame(rows: dict[str, np.ndarray], at: np.ndarray, centre: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"u": rows["node"][at], "v": pd.array([None] * len(at), "Int64"), "key": rows["key"][at], "n": rows["n"][at], "pos": rows["pos"][at], "centre": centre})


def candidates(small: int):
    """Rows sorted by key, salt and pick -> CANDIDATE. Holds a small run or a large run's centre, never a large run."""
    columns = ["key", "salt", "node", "n", "pos"]

    def deal(rows: dict[str, np.ndarray], starts: np.ndarray, sizes: np.ndarray, goes_on: bool) -> Iterator[pd.DataFrame]:
        """goes_on: the first run continues a large one, whose centre is repeated as the first row."""
        node, n, pos = rows["node"], rows["n"], rows["pos"]
        big = (sizes > small) | (rows["salt"][starts] > 0)
        if goes_on:
            big[0] = True
        u, v = [], []
        for lag in range(1, small):
            those = (sizes > lag) & ~big
            if not those.any():
                break
            size = sizes[those] - lag
            i = np.repeat(starts[those], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            i = i[possible(n[i], pos[i], n[i + lag], pos[i + lag])]
            u.append(node[i]), v.append(node[i + lag])
        if big.any():
            at = np.concatenate([np.arange(a, a + s) for a, s in zip(starts[big].tolist(), sizes[big].tolist(), strict=True)])
            centre = np.repeat(starts[big], sizes[big])
            if goes_on:
                at, centre = at[1:], centre[1:]
            yield members_frame(rows, at, (at == centre) & (rows["salt"][at] > 0))
            near = (at != centre) & sizes_fit(n[at], n[centre])
            u.append(node[at[near]]), v.append(node[centre[near]])
        if u and sum(map(len, u)):
            yield pairs_frame(np.concatenate(u), np.concatenate(v))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, goes_on, last = None, False, None
        for batch in batches:
            if not len(batch):
                continue
            rows = {c: batch[c].to_numpy(np.int64) for c in columns}
            same = lambda c: np.concatenate(([last is not None and last[c] == rows[c][0]], rows[c][1:] == rows[c][:-1]))  # noqa: B023, E731
            fresh = ~(same("key") & same("salt") & same("node"))  # a text that several tasks saw
            last = {c: rows[c][-1] for c in columns}
            rows = {c: rows[c][fresh] for c in columns}
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in columns}
            if not len(rows["key"]):
                continue
            cut = np.flatnonzero((rows["key"][1:] != rows["key"][:-1]) | (rows["salt"][1:] != rows["salt"][:-1])) + 1
            starts = np.concatenate(([0], cut))
            sizes = np.diff(np.append(starts, len(rows["key"])))
            if sizes[-1] > small or rows["salt"][-1] > 0:  # the open run is large already
                yield from deal(rows, starts, sizes, goes_on)
                goes_on, held = True, {c: rows[c][starts[-1] : starts[-1] + 1] for c in columns}
            else:
                if len(starts) > 1:
                    yield from deal(rows, starts[:-1], sizes[:-1], goes_on)
                    goes_on = False
                held = {c: rows[c][starts[-1] :] for c in columns}
        if held is not None and len(held["key"]):
            yield from deal(held, np.array([0]), np.array([len(held["key"])]), goes_on)

    return run


def runs(take: Callable[[pd.DataFrame, np.ndarray], Iterator[pd.DataFrame]]):
    """Deal a stream sorted by key to ``take(rows, starts)`` in pieces that hold whole runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            key = batch["key"].to_numpy()
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            if held and held[-1]["key"].iloc[-1] != key[0]:
                cut = np.concatenate(([0], cut))
            if not len(cut):
                held.append(batch)
                continue
            whole = pd.concat([*held, batch.iloc[: cut[-1]]], ignore_index=True)
            held = [batch.iloc[cut[-1] :]]
            yield from take(whole, starts_of(whole))
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield from take(whole, starts_of(whole))

    return run


def starts_of(rows: pd.DataFrame) -> np.ndarray:
    key = rows["key"].to_numpy()
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1)) if len(key) else np.zeros(0, np.int64)


def crossing(rows: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
    """Pairs ``u, v`` of a cell's members in different components whose sketches allow it. In a cell of two parts of a run only pairs between the parts count."""
    node, n, pos, part, own = (rows[c].to_numpy(np.int64) for c in ("node", "n", "pos", "part", "own"))
    sketches = [np.asarray(x, np.int64) for x in rows["sketch"]]
    for a, z in zip(starts.tolist(), np.append(starts[1:], len(node)).tolist(), strict=True):
        one = a + np.unique(node[a:z], return_index=True)[1]
        if (part[one] == part[one[0]]).all():
            continue
        both, found = len(np.unique(own[one])) > 1, []
        least = min(len(sketches[i]) for i in one)
        bits = np.stack([folded(sketches[i], least) for i in one]).view(np.uint64)
        for k in range(len(one) - 1):
            i, j = one[k], one[k + 1 :]
            good = (part[j] != part[i]) & possible(n[i], pos[i], n[j], pos[j]) & ((own[j] != own[i]) | (not both))
            j, other = j[good], bits[k + 1 :][good]
            j = j[(DEN + NUM) * np.bitwise_count(other ^ bits[k]).sum(axis=1, dtype=np.int64) <= (DEN - NUM) * (n[i] + n[j])]
            found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1))
        found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        if len(found):
            yield pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})


def sketch(shingles: np.ndarray, least: int = 1024) -> np.ndarray:
    """Parities of the hashes' low bits: sketches differ in no more bits than the sets differ in shingles. As many bits as shingles, in a power of two."""
    bits = max(least, 1 << int(len(shingles) - 1).bit_length()) if len(shingles) else least
    return np.packbits(np.bincount(shingles & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The sketch that fewer bits would have given: halves are added."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def halved(a: Column, b: Column) -> Column:
    """folded() of a to the size of b, for sets whose sizes fit: one halving at most."""
    half = (F.size(a) / 2).cast("int")
    return F.when(F.size(a) > F.size(b), F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(a)


def sets_of(texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``node, n, shingles`` of the named nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200].drop_duplicates("node")
                part = part[~part["node"].isin(seen)]
                if not len(part):
                    continue
                seen.update(part["node"].tolist())
                sets = [shingle_set(t, words) for t in part["text"]]
                yield pd.DataFrame({"node": part["node"], "n": [len(x) for x in sets], "shingles": sets})

    return texts.join(nodes, "node", "left_semi").mapInPandas(run, "node long, n long, shingles array<long>")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()


def with_sets(pairs: DataFrame, sets: DataFrame, what: str) -> DataFrame:
    side = lambda c, s, n: sets.select(F.col("node").alias(c), F.col(what).alias(s), F.col("n").alias(n))
    return pairs.join(side("u", "a", "na"), "u").join(side("v", "b", "nb"), "v")


def allowed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that their sketches don't rule out, with the bits ``apart``."""
    apart = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    both = with_sets(pairs, sets, "sketch").where(DEN * F.least("na", "nb") >= NUM * F.greatest("na", "nb")).withColumns({"a": halved(F.col("a"), F.col("b")), "b": halved(F.col("b"), F.col("a"))})
    return both.withColumn("apart", apart).where((DEN + NUM) * F.col("apart") <= (DEN - NUM) * (F.col("na") + F.col("nb"))).select("u", "v", "apart")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets are similar enough. A text that several tasks read may stand in several rows of sets, which only repeats links."""
    return with_sets(pairs, sets, "shingles").where((DEN + NUM) * F.size(F.array_intersect("a", "b")) >= NUM * (F.col("na") + F.col("nb"))).select("u", "v")


def between(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    side = lambda c, p: groups.select(F.col("node").alias(c), F.col("component").alias(p))
    both = pairs.join(side("u", "p"), "u", "left").join(side("v", "q"), "v", "left")
    return both.where(F.coalesce("p", "u") != F.coalesce("q", "v")).drop("p", "q")


def settle(pairs: DataFrame, sets: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Components once all pairs ``u, v, apart`` are verified or implied: each text's closest pairs first, then those still between components. groups: the components so far."""
    ways = pairs.select("u", "v", "apart").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "apart"))
    first = ways.groupBy("u").agg(F.min(F.struct("apart", "v")).alias("best")).select(F.least("u", "best.v").alias("u"), F.greatest("u", "best.v").alias("v")).distinct()
    known = lambda links: links if groups is None else links.union(groups.select(F.col("node").alias("u"), F.col("component").alias("v")))
    groups = components(known(verified(first, sets)))
    left = staged_slim(between(pairs.join(first, ["u", "v"], "left_anti"), groups).select("u", "v"), "left-pairs")
    return components(known(verified(left, sets))) if left.take(1) else groups


def near_links(docs: DataFrame, text_col: str = "text", words: int = 5, k: int = 4) -> DataFrame:
    """``node, component`` of all texts in groups but for the groups' smallest node; a node is the hash of a text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(text_node(text_col).alias("node"), text_or_empty(text_col).alias("text"))
    common, counts, sampled = common_shingles(texts, words)
    read = staged(texts.mapInPandas(read_texts(words, common, counts, max(2.0, HOT * sampled)), TEXT), "near-texts")
    sketches = read.select("node", "n", "sketch")

    distinct = staged_slim(read.groupBy("fp").agg(F.min("node").alias("rep")), "distinct-fingerprints")
    equal = read.select("fp", "node").join(distinct, "fp").where("node <> rep").select(F.least("node", "rep").alias("u"), F.greatest("node", "rep").alias("v"))

    keys = read.select("node", "n", F.posexplode(F.arrays_zip("keys", "salts")).alias("pos", "k")).select(F.col("k.keys").alias("key"), F.col("k.salts").alias("salt"), "node", "n", "pos")
    order = keys.repartition(parts, "key", "salt").withColumn("pick", F.xxhash64("key", "node")).sortWithinPartitions("key", "salt", "pick", "node")
    found = staged(order.select("key", "salt", "node", "n", "pos").mapInPandas(candidates(SMALL), CANDIDATE), "candidates")
    members = found.where("v IS NULL").select(F.col("u").alias("node"), "key", "n", "pos")
    centres = found.where("centre")  # a row for each salt of a hot key
    hub = centres.groupBy("key").agg(F.min("u").alias("hub"))
    hubs = centres.join(hub, "key").where("u <> hub").select(F.least("u", "hub").alias("u"), F.greatest("u", "hub").alias("v"))

    pairs = staged_slim(found.where("v IS NOT NULL").select("u", "v").union(near_pairs(distinct, k)).union(equal).union(hubs).distinct(), "pairs")
    near = staged_slim(allowed(pairs, sketches).distinct(), "allowed")
    groups = settle(near, staged(sets_of(texts, ends(near), words), "shingle-sets"), None)

    members = staged(members.join(groups, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"), "members")
    split = members.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count(F.lit(1)).alias("size")).where("a <> b")
    split = staged_slim(split.select("key", F.ceil(F.col("size") / CELL).cast("int").alias("cells")), "split-runs")
    if not split.take(1):
        return groups
    own = F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")
    cells = members.join(split, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cells = cells.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "n", "pos", "part", "own")
    cells = cells.join(sketches.select("node", "sketch").dropDuplicates(["node"]), "node")
    rest = cells.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(runs(crossing), "u long, v long").distinct().join(pairs, ["u", "v"], "left_anti")
    rest = staged_slim(allowed(staged_slim(rest, "crossing"), sketches).distinct(), "allowed")
    return settle(rest, staged(sets_of(texts, ends(rest), words), "shingle-sets"), groups) if rest.take(1) else groups


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, k: int = 4) -> DataFrame:
    """One row, with its own columns, of each group of near copies that links connect: the one with the smallest identifier.

    Texts without words, null ones too, are copies of each other. A text of fewer words than a shingle is one
    shingle. Repeated rows stay once. A row with a null identifier stays only where its group has no other. Identifiers of
    any type are compared as they are. Whole texts of any length are read. An empty table gives no rows; columns of any name pass.
    Texts are told apart by 64 bits of hash: among 10^10 different texts about three pairs would be taken for equal.
    """
    a, b = free_names(docs, 2)
    ids = row_keys(id_col, text_col, a, b)
    rows = docs.select(F.col(id_col).alias("id"), ids[0].alias("a"), ids[1].alias("b"), text_node(text_col).alias("node"))
    group = rows.join(near_links(docs, text_col, words, k), "node", "left").groupBy(F.coalesce("component", "node").alias("part"))
    kept = group.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "a", "b")).alias("r")).select(F.col("r.a").alias(a), F.col("r.b").alias(b))
    return docs.withColumns({a: ids[0], b: ids[1]}).join(kept, [a, b], "left_semi").dropDuplicates([a, b]).drop(a, b)
