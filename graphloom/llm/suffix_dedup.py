"""Exact substring dedup (400 bytes by default) by prefix-free parsing.

Parse. The trigger of a string start i is the position with the least rolling 8-gram hash
among the next ``window`` positions (the leftmost on ties). It depends on the bytes from i on only, so equal strings
have their triggers at equal offsets, and triggers are at most ``window`` apart. Consecutive starts
with one trigger form a phrase: starts lo..hi and trigger s. What stands before the trigger is a suffix of the
phrase, what follows it is a suffix of the parse, so a string that starts ``a`` bytes before a trigger is the phrase
suffix of ``a`` bytes and the first ``length - a`` bytes of the parse suffix.

Dictionary. Phrases whose parse suffix occurs once, as far as all their strings reach, cannot hold a repeated string and are
dropped; this is most of a corpus. Phrases with equal bytes and equal parse suffixes are one entry, and an
entry that occurs twice settles all its starts, so highly repetitive text costs one row a phrase.

Suffix arrays. The entries are brought into two orders by distributed sorts, ``length`` bytes deep: by parse suffix, then phrase
suffixes (the bytes before the trigger, read backwards); and by phrase suffixes, then parse suffix, within a right context.
Two entries with l bytes in common before their triggers and r bytes after them share the strings that start a bytes
before the trigger for all a with length - r <= a <= l. In an order, no entry shares more than a neighbour does: the first gives the
largest r of an entry, the second its largest l, so repeated starts lie in [length - r, l], and
the common parts of its neighbours settle most of these.

Corpus order. Starts between those that remain open (their best phrase suffix and their best parse suffix belong to different
neighbours) get a row each, with all starts of their right context that could equal them, and
are grouped by phrase suffix and parse suffix: the entries of one corpus position stand together.

Sorts and neighbours see rows, not groups: no group of equal contexts has to fit in a task. All shuffles
carry phrases, not bytes, except the two orders of open entries and one shuffle of the texts to meet their spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, row_keys, staged

GRAM = 8
MIX = np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio, odd
PIECE = 1 << 19  # starts of a long text that are parsed at once


def triggers(buf: np.ndarray, window: int) -> np.ndarray:
    """For each start, the trigger among its next ``window`` 8-grams; shorter than buf by window + 6."""
    n = len(buf) - GRAM + 1
    if n < window:
        return np.zeros(0, np.int64)
    gram = buf.astype(np.uint64)
    for step in (1, 2, 4):
        gram = (gram[:-step] << np.uint64(8 * step)) | gram[step:]
    least = ((gram * MIX) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: n - window + 1], least[window - size : n - size + 1])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def long_text_phrases(text: bytes, length: int, window: int, piece: int = PIECE) -> Iterator[tuple[int, int, int]]:
    """(lo, hi, s) of one text's phrases, parsed piece by piece."""
    starts, held = len(text) - length + 1, None
    for at in range(0, starts, piece):
        end = min(at + piece, starts)
        mine = triggers(np.frombuffer(text[at : end + window + GRAM - 2], np.uint8), window) + at
        cut = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        last = np.concatenate((cut[1:], [end - at])) - 1
        for lo, hi, s in zip((cut + at).tolist(), (last + at).tolist(), mine[cut].tolist(), strict=True):
            if held is not None and held[2] == s:  # a phrase that the piece cut
                held = held[0], hi, s
                continue
            if held is not None:
                yield held
            held = lo, hi, s
    if held is not None:
        yield held


def phrases(texts: list[bytes], length: int, window: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(text number, lo, hi, s, the text) of every phrase of texts of ``length`` bytes or more, about a MB at a time."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > PIECE:
            yield from ((at, lo, hi, s, texts[at]) for lo, hi, s in long_text_phrases(texts[at], length, window))
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and len(texts[end]) <= PIECE and (end == at or size + len(texts[end]) <= 2 * PIECE):
            size += len(texts[end])
            end += 1
        chosen = [k for k in range(at, end) if len(texts[k]) >= length]
        at = end
        if not chosen:
            continue
        joined = b"".join(texts[k] for k in chosen)
        sizes = np.array([len(texts[k]) for k in chosen])
        base = np.cumsum(sizes) - sizes
        trigger = triggers(np.frombuffer(joined, np.uint8), window)
        starts = np.concatenate([np.arange(b, b + n - length + 1) for b, n in zip(base.tolist(), sizes.tolist(), strict=True)])
        of = np.repeat(np.arange(len(chosen)), sizes - length + 1)
        mine = trigger[starts]
        cut = np.flatnonzero(np.concatenate(([True], (mine[1:] != mine[:-1]) | (of[1:] != of[:-1]))))
        last = np.concatenate((cut[1:], [len(starts)])) - 1
        owner = of[cut]
        for k, b, lo, hi, s in zip(owner.tolist(), base[owner].tolist(), starts[cut].tolist(), starts[last].tolist(), mine[cut].tolist(), strict=True):
            yield chosen[k], lo - b, hi - b, s - b, texts[chosen[k]]


#: n equal phrases that follow each other: lo, hi and s of the first, upto: hi of the last.
PHRASE = "doc long, mark long, lo int, hi int, s int, rh long, fh binary, n long, upto int"


def runs_of_equals(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Phrases of one text in order, with equal ones that follow each other (periodic text) as one row."""
    held = None
    for row in rows:
        if held is not None and row[:2] == held[:2] and row[5] == held[5] and row[6] == held[6]:
            held[7], held[8] = held[7] + 1, row[3]
            continue
        if held is not None:
            yield tuple(held)
        held = [*row, 1, row[3]]
    if held is not None:
        yield tuple(held)


def parse_texts(length: int, window: int):
    right = length - window + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            doc, mark, texts = batch["doc"].tolist(), batch["mark"].tolist(), batch["body"].tolist()
            found = ((doc[k], mark[k], lo, hi, s, signed(xxhash.xxh3_64_intdigest(t[s : s + right])), xxhash.xxh3_128_digest(t[lo : hi + length], s - lo)) for k, lo, hi, s, t in phrases(texts, length, window))
            found = runs_of_equals(found)
            while rows := list(islice(found, 20_000)):
                yield pd.DataFrame(rows, columns=["doc", "mark", "lo", "hi", "s", "rh", "fh", "n", "upto"])

    return run


def common_prefixes(texts: list[bytes], width: int) -> np.ndarray:
    """Bytes that each text shares with the next one, from the front."""
    sizes = np.array([len(t) for t in texts])
    grid = np.frombuffer(b"".join([t.ljust(width, b"\0") for t in texts]), np.uint8).reshape(len(texts), width)
    apart = grid[:-1] != grid[1:]
    first = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
    return np.minimum(first, np.minimum(sizes[:-1], sizes[1:]))


#: An entry and what an order says of it. ``far``: the most bytes it shares with a neighbour, on the side that the order sorts first (-1: none).
#: least..most: the starts that it shares with the neighbour before (1) and after (2). The bytes are kept of a partition's first and last entry only.
NEIGHBOURS = "doc long, mark long, lo int, s int, rh long, own boolean, tail int, far int, least1 int, most1 int, least2 int, most2 int, edge boolean, before binary, after binary"


def neighbours(length: int, by_parse: bool):
    """Sorted entries -> NEIGHBOURS. ``before`` holds an entry's bytes before the trigger, backwards, ``after`` those from it on."""

    def out(rows: pd.DataFrame, pair: tuple[np.ndarray, np.ndarray, np.ndarray], edge: np.ndarray) -> pd.DataFrame:
        far, least, most = pair  # of the pairs (entry before the first, first), ..., (last, entry after the last)
        found = rows[["doc", "mark", "lo", "s", "rh", "own"]].copy()
        found["tail"] = rows["after"].str.len()
        found["far"] = np.maximum(far[:-1], far[1:])
        found["least1"], found["most1"], found["least2"], found["most2"] = least[:-1], most[:-1], least[1:], most[1:]
        found["edge"] = edge
        for side in ("before", "after"):
            found[side] = rows[side].where(edge, None)
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ahead, fresh = None, (-1, 1, 0), True
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            # repeated rows of the source send an entry twice
            again = (rows["doc"].eq(rows["doc"].shift()) & rows["mark"].eq(rows["mark"].shift()) & rows["lo"].eq(rows["lo"].shift())).to_numpy()
            rows = rows[~again].reset_index(drop=True)
            if not len(rows):
                continue
            if len(rows) > 1:
                left, right, rh = common_prefixes(rows["before"].tolist(), length), common_prefixes(rows["after"].tolist(), length), rows["rh"].to_numpy()
                far = right if by_parse else np.where(rh[1:] == rh[:-1], left, -1)
                pairs = [np.concatenate(([a], b)) for a, b in zip(ahead, (far, length - right, left), strict=True)]
                edge = np.zeros(len(rows) - 1, bool)
                edge[0] = fresh
                yield out(rows.iloc[:-1], tuple(pairs), edge)
                ahead, fresh = tuple(int(p[-1]) for p in pairs), False
            held = rows.iloc[-1:].reset_index(drop=True)
        if held is not None:
            yield out(held, tuple(np.array([a, b]) for a, b in zip(ahead, (-1, 1, 0), strict=True)), np.ones(1, bool))

    return run


def in_order(entries: DataFrame, length: int, by_parse: bool) -> DataFrame:
    """What an order of all entries says of each: NEIGHBOURS rows, an entry at a partition's edge in several rows."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["after", "before", "doc", "mark", "lo"] if by_parse else ["rh", "before", "after", "doc", "mark", "lo"]
    columns = ["doc", "mark", "lo", "s", "rh", "own", "before", "after"]
    spark, key = entries.sparkSession, "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    usual = spark.conf.get(key, "100")
    spark.conf.set(key, "20")  # the driver sees this many rows a partition to place the ranges
    try:
        found = staged(entries.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*columns).mapInPandas(neighbours(length, by_parse), NEIGHBOURS), "order")
    finally:
        spark.conf.set(key, usual)
    # two rows a partition at most: their order shows the neighbours across partitions
    edges = found.where("edge").select(*columns).repartition(1).sortWithinPartitions(*order).mapInPandas(neighbours(length, by_parse), NEIGHBOURS)
    return found.unionByName(edges).drop("edge", "before", "after")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; spans that touch are one run."""
    found: list[list[int]] = []
    for a, b in sorted(spans):
        if found and a <= found[-1][1]:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def cut_text(body: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    rows = []
    for text, a, b in zip(body, starts, ends, strict=True):
        if text is None:
            rows.append((0, 0, "", ""))
            continue
        runs = merged(list(zip(a.tolist(), b.tolist(), strict=True)))
        digest, at = hashlib.sha256(), 0
        for first, last in runs:
            digest.update(text[at:first])
            at = last
        digest.update(text[at:])
        rows.append((sum(y - x for x, y in runs), len(runs), digest.hexdigest(), ",".join(f"{x}:{y}" for x, y in runs)))
    return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256", "spans"])


def open_entries(keyed: DataFrame, entries: DataFrame, length: int) -> DataFrame:
    """Entries of right contexts in which some entry occurs once, with their bytes: ``doc, mark, lo, s, rh, own, before, after``. own: the entry occurs once."""
    groups = staged(entries.groupBy("rh").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("fewest")).where("kinds > 1 AND fewest = 1").select("rh"), "open-contexts")
    named = entries.join(groups, "rh", "left_semi").select("rh", (F.col("n") == 1).alias("own"), "one.*")
    wanted = named.groupBy("doc", "mark").agg(F.collect_list(F.struct("rh", "own", "lo", "hi", "s")).alias("open"))  # at most a text's phrases
    left = F.decode(F.substring(F.col("body"), F.col("o.lo") + 1, F.col("o.s") - F.col("o.lo")), "ISO-8859-1")  # a character a byte
    found = keyed.join(wanted, ["doc", "mark"]).select("doc", "mark", "body", F.explode("open").alias("o"))
    return found.select("doc", "mark", "o.lo", "o.s", "o.rh", "o.own", F.encode(F.reverse(left), "ISO-8859-1").alias("before"), F.substring(F.col("body"), F.col("o.s") + 1, F.col("o.hi") + length - F.col("o.s")).alias("after"))


def open_starts(found: DataFrame, entries: DataFrame, length: int) -> DataFrame:
    """Spans of starts that the two orders leave open, by their place in corpus order: rows of equal phrase suffix and parse suffix meet."""
    gaps = found.where(F.col("own") & (F.size("gaps") > 0)).groupBy("rh").agg(F.min(F.array_min("gaps")).alias("from"), F.max(F.array_max("gaps")).alias("to"))
    rivals = found.where("low <= high").join(staged(gaps, "gaps"), "rh").select("doc", "mark", "lo", "s", "own", F.greatest("low", "from").alias("low"), F.least("high", "to").alias("high")).where("low <= high")
    rows = rivals.join(entries.select("doc", "mark", "lo", "before", "after").dropDuplicates(["doc", "mark", "lo"]), ["doc", "mark", "lo"])
    place: Column = F.unhex(F.md5(F.concat(F.substring("before", F.lit(1), F.col("a")), F.substring("after", F.lit(1), F.lit(length) - F.col("a")))))
    starts = rows.withColumn("a", F.explode(F.sequence("low", "high"))).select("doc", "mark", "own", (F.col("s") - F.col("a")).alias("start"), "a", place.alias("place"))
    starts = staged(starts, "corpus-order")
    twice = starts.groupBy("a", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "place")
    return starts.where("own").join(twice, ["a", "place"], "left_semi").select("doc", "mark", "start", (F.col("start") + length).alias("end"))


def repeated_spans(keyed: DataFrame, length: int, window: int) -> DataFrame:
    """``doc, mark, start, end`` of byte spans that repeated strings cover; keyed: rows doc, mark, body (binary)."""
    parsed = staged(keyed.select("doc", "mark", "body").mapInPandas(parse_texts(length, window), PHRASE), "phrases")
    # the keys are staged so that both sides of the join are plain exchanges, of which Spark splits hot partitions
    twice = staged(parsed.groupBy("rh").agg(F.sum("n").alias("n")).where("n > 1").select("rh"), "shared-contexts")
    shared = staged(parsed.join(twice, "rh", "left_semi"), "shared-phrases")
    entries = staged(shared.groupBy("rh", "fh").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "mark", "lo", "hi", "s")).alias("one")), "dictionary")
    settled = shared.join(entries.where("n > 1").select("rh", "fh"), ["rh", "fh"], "left_semi").select("doc", "mark", F.col("lo").alias("start"), (F.col("upto") + length).alias("end"))

    opened = staged(open_entries(keyed, entries, length), "open-entries")
    said = [in_order(opened, length, True).withColumns({"r": F.col("far"), "l": F.lit(-1)}), in_order(opened, length, False).withColumns({"r": F.lit(-1), "l": F.col("far")})]
    pairs = F.filter(F.flatten(F.collect_list(F.array(*(F.struct(F.col(f"least{k}").alias("least"), F.col(f"most{k}").alias("most")) for k in (1, 2))))), lambda p: p["least"] <= p["most"])
    found = said[0].unionByName(said[1]).groupBy("doc", "mark", "lo", "s", "rh", "own", "tail").agg(F.max("r").alias("r"), F.max("l").alias("l"), pairs.alias("pairs"))
    found = found.withColumns({"low": F.greatest(F.lit(length) - F.col("r"), F.lit(length) - F.col("tail")), "high": F.least("l", F.col("s") - F.col("lo"))})
    unsaid = F.filter(F.sequence("low", "high"), lambda a: ~F.exists("pairs", lambda p: a.between(p["least"], p["most"])))
    found = staged(found.withColumn("gaps", F.when(F.col("low") <= F.col("high"), unsaid).otherwise(F.array().cast("array<int>"))), "neighbours")
    shared_starts = found.where("own").select("doc", "mark", "s", F.explode("pairs").alias("p")).select("doc", "mark", (F.col("s") - F.col("p.most")).alias("start"), (F.col("s") - F.col("p.least") + length).alias("end"))
    return settled.unionByName(shared_starts).unionByName(open_starts(found, opened, length))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, window: int = 192) -> DataFrame:
    """What to remove from every row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``.

    A byte goes if a ``length``-byte string that covers it also starts anywhere else in the column, in
    the same text too: of tied copies none stays. Null texts are empty; texts under ``length`` bytes keep all. Rows are told apart by
    a 128-bit hash of identifier and text, so repeated identifiers are safe, and repeated rows count as copies of each
    other. Identifiers of any type pass unchanged, null ones too. Very long texts are parsed in pieces; a text has to fit
    in a task, with its spans. An empty table gives no rows. Other columns are not read, so clashing names don't matter.
    """
    if window < 2 or window + GRAM - 1 > length:
        raise ValueError("a window's grams must fit in the length")
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), *row_keys(id_col, text_col, "doc", "mark"), text.cast("binary").alias("body"))
    spans = repeated_spans(keyed, length, window)
    lists = spans.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "end")).alias("found"))  # at most a text's phrases, however often its row repeats
    rows = keyed.join(lists, ["doc", "mark"], "left").select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), F.when(F.col("found").isNotNull(), F.col("body")).alias("body"), F.when(F.col("found").isNull(), F.sha2("body", 256)).alias("sha"), "found")
    cut = rows.withColumn("cut", F.pandas_udf(cut_text, "n_removed long, n_spans long, kept_sha256 string, spans string")("body", F.col("found.start"), F.col("found.end")))
    return cut.select("doc_id", "n_bytes", "cut.n_removed", "cut.n_spans", F.coalesce("sha", "cut.kept_sha256").alias("kept_sha256"), "cut.spans")
