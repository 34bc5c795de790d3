"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of e edits is cut into e + 1 pieces: any text within e edits of it holds
one piece unchanged. An Aho-Corasick automaton finds all pieces of all items in
one pass over a document; each hit names a window where the item would have to stand, and Myers' bit-parallel
algorithm gives the least edit distance of the item to a part of that window. Items and
documents are compared in lower case with runs of other than letters and digits as one space.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import as_text, bounded_batches, free_names, row_keys, staged, text_or_empty

GAP = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    return GAP.sub(" ", text.lower()).strip()


def cut(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length with their offsets; fewer if the item is shorter than that."""
    n = min(budget + 1, len(item))
    edges = [len(item) * i // n for i in range(n + 1)] if n else []
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        found[c] |= 1 << i
    return dict(found)


def best_distance(pattern_masks: dict[str, int], m: int, text: str) -> int:
    """Least edit distance between a pattern of m characters and any part of the text (Myers 1999, one word of m bits)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = pattern_masks.get(c, 0)
        vertical = eq | down
        cross = (((eq & up) + up) ^ up) | eq
        rise, fall = (down | ~(cross | up)) & full, up & cross
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            best = min(best, score)
        rise, fall = rise << 1, fall << 1
        up, down = (fall | ~(vertical | rise)) & full, rise & vertical
    return best


class Items:
    """Benchmark items of one block, ready to be searched."""

    def __init__(self, items: list[tuple], rate: float):
        import ahocorasick

        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            words = plain(text or "")
            if words:
                norm, budget = f" {words} ", int(rate * len(words))  # the blanks keep words whole
                for offset, piece in cut(norm, budget):
                    pieces[piece].append((len(self.items), offset))
                self.items.append((item_id, norm, budget, masks(norm)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if self.items:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple]:
        """(distance, item) of all items that stand in the normal form of a text within their budgets."""
        if not self.items or not text:
            return []
        text = f" {text} "
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                starts[k].add(end + 1 - size - offset)
        found = []
        for k, where in starts.items():
            item_id, norm, budget, bits = self.items[k]
            if norm in text:
                found.append((0, item_id))
                continue
            best, reach = budget + 1, -1
            spans: list[list[int]] = []
            for a in sorted(where):  # windows that overlap are searched as one
                lo, hi = max(0, a - budget), min(len(text), a + len(norm) + budget)
                if lo <= reach:
                    spans[-1][1] = reach = max(reach, hi)
                else:
                    spans.append([lo, hi])
                    reach = hi
            for lo, hi in spans:
                best = min(best, best_distance(bits, len(norm), text[lo:hi]))
            if best <= budget:
                found.append((best, item_id))
        return found


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of about ``block_chars`` characters, one at a time on the driver: the stated query set. Items: (identifier as text, text)."""
    rows = benchmark.select(as_text(id_col).alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield [(r["item"], r["text"]) for r in part.collect()]


HITS = "array<struct<distance:int,item:string>>"


def searcher(items: list[tuple], rate: float):
    """A column function: text -> the items of one block that stand in it, with their distances."""

    @F.pandas_udf(HITS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Items(items, rate)
        for texts in batches:
            yield pd.Series([[{"distance": d, "item": i} for d, i in index.search(plain(t))] for t in texts])

    return found


def with_hits(docs: DataFrame, benchmark: DataFrame, hits: str, text_col: str, item_col: str, item_text_col: str, rate: float, block_chars: int) -> DataFrame:
    """``docs`` with the array column ``hits`` of all items found. Own columns stay in the JVM.

    A benchmark of one block is searched in one pass. Of a larger one, each block is searched and its hits are written before the next
    block is read, so the driver and the workers hold one block at a time; the hits of a row meet by its text.
    """
    bounded_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    blocks = blocks_of(benchmark, item_col, item_text_col, block_chars)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.withColumn(hits, searcher(first, rate)(text))
    keys = row_keys(text_col, text_col, "a", "b")  # of the text alone
    parts = []
    for items in chain([first, second], blocks):
        found = docs.select(*keys, searcher(items, rate)(text).alias("h")).where(F.size("h") > 0).dropDuplicates(["a", "b"])
        parts.append(staged(found, "block-hits"))
    merged = reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(F.flatten(F.collect_list("h")).alias(hits))  # at most the items of the benchmark
    a, b = free_names(docs, 2)
    rows = docs.withColumns({a: keys[0], b: keys[1]}).join(merged.select(F.col("a").alias(a), F.col("b").alias(b), hits), [a, b], "left").drop(a, b)
    return rows.withColumn(hits, F.coalesce(hits, F.array().cast(HITS)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.06, block_chars: int = 4_000_000) -> DataFrame:
    """Which rows hold benchmark items: ``doc_id, n_items, item_id, distance, contaminated``.

    ``item_id`` is the item with the least distance, then the least id; both are null without a hit. An item stands in a text as whole words, give or
    take its budget: ``rate`` times its normal form's characters, so short items have to match exactly. Null and empty
    documents or items match nothing. Whole texts of any length are searched. Repeated rows are judged alone; repeated items count once, and a null item id
    is an id of its own that sorts first. Identifiers of any type and size pass as they are. Empty tables give no rows or no hits. Other columns are not read, so clashing names don't matter.
    """
    rows = with_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, "hits", "text", item_col, item_text_col, rate, block_chars)
    kind = benchmark.schema[item_col].dataType
    best = F.array_min(F.transform("hits", lambda h: F.struct(h["distance"].cast("long").alias("distance"), h["item"].cast(kind).alias("item"))))
    rows = rows.select("doc_id", F.size("hits").cast("long").alias("n_items"), best.alias("best"))
    return rows.select("doc_id", "n_items", F.col("best.item").alias("item_id"), "best.distance", (F.col("n_items") > 0).alias("contaminated"))


def keep_free(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.06, block_chars: int = 4_000_000) -> DataFrame:
    """The rows without a benchmark item, with their own columns, whatever their names; rows, texts and items are treated as by ``decontaminate``."""
    hits = free_names(docs, 3)[2]
    return with_hits(docs, benchmark, hits, text_col, item_col, item_text_col, rate, block_chars).where(F.size(hits) == 0).drop(hits)
