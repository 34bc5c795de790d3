"""Structural chunking: text to blocks, semantic units, and chunks within a token target.

Blocks, classification and heading attachment are DataFrame expressions. Splitting and packing
are folds whose state resets, which no window expresses; they run in one Arrow pass with a document's units
in memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import CHARS_PER_TOKEN, TARGET_TOKENS, chunk_id, token_count

#: Image-caption marks that aren't table pipes.
CAPTION = r"\|(?:alt=[^|]*|left\b|right\b|thumb\b|upright\b|\d*x?\d*px\b)"


#: Documents that a worker holds as Python objects.
DOCS_AT_ONCE = 64


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, idx, content, source_start, source_end``: blank-line blocks with their delimiters, a leading one with the first block. Empty and null texts have none.

    ``row`` numbers the rows of ``docs``: rows that share an identifier are texts of their own.
    """
    text = F.col(text_col)
    parts = F.regexp_extract_all(text, F.lit(r"(?s)((?:^\n\n+)?.+?(?:\n\n+|$(?!\n)))"), F.lit(1))
    parts = F.when(text.rlike(r"^\n\n+$"), F.array(text)).otherwise(parts)
    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("row", F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("idx", "content")).where("content <> ''")
    end = F.sum(F.length("content")).over(Window.partitionBy("row").orderBy("idx"))
    return rows.withColumn("source_end", end).withColumn("source_start", F.col("source_end") - F.length("content"))


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), F.btrim), lambda x: x != "")


def _cleaned(c: Column) -> Column:
    return F.regexp_replace(c, "(?i)" + CAPTION, "")


def is_infobox(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+", "")).startswith("[infobox")


def is_table(c: Column) -> Column:
    """A results-table header with more lines; one line of two pipes that isn't a sentence; or pipes in two lines and in half of them."""
    lines = _lines(c)
    first = F.try_element_at(lines, F.lit(1))
    clean = _cleaned(first)
    single = (F.regexp_count(clean, F.lit(r"\|")) >= 2) & ~F.rtrim(clean).rlike(r"[.!?]$")
    piped = F.size(F.filter(lines, lambda x: F.contains(_cleaned(x), F.lit("|"))))
    many = (piped >= 2) & (piped / F.size(lines) >= 0.5)
    header = F.lower(first).startswith("results table") & (F.size(lines) > 1)
    return F.coalesce(F.when(header, F.lit(True)).when(F.size(lines) == 1, single).otherwise(many), F.lit(False))


def is_heading(c: Column, has_next: Column) -> Column:
    """One line of 2 to 80 characters that is no bullet, rule, number, table row or sentence, before another block."""
    lines = _lines(c)
    line = F.try_element_at(lines, F.lit(1))
    fits = (F.size(lines) == 1) & F.length(line).between(2, 80) & ~line.rlike(r"\||^[-*•]|^[-=_*]{3,}$|^[0-9]+$|[.!?:]$")
    return F.coalesce(has_next & fits, F.lit(False))


def classify(found: DataFrame) -> DataFrame:
    """Adds ``unit_type`` to blocks: infobox, table, heading or prose, the first that holds."""
    has_next = F.lead("idx").over(Window.partitionBy("row").orderBy("idx")).isNotNull()
    kind = F.when(is_infobox(F.col("content")), "infobox").when(is_table(F.col("content")), "table").when(is_heading(F.col("content"), F.col("_next")), "heading").otherwise("prose")
    return found.withColumn("_next", has_next).withColumn("unit_type", kind).drop("_next")


def attach_headings(units: DataFrame) -> DataFrame:
    """A run of headings joins the next unit and takes its type: ``row, doc_id, unit, unit_type, source_start, source_end, content``."""
    before = Window.partitionBy("row").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    island = F.coalesce(F.sum(F.when(F.col("unit_type") != "heading", 1).otherwise(0)).over(before), F.lit(0))
    pieces = F.array_sort(F.collect_list(F.struct("idx", "content", "unit_type")))
    grouped = units.withColumn("unit", island.cast("int")).groupBy("row", "unit").agg(F.first("doc_id").alias("doc_id"), pieces.alias("p"), F.min("source_start").alias("source_start"), F.max("source_end").alias("source_end"))
    return grouped.select("row", "doc_id", "unit", F.element_at("p.unit_type", -1).alias("unit_type"), "source_start", "source_end", F.array_join("p.content", "").alias("content"))


def semantic_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return attach_headings(classify(blocks(docs, id_col, text_col)))


def _split_keep(text: str, mark: str) -> list[str]:
    """Parts with the mark after each; they join to the text."""
    found, at = [], 0
    for m in re.finditer(mark, text):
        found.append(text[at : m.end()])
        at = m.end()
    return found + [text[at:]] * (at < len(text))


def _fill(pieces: list[str], most: int, deeper) -> Iterator[str]:
    """Greedy filling to ``most`` characters; a piece that is longer by itself is split by ``deeper``."""
    held, size = [], 0
    for p in pieces:
        if len(p) > most or size + len(p) > most:
            if held:
                yield "".join(held)
            held, size = [], 0
        if len(p) > most:
            yield from deeper(p)
        else:
            held.append(p)
            size += len(p)
    if held:
        yield "".join(held)


def split_unit(text: str, most: int) -> list[str]:
    """An oversized unit by lines, then words, then slices; the parts join to the text."""
    slices = lambda word: (word[k : k + most] for k in range(0, len(word), most))
    words = lambda line: _fill(_split_keep(line, r"\s+"), most, slices)
    return list(_fill(_split_keep(text, r"\n+"), most, words))


def pack(sizes: list[int], target: int) -> list[int]:
    """Chunk number of each unit: a unit that would exceed the target opens the next chunk."""
    found, chunk, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k and total + n > target:
            chunk, total = chunk + 1, 0
        total += n
        found.append(chunk)
    return found


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET_TOKENS) -> DataFrame:
    """``document_id, chunk_id, chunk_index, source_start, source_end, text, token_count, unit_types, oversized``; offsets are contiguous and half-open. Rows that share an identifier are chunked apart, with the same chunk ids."""
    if target <= 0:
        raise ValueError("the token target must be positive")
    units = semantic_units(docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")))
    listed = units.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("unit", "content", "unit_type"))).alias("u"))
    most = target * CHARS_PER_TOKEN

    def packed_rows(doc: str, found: list[dict]) -> list[list]:
        tokens = lambda t: -(-len(t) // CHARS_PER_TOKEN)
        parts, rows = [], []
        for unit in found:
            big = tokens(unit["content"]) > target
            parts += [(p, unit["unit_type"], big) for p in (split_unit(unit["content"], most) if big else [unit["content"]])]
        at, texts = 0, []
        for (text, kind, big), k in zip(parts, pack([tokens(p[0]) for p in parts], target), strict=True):
            if not rows or rows[-1][1] != k:
                rows.append([doc, k, at, at, [], [], False])
                texts = rows[-1][4]
            at += len(text)
            texts.append(text)
            rows[-1][3], rows[-1][6] = at, rows[-1][6] or big
            if kind not in rows[-1][5]:
                rows[-1][5].append(kind)
        return [(*r[:4], "".join(r[4]), ",".join(r[5]), r[6]) for r in rows]

    schema = pa.schema([("document_id", pa.string()), ("chunk_index", pa.int32()), ("source_start", pa.int32()), ("source_end", pa.int32()), ("text", pa.string()), ("unit_types", pa.string()), ("oversized", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # few documents at a time are Python objects, however many an Arrow batch holds
        for batch in batches:
            for k in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(k, DOCS_AT_ONCE)
                rows = [r for doc, u in zip(part.column("doc_id").to_pylist(), part.column("u").to_pylist(), strict=True) for r in packed_rows(doc, u)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    packed = listed.select("doc_id", "u").mapInArrow(run, "document_id string, chunk_index int, source_start int, source_end int, text string, unit_types string, oversized boolean")
    return packed.select("document_id", chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", "source_start", "source_end", "text", token_count(F.col("text")).alias("token_count"), "unit_types", "oversized")


def validate_chunks(chunks: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Violations ``document_id, chunk_index, rule``; none if all holds.

    Rules: index (contiguous from 0), id, start (first at 0), gap (starts where the one before ended), range (end after
    start), length (text as long as the range), count (tokens are the text's), content (text is the source's), end (last at the text's end), lost (a text without chunks).
    """
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    source = docs.select(F.col(id_col).cast("string").alias("document_id"), F.coalesce(text_col, F.lit("")).alias("source"))
    rows = (
        chunks.withColumns({"n": F.row_number().over(w), "before": F.lag("source_end").over(w), "after": F.lead("source_start").over(w)})
        .join(source, "document_id", "left")
    )
    rules = {
        "index": F.col("chunk_index") != F.col("n") - 1,
        "id": F.col("chunk_id") != chunk_id(F.col("document_id"), F.col("chunk_index")),
        "start": F.col("before").isNull() & (F.col("source_start") != 0),
        "gap": F.col("before").isNotNull() & (F.col("before") != F.col("source_start")),
        "range": F.col("source_end") <= F.col("source_start"),
        "length": F.length("text") != F.col("source_end") - F.col("source_start"),
        "count": F.col("token_count") != token_count(F.col("text")),
        "content": F.coalesce(F.substring(F.col("source"), F.col("source_start") + 1, F.col("source_end") - F.col("source_start")) != F.col("text"), F.lit(True)),
        "end": F.col("after").isNull() & F.coalesce(F.col("source_end") != F.length("source"), F.lit(True)),
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    found = rows.select("document_id", "chunk_index", F.explode(broken).alias("rule"))
    lost = source.where("source <> ''").join(chunks, "document_id", "left_anti").select("document_id", F.lit(None).cast("int").alias("chunk_index"), F.lit("lost").alias("rule"))
    return found.unionByName(lost)


def chunk_stats(chunks: DataFrame, target: int = TARGET_TOKENS) -> DataFrame:
    return chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.countDistinct("document_id").alias("documents"),
        F.count_if("oversized").alias("split_chunks"),
        F.count_if(F.col("oversized") & F.col("unit_types").contains("infobox")).alias("infobox_splits"),
        F.count_if(F.col("oversized") & F.col("unit_types").contains("table")).alias("table_splits"),
        F.count_if(F.col("token_count") > target).alias("over_target"),
        F.coalesce(F.max("token_count"), F.lit(0)).alias("most_tokens"),
        F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"),
    )
