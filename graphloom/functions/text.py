"""Text functions: normalization, slugs, identifiers, token estimates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Characters a token, and tokens a chunk.
CHARS_PER_TOKEN, TARGET_TOKENS = 4, 768


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """NFKD, for which Spark has no function; plain ASCII values pass as they are."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x))


def _letters(c: Column) -> Column:
    """NFKD only where a value has other than ASCII characters, so ASCII columns stay in the JVM's plan result."""
    return nfkd(c)


def slug(c: Column, ascii_only: bool = False) -> Column:
    """Lower-case slug: letters, digits and underscores kept, runs of blanks and hyphens as one underscore."""
    kept = F.regexp_replace(c if ascii_only else _letters(c), r"[^\p{L}\p{N}_\s-]", "")
    return F.btrim(F.regexp_replace(F.lower(F.btrim(kept)), r"[-\s]+", "_"), F.lit("_"))


def normalized(c: Column, ascii_only: bool = False) -> Column:
    """Comparable form: other than letters, digits, blanks and hyphens become blanks; lower case; single blanks."""
    kept = F.regexp_replace(c if ascii_only else _letters(c), r"[^\p{L}\p{N}_\s-]", " ")
    return F.btrim(F.regexp_replace(F.lower(kept), r"\s+", " "))


def normalized_constant(text: str) -> str:
    """normalized() of one value, on the driver."""
    kept = "".join(c if c == "_" or c == "-" or c.isspace() or unicodedata.category(c)[0] in "LN" else " " for c in unicodedata.normalize("NFKD", text))
    return " ".join(kept.lower().split())


def vertex_id(kind: str, name: Column, ascii_only: bool = False) -> Column:
    """``sport_…``, ``venue_…``, ``person_…``, ``entity_…`` from a name's slug."""
    return F.concat(F.lit(f"{kind}_"), slug(name, ascii_only))


def country_id(noc: Column) -> Column:
    return F.concat(F.lit("country_"), noc)


def team_id(name: Column, doc_id: Column, medal: Column, ascii_only: bool = False) -> Column:
    """A slug of 3 to 100 characters names the team; otherwise document and medal do."""
    s = slug(name, ascii_only)
    return F.when(F.length(s).between(3, 100), F.concat(F.lit("team_"), s)).otherwise(F.concat(F.lit("team_"), doc_id, F.lit("_"), medal))


def token_count(c: Column) -> Column:
    """Estimated tokens: code points over four, rounded up; 0 for an empty text."""
    return F.ceil(F.length(c) / CHARS_PER_TOKEN).cast("int")


def date_score(cue: Column, text: Column) -> Column:
    """100 if the normalized cue stands in the text, plus 10 times the share of its tokens that do; 0 if either is blank."""
    tokens = F.split(cue, " ")
    share = F.size(F.filter(tokens, lambda t: text.contains(t))) / F.size(tokens)
    return F.when((F.coalesce(cue, F.lit("")) == "") | (F.coalesce(text, F.lit("")) == ""), F.lit(0.0)).otherwise(F.when(text.contains(cue), 100.0).otherwise(0.0) + F.lit(10.0) * share)


def constant_date_score(cue: str, text: Column) -> Column:
    """date_score() of one cue for all texts."""
    cue = normalized_constant(cue)
    if not cue:
        return F.lit(0.0)
    tokens = cue.split(" ")
    hits = sum((F.when(text.contains(t), 1).otherwise(0) for t in tokens), F.lit(0))
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(F.when(text.contains(cue), 100.0).otherwise(0.0) + F.lit(10.0) * hits / len(tokens))


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.format_string("%s#c%04d", doc_id, index)


def doc_of_chunk(chunk: Column, doc_id: Column | None = None) -> Column:
    """The document of a chunk: given, or the part before ``#``."""
    prefix = F.substring_index(chunk, "#", 1)
    return prefix if doc_id is None else F.coalesce(F.nullif(doc_id, F.lit("")), prefix)


def query_prompt(question: Column, style: str = "search") -> Column:
    """Model prompts for queries."""
    return F.concat(F.lit("search_query: " if style == "search" else "task: search result | query: "), question)


def document_prompt(text: Column, title: Column | None = None, style: str = "search") -> Column:
    """Model prompts for documents; a blank title is 'none'."""
    if style == "search":
        return F.concat(F.lit("search_document: "), text)
    return F.concat(F.lit("title: "), F.coalesce(F.nullif(F.btrim(title), F.lit("")), F.lit("none")), F.lit(" | text: "), text)
