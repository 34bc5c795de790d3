import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as fx
from graphloom.operators import chunking


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "slug"),
    [("Men's Team Pursuit", "mens_team_pursuit"), ("  São  Paulo–Stadium ", "sao_paulostadium"), ("Łódź ß Ø", "łodz_ß_ø"), ("a-b  c--d", "a_b_c_d"), ("__x__", "x"), ("", ""), ("²", "2")],
)
def test_slugs(spark, text, slug):
    assert one(spark, fx.slug(F.lit(text))) == slug


def test_normalized_and_ids(spark):
    assert one(spark, fx.normalized(F.lit(" The  Élan, of-it! "))) == "the e lan of-it" == fx.normalized_constant(" The  Élan, of-it! ")
    assert one(spark, fx.vertex_id("sport", F.lit("Ice Hockey"))) == "sport_ice_hockey"
    assert one(spark, fx.team_id(F.lit("ab"), F.lit("Q1"), F.lit("gold"))) == "team_Q1_gold"
    assert one(spark, fx.team_id(F.lit("x" * 101), F.lit("Q1"), F.lit("gold2"))) == "team_Q1_gold2"
    assert one(spark, fx.team_id(F.lit("Great Britain"), F.lit("Q1"), F.lit("gold"))) == "team_great_britain"
    assert one(spark, fx.country_id(F.lit("FRA"))) == "country_FRA"
    assert one(spark, fx.chunk_id(F.lit("Q7"), F.lit(3))) == "Q7#c0003"
    assert one(spark, fx.doc_of_chunk(F.lit("Q7#c0003"), F.lit(""))) == "Q7"


@pytest.mark.parametrize(("text", "n"), [("", 0), ("a", 1), ("abcd", 1), ("abcde", 2), ("é" * 9, 3)])
def test_token_estimate(spark, text, n):
    assert one(spark, fx.token_count(F.lit(text))) == n


def test_date_score(spark):
    score = lambda cue, text: one(spark, fx.date_score(F.lit(cue), F.lit(text)))
    assert score("3 august", "held on 3 august 1996") == 110
    assert score("3 august", "august the 3rd") == 10
    assert score("4 august", "in august") == 5
    assert score("", "x") == 0 and score("x", "") == 0


def test_prompts(spark):
    assert one(spark, fx.document_prompt(F.lit("body"), F.lit("  "), "task")) == "title: none | text: body"
    assert one(spark, fx.document_prompt(F.lit("body"))) == "search_document: body"
    assert one(spark, fx.query_prompt(F.lit("who"))) == "search_query: who"


PAGE = "\n\nTitle line\n\n[Infobox Olympic event]\n  event: x\n\nSection\n\nSub section\n\nProse with a dot.\nAnother | line.\n\n\nResults table\n1 | a | 2\n\na | b | c\n\na | b | c.\n\n- bullet\n\n12345\n\n-----\n\nshort"


def units_by_hand(text):
    """Blocks and kinds straight from the rules."""
    import re

    parts, blocks = re.split(r"(\n\n+)", text), []
    if parts[0] == "" and len(parts) > 1:
        parts = [parts[1] + parts[2], *parts[3:]]
    for i in range(0, len(parts), 2):
        block = "".join(parts[i : i + 2])
        if block:
            blocks.append(block)
    kinds = []
    for k, b in enumerate(blocks):
        lines = [x.strip() for x in b.split("\n") if x.strip()]
        piped = [x for x in lines if "|" in x]
        if b.strip().lower().startswith("[infobox"):
            kind = "infobox"
        elif lines and ((lines[0].lower().startswith("results table") and len(lines) > 1) or (len(lines) == 1 and lines[0].count("|") >= 2 and lines[0][-1] not in ".!?") or (len(lines) > 1 and len(piped) >= 2 and 2 * len(piped) >= len(lines))):
            kind = "table"
        elif k + 1 < len(blocks) and len(lines) == 1 and 2 <= len(lines[0]) <= 80 and "|" not in lines[0] and lines[0][0] not in "-*•" and not lines[0].isdigit() and lines[0][-1] not in ".!?:" and set(lines[0]) - set("-=_*"):
            kind = "heading"
        else:
            kind = "prose"
        kinds.append((b, kind))
    return kinds


@pytest.mark.parametrize("text", [PAGE, PAGE.strip(), "one block", "\n\n", "\n\n\nx", "x\n\n", "a\n\nb\n\nc", "", "Head\n\nHead two\n\nbody."])
def test_blocks_and_kinds(spark, text):
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    got = [(r.content, r.unit_type) for r in chunking.classify(chunking.blocks(docs)).orderBy("idx").collect()]
    assert got == (units_by_hand(text) if text else [])
    assert "".join(c for c, _ in got) == text
    units = chunking.semantic_units(docs).orderBy("unit").collect()
    assert "".join(u.content for u in units) == text
    assert all(units[i].source_end == units[i + 1].source_start for i in range(len(units) - 1))


def test_caption_marks_are_no_table_pipes(spark):
    docs = spark.createDataFrame([("d", "x |thumb|left|alt=a cap\n\na | b | c\n\ny")], "doc_id string, text string")
    assert [r.unit_type for r in chunking.classify(chunking.blocks(docs)).orderBy("idx").collect()] == ["prose", "table", "prose"]


def test_headings_join_the_next_unit(spark):
    docs = spark.createDataFrame([("d", "Head\n\nHead two\n\nbody.\n\nTail.")], "doc_id string, text string")
    units = chunking.semantic_units(docs).orderBy("unit").collect()
    assert [(u.content, u.unit_type) for u in units] == [("Head\n\nHead two\n\nbody.\n\n", "prose"), ("Tail.", "prose")]


@pytest.mark.parametrize("text", ["word " * 1200, "x" * 9000, ("line of words\n" * 400) + "y" * 4000 + " z\n" + "w " * 2000, "a\n\n" * 3000, "\n" * 5000, " " * 7000 + "end"])
def test_chunks_rebuild_the_text(spark, text):
    docs = spark.createDataFrame([("d", text), ("e", "small"), ("n", None), ("0", "")], "doc_id string, text string")
    chunks = chunking.chunk_documents(docs)
    rows = [r for r in chunks.orderBy("chunk_index").collect() if r.document_id == "d"]
    assert "".join(r.text for r in rows) == text and max(r.token_count for r in rows) <= 768
    assert chunking.validate_chunks(chunks, docs).count() == 0


def test_validation_finds_each_fault(spark):
    docs = spark.createDataFrame([("d", "hello world"), ("lost", "text")], "doc_id string, text string")
    schema = "document_id string, chunk_id string, chunk_index int, source_start int, source_end int, text string, token_count int"
    bad = spark.createDataFrame([("d", "d#c0000", 0, 0, 5, "hello", 2), ("d", "d#c0009", 1, 6, 11, "World", 9)], schema)
    rules = {r.rule for r in chunking.validate_chunks(bad, docs).collect()}
    assert rules == {"gap", "id", "count", "content", "lost"}


def test_packing_and_parameters(spark):
    assert chunking.pack([500, 300, 400, 768, 1], 768) == [0, 1, 1, 2, 3]
    with pytest.raises(ValueError):
        chunking.chunk_documents(spark.createDataFrame([], "doc_id string, text string"), target=0)


def test_rows_of_one_identifier_are_chunked_apart(spark):
    docs = spark.createDataFrame([("x", "aa\n\nbb"), ("x", "cc\n\ndd"), ("x", "cc\n\ndd"), (None, "ee")], "doc_id string, text string").repartition(3)
    assert sorted(r["text"] for r in chunking.chunk_documents(docs).collect()) == ["aa\n\nbb", "cc\n\ndd", "cc\n\ndd", "ee"]
