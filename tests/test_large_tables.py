"""Steps that must grow no faster than their tables, and what they must still return."""

from graphloom.operators import extraction, tools
from graphloom.plans import queries
from graphloom.sources import corpus

SF = "/root/testdata/sf0.001"
EDGE = "src_type string, src_id string, edge_type string, dst_type string, dst_id string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_edges_are_those_of_the_sql_and_no_ids_are_made_distinct(spark, tmp_path):
    for name in corpus.TABLES:
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        odd = t.limit(40).unionByName(t.limit(40))  # repeated rows
        odd = odd.unionByName(t.limit(1).select(*(t[c].cast(t.schema[c].dataType) if c in ("l_linenumber",) else (t[c] * None if c.endswith(("orderkey", "partkey")) else t[c]).cast(t.schema[c].dataType).alias(c) for c in t.columns)))
        odd.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    for d in (SF, str(tmp_path)):
        assert rows(corpus.edges(spark, d)) == rows(corpus._run(spark, d, corpus.GRAPH_SQL))
    assert "keys=[src_type" not in plan(corpus.edges(spark, SF))


def test_event_context_reads_the_edges_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(queries, "stored_edges", lambda *_: 1 / 0)  # the whole adjacency, sorted by both ends
    few = rows(queries.event_context(spark, SF))
    monkeypatch.setattr(tools, "FEW_EVENTS", 0)
    assert rows(queries.event_context(spark, SF)) == few and len(few) == 1500


def test_countries_are_counted_without_copies_of_the_rows(spark):
    edges = spark.createDataFrame([("Person", f"p{i}", "REPRESENTS", "Country", f"c{i % 3}") for i in range(6)] + [("Person", "p0", "REPRESENTS", "Country", "c9")], EDGE)
    vertices = spark.createDataFrame([("Country", "c1", "One", 0, ""), ("Country", "c9", "", 0, "")], "v_type string, v_id string, name string, year int, description string")
    parts = spark.createDataFrame([(1, None, "p0"), (1, "Person", "p0"), (1, "Person", "p1"), (1, "Person", "p5"), (2, "Person", None), (2, "Team", "p0"), (3, "Person", "none")], "run int, v_type string, v_id string")
    found = tools.aggregate_countries(parts, vertices, edges, ["run"], bound=2)
    assert rows(found) == rows(spark.createDataFrame([(1, 2, 3, ["c0", "c1", "c9"], ["c0", "One", "c9"]), (2, 1, 0, [], []), (3, 1, 0, [], [])], found.schema))
    assert "Expand" not in plan(found)


def test_gold_is_made_of_ranked_rows_only(spark, monkeypatch):
    seen, plain = [], queries.evaluation.first_gold_rank
    monkeypatch.setattr(queries.evaluation, "first_gold_rank", lambda asked, ranked, gold: seen.append((gold.count(), ranked.count())) or plain(asked, ranked, gold))
    assert queries.first_gold_ranks(spark, SF).count() == 5
    assert seen[0][0] <= seen[0][1]


def test_ends_of_edges_meet_the_vertices_once(spark):
    vertices = spark.createDataFrame([("Event", "e1"), ("Event", "e1"), ("Person", "p1"), ("Person", "")], "v_type string, v_id string")
    edges = spark.createDataFrame([("Person", "p1", "IN", "Event", "e1"), ("Person", "p2", "IN", "Event", "e1"), ("Person", "p2", "IN", "Event", "e1"), ("Person", "p1", "AT", "Venue", "v1"), ("Person", "", "IN", "Event", None)], EDGE)
    found = extraction.integrity_errors(vertices, edges)
    assert plan(found).count("LeftAnti") == 2  # one of them by types
    want = [("missing_source", "IN", "p2")] * 2 + [("missing_target", "AT", "v1"), ("missing_target", "IN", None), ("unknown_type", "AT", "v1"), ("empty_id", "IN", "")]
    assert rows(found) == sorted(map(str, want))


def test_composite_reads_attributes_of_what_is_left(spark, monkeypatch):
    for name in ("events_for_participants", "events_for_venues"):
        monkeypatch.setattr(tools, name, lambda *_, **__: 1 / 0)
    assert queries.composite_countries(spark, SF).count() <= 1


def test_sports_are_those_of_all_surfaces(spark):
    docs = corpus.corpus(spark, SF)
    odd = spark.createDataFrame([("x", None, "[Infobox Olympic event]\n a: b"), ("y", "Judo at the 1996 Summer Olympics – X", None), ("z", "Judo at the 1996 Summer Olympics – X", "no box: 1")], "doc_id string, title string, text string")
    for d in (docs, odd):
        whole = extraction.document_surfaces(d, ascii_only=True).where("entity_type = 'Sport'")
        assert rows(extraction.sport_surfaces(d, ascii_only=True).select(*whole.columns)) == rows(whole)


def test_normalized_facts_are_not_shuffled(spark):
    from graphloom.operators import evidence

    asked = spark.createDataFrame([("r", "in 1996?", "Ann Lee"), ("s", "?", ""), ("t", "", "x")], "run string, question string, answer string")
    facts = spark.createDataFrame([("r", "e1", "ANN, LEE (1996)"), ("r", "e2", None), ("s", "e1", None)], "run string, evidence_id string, fact string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = evidence.verify(asked, facts, ascii_only=True)
        below = plan(found).split("Exchange hashpartitioning(run")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "regexp_replace" not in below
    assert rows(found.select("run", "n_facts", "missing_years", "grounded", "verdict")) == rows(spark.createDataFrame([("r", 2, 0, True, "SUPPORTED"), ("s", 1, 0, True, "SUPPORTED"), ("t", 0, 0, False, "REPAIR_REQUIRED")], "run string, n_facts long, missing_years int, grounded boolean, verdict string"))


def test_few_documents_are_python_objects_at_once(spark, monkeypatch):
    from graphloom.operators import chunking

    docs = spark.createDataFrame([(i, f"Head\n\n{'word ' * (i * 40)}") for i in range(200)], "doc_id long, text string").coalesce(1)
    plain = rows(chunking.chunk_documents(docs))
    monkeypatch.setattr(chunking, "DOCS_AT_ONCE", 3)
    assert rows(chunking.chunk_documents(docs)) == plain and len(plain) > 200
    assert "MapInArrow" in plan(chunking.chunk_documents(docs))
