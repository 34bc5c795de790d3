"""Work grows with the distinct keys asked, not with the questions that repeat them."""

from graphloom.operators import containment, expansion, questions

TITLE = "Judo at the 1996 Summer Olympics – Men's"


def test_games_are_joined_once_however_many_ask(spark, monkeypatch):
    seen, plain = [], questions._games
    monkeypatch.setattr(questions, "_games", lambda asked, *rest: seen.append(asked.count()) or plain(asked, *rest))
    docs = spark.createDataFrame([(f"Q{i}", f"{TITLE} {i}", f"competitors: {i}\nnations: 3") for i in range(6)], "doc_id string, title string, text string")
    asked = spark.createDataFrame([(i, "judo", 1996, "summer", 3) for i in range(40)], "qid int, sport string, year int, season string, threshold int")
    assert {tuple(r) for r in questions.count_over_threshold(asked, docs).collect()} == {(i, 2) for i in range(40)}
    assert {tuple(r) for r in questions.superlative(asked, docs).collect()} == {(i, "Q5", "Men's 5", 5) for i in range(40)}
    assert seen == [1, 1]


def test_equal_titles_are_searched_once(spark, monkeypatch):
    seen, plain = [], questions.containing
    monkeypatch.setattr(questions, "containing", lambda asked, texts, **how: seen.append(texts.count()) or plain(asked, texts, **how))
    docs = spark.createDataFrame([(f"Q{i}", TITLE, f"nations: {i}") for i in range(9, 0, -1)], "doc_id string, title string, text string")
    asked = spark.createDataFrame([(1, "judo at"), (2, TITLE)], "qid int, phrase string")
    assert {tuple(r) for r in questions.lookup_nations(asked, docs).collect()} == {(1, "Q1", 1), (2, "Q1", 1)}
    assert seen == [1]


def test_only_edges_of_asked_keys_are_numbered(spark, monkeypatch):
    seen, plain = [], expansion.capped
    monkeypatch.setattr(expansion, "capped", lambda df, *rest: seen.append(df.count()) or plain(df, *rest))
    edges = spark.createDataFrame([("Chunk", f"c{i % 20}", "MENTIONS", "Entity", f"entity_{i}") for i in range(200)], "src_type string, src_id string, edge_type string, dst_type string, dst_id string")
    seeds = spark.createDataFrame([(q, "c3", 0.5, 1) for q in range(30)], "qid int, chunk_id string, similarity double, rank int")
    assert expansion.hop_entities(seeds, edges).count() == 150
    assert seen == [10]


def test_listing_holds_asked_grams_only():
    import numpy as np
    import pandas as pd

    wanted = np.sort(containment.rolled(["bcd"], 3)[1])
    found = containment.listing(pd.Series(["abcd", None, "", "bcdbcd", "xyz"]), [3], wanted)
    assert [len(x) for x in found] == [1, 0, 0, 1, 0]


def test_the_graph_is_read_from_what_was_written(spark):
    from graphloom.plans import queries

    plan = queries.graph_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan and "InMemory" not in plan


def test_equal_questions_with_equal_seeds_run_once(spark, monkeypatch):
    from graphloom.operators import orchestration, telemetry

    routed, expanded = [], []
    plain, evidence_of = questions.route, expansion.evidence_of
    monkeypatch.setattr(questions, "route", lambda asked: routed.append(asked.count()) or plain(asked))
    monkeypatch.setattr(expansion, "evidence_of", lambda asked, *rest: expanded.append(asked.count()) or evidence_of(asked, *rest))
    asked = spark.createDataFrame([(f"q{i}", f"Who represented the country in {1996 + i // 16}?") for i in range(32)] + [("x", "Who represented the country in 1996?"), ("y", None)], "qid string, question string")
    # a double row of seeds is another list, and the order of the rows makes none
    seeds = [(f"q{i}", f"e{(i % 4) + k}#c0000", 0.5 + k / 10, k) for i in range(32) for k in ((2, 1) if i % 8 else (1, 2))] + [("x", "e0#c0000", 0.7, 2)] + [("x", "e1#c0000", 0.6, 1)] * 2
    seeds = spark.createDataFrame(seeds, "qid string, chunk_id string, similarity double, rank int")
    vertices = spark.createDataFrame([("Event", "e1", "Final", 1996, "")], "v_type string, v_id string, name string, year int, description string")
    edges = spark.createDataFrame([("Chunk", "e1#c0000", "MENTIONS", "Entity", "entity_e9"), ("Entity", "entity_e9", "RESOLVES_TO", "Event", "e9")], "src_type string, src_id string, edge_type string, dst_type string, dst_id string")
    recorder = telemetry.Recorder()
    out = orchestration.orchestrate(asked, seeds, vertices, edges, cut=recorder.cut)
    assert routed == [10]  # 2 questions with 4 lists each, x and y
    assert expanded == [5, 5]  # the lists of relational questions, whatever the year
    runs = {r.run: tuple(r)[1:] for r in out["runs"].collect()}
    docs = {}
    for r in out["documents"].collect():
        docs.setdefault(r.run, []).append((r["rank"], r.document_id))
    assert len(runs) == 34 and runs["y"][-1] == "INSUFFICIENT_EVIDENCE"
    for q in ("q18", "x"):
        alone = orchestration.orchestrate(asked.where(f"qid = '{q}'"), seeds.where(f"qid = '{q}'"), vertices, edges)
        assert tuple(alone["runs"].first())[1:] == runs[q]
        assert sorted((r["rank"], r.document_id) for r in alone["documents"].collect()) == sorted(docs[q])
    traces = {r.step: r.n_rows for r in recorder.rows(spark, out["same"]).collect()}
    assert traces["routed"] == traces["said"] == 34 and traces["ranked"] >= 32 * 2


def test_a_query_of_short_needles_is_looked_up_by_its_rarest(spark, monkeypatch):
    written, plain = [], containment.cut
    monkeypatch.setattr(containment, "cut", lambda df: written.append(plain(df)) or written[-1])
    texts = spark.createDataFrame([(i, f"hall {i % 5} in 1996") for i in range(50)], "key int, text string")
    asked = spark.createDataFrame([(0, ["7!", "1996"]), (1, ["5 h", "1996"]), (2, ["3 i", "", "1996"])], "qid int, needles array<string>")
    assert {r["qid"] for r in containment.containing(asked, texts).collect()} == {2}
    assert [r["_n"] for r in written[-1].collect()] == [10]  # no text is checked for the others


def test_pages_are_made_by_all_cores(spark):
    from graphloom.sources import corpus, tables

    rows = tables.table(spark, "/root/testdata/sf0.001", "orders")
    assert corpus.spread_out(rows, "o_orderkey").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert sorted(map(str, corpus.corpus(spark, "/root/testdata/sf0.001", spread=True).collect())) == sorted(map(str, corpus.corpus(spark, "/root/testdata/sf0.001").collect()))


def test_a_step_counts_all_runs_that_one_stands_for(spark):
    from graphloom.operators import telemetry

    recorder = telemetry.Recorder()
    recorder.cut(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "run string, seq int"), "first")
    recorder.cut(spark.createDataFrame([], "qid string"), "second")
    same = spark.createDataFrame([("a", "a"), ("x", "a"), ("b", "b")], "run string, as_run string")
    assert [(r.step, r.n_rows, r.after) for r in recorder.rows(spark, same).orderBy("number").collect()] == [("first", 5, ""), ("second", 0, "first")]
    assert [r.n_rows for r in recorder.rows(spark).orderBy("number").collect()] == [3, 0]
