import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import evaluation as ev, evidence as ed, questions as qs
from graphloom.sources import gateway, tables
from graphloom.streaming import harness

QUESTION = "qid int, question string"


@pytest.mark.parametrize(
    ("question", "venue", "repair", "date", "year", "strategy"),
    [
        ("Who won the event held at Hall A, Rome on 3 August 1996?", "Hall A, Rome", "Hall A", "3 August 1996", 1996, "structured"),
        ("Who won at the event held at Dock in 1972?", "Dock", "Dock", None, 1972, "structured"),
        ("Who was held at the Bay?", "the Bay", "the Bay", None, None, "structured"),
        ("Which country won?", None, None, None, None, "structured"),
        ("Who competed?", None, None, None, None, "expansion"),
        ("Who won in 1850?", None, None, None, None, "vector"),
        ("How many events had more than 5?", None, None, None, None, "structured"),
    ],
)
def test_analysis_and_routing(spark, question, venue, repair, date, year, strategy):
    r = qs.route(spark.createDataFrame([(1, question)], QUESTION)).first()
    assert (r.venue, r.repair_venue, r.date, r.year, r.strategy) == (venue, repair, date, year, strategy)


def test_predecessor_games(spark):
    years = spark.createDataFrame([(2000, "Summer"), (1994, "Winter"), (1998, "Winter")], "y int, s string")
    assert [r.x for r in years.select(qs.predecessor_games(F.col("y"), F.col("s")).alias("x")).collect()] == [1996, 1992, 1994]


def test_structured_questions(spark):
    pages = [(f"d{i}", f"Rowing at the 1996 Summer Olympics – E{i}", f"[Infobox]\n competitors: {n}\n nations: {i}\n venue: V\n date: 3 August") for i, n in enumerate([5, 9, 9, 2])] + [("x", "No title", "nothing")]
    docs = spark.createDataFrame(pages, "doc_id string, title string, text string")
    asked = spark.createDataFrame([(1, "rowing", 1996, "summer", 4), (2, "Chess", 1996, "Summer", 0)], "qid int, sport string, year int, season string, threshold int")
    assert {(r.qid, r.n) for r in qs.count_over_threshold(asked, docs).collect()} == {(1, 3), (2, 0)}
    best = qs.superlative(asked, docs).collect()
    assert [(b.qid, b.doc_id, b.event, b.competitors) for b in best] == [(1, "d1", "E1", 9)]
    look = spark.createDataFrame([(1, "ROWING at the 1996 summer olympics – e2"), (2, "1996 Summer"), (3, "zzz")], "qid int, phrase string")
    assert {(r.qid, r.doc_id, r.nations) for r in qs.lookup_nations(look, docs).collect()} == {(1, "d2", 2), (2, "d0", 0)}
    where = spark.createDataFrame([(1, "V", "august 3"), (2, "V", "july")], "qid int, venue string, date string")
    assert {(r.qid, r.doc_id) for r in qs.grounded_in(where, docs).collect()} == {(1, f"d{i}") for i in range(4)}


ITEM = "run string, seq int, source_type string, source_id string, document_id string"


def test_ledger_first_write_wins(spark):
    items = spark.createDataFrame([("r", 2, "graph", "a", "d1"), ("r", 1, "vector", "a", "d2"), ("r", 3, "vector", "b", "d2"), ("r", 4, "vector", "c", "d1")], ITEM)
    kept = ed.ledger(items)
    assert [(r.source_id, r.document_id, r.evidence_id) for r in kept.orderBy("seq").collect()] == [("a", "d2", "ev-0001"), ("b", "d2", "ev-0002"), ("c", "d1", "ev-0003")]
    assert [r.document_id for r in ed.ledger_documents(kept).orderBy("position").collect()] == ["d2", "d1"]
    with pytest.raises(ValueError):
        ed.ledger(items.withColumn("source_type", F.lit("web")))


@pytest.mark.parametrize(
    ("question", "answer", "facts", "verdict", "focus"),
    [
        ("Who won in 1996?", "Ann Lee", ["In 1996 Ann Lee won"], "SUPPORTED", None),
        ("Who won in 1996?", "Ann Lee", ["In 1992 Ann Lee won"], "REPAIR_REQUIRED", "filter_by_year_constraint"),
        ("Who won?", "Bob Day", ["Ann Lee won"], "REPAIR_REQUIRED", "retrieve_missing_gold_document"),
        ("Who won?", "Lee Ann", ["Ann Lee won"], "SUPPORTED", None),
        ("Who won?", "Ann Day", ["Ann won", "Day won"], "REPAIR_REQUIRED", "retrieve_missing_gold_document"),
        ("Who won?", "", [], "INSUFFICIENT", None),
        ("Who won in 1996?", "", [], "REPAIR_REQUIRED", "filter_by_year_constraint"),
        ("Who won?", "", ["x"], "SUPPORTED", None),
    ],
)
def test_verdicts(spark, question, answer, facts, verdict, focus):
    asked = spark.createDataFrame([("r", question, answer)], "run string, question string, answer string")
    known = spark.createDataFrame([("r", f"ev-{i}", f) for i, f in enumerate(facts)], "run string, evidence_id string, fact string")
    row = ed.verify(asked, known).first()
    assert (row.verdict, row.focus) == (verdict, focus)


def test_repair_budget_and_rerank(spark):
    rows = spark.createDataFrame([("a", "REPAIR_REQUIRED", "f", 1, "V"), ("b", "REPAIR_REQUIRED", "f", 0, None), ("c", "SUPPORTED", None, 1, None), ("d", "REPAIR_REQUIRED", "g", 1, None)], "run string, verdict string, focus string, left int, venue string")
    assert {(r.run, r.plan) for r in ed.repairs(rows, F.col("left")).collect()} == {("a", "composite"), ("d", "expansion")}
    led = spark.createDataFrame([("r", "d3", 1), ("r", "d1", 2)], "run string, document_id string, position int")
    old = spark.createDataFrame([("r", "d1", 1), ("r", "d2", 2)], "run string, document_id string, rank int")
    assert [r.document_id for r in ed.rerank(led, old).orderBy("rank").collect()] == ["d3", "d1", "d2"]


def log(spark, kinds):
    return spark.createDataFrame([("r", i, k, f"p{i}") for i, k in enumerate(kinds)], "run string, seq int, kind string, payload string")


@pytest.mark.parametrize(
    ("kinds", "phase", "sticky"),
    [
        (["SKILL_ACTIVATED", "UNKNOWN"], "INITIALIZED", "INITIALIZED"),
        (["EVIDENCE_ADDED", "TOOL_CALLED"], "EVIDENCE_ACCUMULATED", "EVIDENCE_ACCUMULATED"),
        (["TOOL_CALLED"] * 16, "FAILED", "FAILED"),
        (["TOOL_CALLED"] * 15, "INITIALIZED", "INITIALIZED"),
        (["REPAIR_ATTEMPTED"], "REPAIRING", "REPAIRING"),
        (["REPAIR_ATTEMPTED"] * 2, "FAILED", "FAILED"),
        (["REPAIR_ATTEMPTED"] * 2 + ["ANSWER_PROPOSED"], "VERIFYING", "FAILED"),
        (["ANSWER_PROPOSED", "EXECUTION_COMPLETED"], "COMPLETED", "COMPLETED"),
    ],
)
def test_run_states(spark, kinds, phase, sticky):
    row = ed.run_states(log(spark, kinds)).first()
    assert row.phase == phase and ed.run_states(log(spark, kinds), sticky=True).first().phase == sticky
    assert harness.fold((0, "INITIALIZED", 0, 0), kinds)[1] == phase
    assert row.events == len(kinds) and row.tools == kinds.count("TOOL_CALLED")


def test_unknown_strategy_is_refused(spark):
    with pytest.raises(ValueError):
        ed.run_states(log(spark, ["STRATEGY_CHOSEN"]))


def test_streamed_states_match_the_batch(spark, tmp_path):
    kinds = ["STRATEGY_CHOSEN", "TOOL_CALLED", "EVIDENCE_ADDED", "REPAIR_ATTEMPTED", "ANSWER_PROPOSED"]
    rows = [(f"r{i % 5}", i, kinds[(i * 7) % 5], "vector") for i in range(200)]
    schema = "run string, seq int, kind string, payload string"
    for part in range(2):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = harness.run_states_stream(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    seen = {}
    for r in spark.sql("SELECT * FROM states ORDER BY events").collect():
        seen[r.run] = (r.events, r.tools, r.repairs)
    want = {r.run: (r.events, r.tools, r.repairs) for r in ed.run_states(spark.createDataFrame(rows, schema)).collect()}
    assert seen == want


def test_answers(spark):
    rows = [("a", "29", "29 nations", "SUPPORTED", 1), ("b", "29", "many", "SUPPORTED", 1), ("c", "Ann", "It was Ann", "SUPPORTED", 1), ("d", "Ann", "Q12", "SUPPORTED", 1), ("e", "", "text", "SUPPORTED", 1), ("f", "x", "y", "INSUFFICIENT", 0), ("g", "Ann", "no", "SUPPORTED", 1)]
    got = {r.run: r.answer for r in ed.answers(spark.createDataFrame(rows, "run string, candidate string, model string, verdict string, n_facts int")).collect()}
    assert got == {"a": "29 nations", "b": "29", "c": "It was Ann", "d": "Ann", "e": "text", "f": "INSUFFICIENT_EVIDENCE", "g": "Ann"}


def test_metrics(spark):
    ranked = spark.createDataFrame([(q, d, k) for q, ds in enumerate(["abc", "xay", "bca", "zzz"]) for k, d in enumerate(ds, 1)], "qid int, id string, rank int").dropDuplicates(["qid", "id"])
    gold = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (2, "c"), (3, "a")], "qid int, id string")
    asked = spark.createDataFrame([(q, "t" if q < 2 else "u") for q in range(4)], "qid int, qtype string")
    ranks = ev.first_gold_rank(asked, ranked, gold)
    assert {r.qid: r.first_rank for r in ranks.collect()} == {0: 1, 1: 2, 2: 2, 3: None}
    m = ev.metrics(ranks, (1, 2)).first()
    assert (m.recall_1, m.recall_2, m.mrr) == (0.25, 0.75, 0.5)
    assert ev.metrics(ranks.limit(0)).first().mrr == 0
    by = {(r.qtype, r.is_total): r.n for r in ev.metrics_by(ranks, "qtype").collect()}
    assert by == {("t", 0): 2, ("u", 0): 2, (None, 1): 4}
    assert not spark.range(1).select(ev.hit(F.lit(1), 0).alias("x")).first().x


@pytest.mark.parametrize(
    ("reference", "predicted", "strict", "lenient"),
    [("29", "29 nations competed", "CONFIRMED_CORRECT", True), ("29", "There were **30** events", "CONFIRMED_INCORRECT", False), ("12", "twelve", "CONFIRMED_INCORRECT", True), ("7", "group of 7 and 8", "CONFIRMED_CORRECT", True), ("Ann Lee", "it was ANN-LEE!", "CONFIRMED_CORRECT", True), ("Ann Lee", "Lee Ann", "MANUAL_REVIEW", True), ("Ann", "Q12", "CONFIRMED_INCORRECT", False), ("Ann", "", "CONFIRMED_INCORRECT", False), ("10 kilometre", "10 km", "CONFIRMED_CORRECT", True), ("Ann Lee", "Bob", "CONFIRMED_INCORRECT", False)],
)
def test_scorers(spark, reference, predicted, strict, lenient):
    row = ev.score_answers(spark.createDataFrame([(1, reference, predicted)], "qid int, reference string, predicted string")).first()
    assert (row.strict, row.lenient) == (strict, lenient)


def test_runs_compare_merge_audit(spark):
    a = spark.createDataFrame([("1", 1.0), ("2", 2.0)], "qid string, x double")
    b = spark.createDataFrame([("2", 5.0), ("3", 3.0)], "qid string, x double")
    assert {(r.qid, r.x, r.origin) for r in ev.merge_runs(a, b, "qid").collect()} == {("1", 1.0, "old"), ("2", 5.0, "new"), ("3", 3.0, "new")}
    assert {(r.qid, r["diff"]) for r in ev.compare_runs(a, b, "qid", ["x"]).collect()} == {("1", None), ("2", 3.0), ("3", None)}
    assert not ev.audit(a, b, "qid").first().same and ev.audit(a, a, "qid").first().same


def test_gateway(spark):
    tool = lambda t: gateway.decide(spark.createDataFrame([(t,)], "tool string")).first().decision
    assert [tool(t) for t in ("get_node", "GET_EDGES", "delete_all", "upsert_vertex", "runme", None)] == ["allowed", "allowed", "blocked", "blocked", "unknown", "unknown"]
    texts = {'```json\n{"a": 1}\n```': '{"a": 1}', "ok [1, 2] end": "[1, 2]", "no json": None, "{broken": None}
    for text, want in texts.items():
        assert spark.createDataFrame([(text,)], "t string").select(gateway.embedded_json(F.col("t")).alias("j")).first().j == want


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "corpus.jsonl"
    path.write_text("\n".join(['{"doc_id": "b", "title": "B", "text": null}', "", '{"doc_id": "a", "text": "t"}']))
    rows = tables.read_corpus(spark, str(path)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.title, r.text) for r in rows] == [("a", "", "t"), ("b", "B", "")]
    assert [r.doc_id for r in tables.read_corpus(spark, str(path), limit=1).collect()] == ["a"]
    asked = tmp_path / "q.jsonl"
    asked.write_text(json.dumps({"qid": "1", "question": "x", "qtype": "t", "gold_doc_ids": ["a"]}))
    assert tables.read_questions(spark, str(asked), 1).count() == 1
    with pytest.raises(ValueError):
        tables.read_questions(spark, str(asked), 2)
    v = spark.createDataFrame([("A", "1", "old", 1), ("A", "1", "new", 2), ("B", "2", "x", 1)], "v_type string, v_id string, name string, seq int")
    tables.write_vertices(v, str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    assert {(r.v_type, r.name) for r in stored.collect()} == {("A", "new"), ("B", "x")}
    tables.upsert_vertices(spark, str(tmp_path / "v"), spark.createDataFrame([("B", "2", "y"), ("C", "3", "z")], "v_type string, v_id string, name string"), str(tmp_path / "v2"))
    assert {(r.v_type, r.name) for r in spark.read.parquet(str(tmp_path / "v2")).collect()} == {("A", "new"), ("B", "y"), ("C", "z")}
    todo = spark.range(10).withColumnRenamed("id", "k")
    work = lambda df: df.withColumn("done", F.lit(True))
    assert [tables.resume(spark, todo.where("k < 4"), str(tmp_path / "out"), "k", work), tables.resume(spark, todo, str(tmp_path / "out"), "k", work), tables.resume(spark, todo, str(tmp_path / "out"), "k", work)] == [4, 6, 0]
    tables.write_json(todo, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 10
    ids = spark.createDataFrame([("a",)], "chunk_id string")
    assert tables.read_vectors(ids, ids.withColumn("v", F.array(F.lit(1.0)))).count() == 1
    with pytest.raises(ValueError):
        tables.read_vectors(ids, ids.limit(0).withColumn("v", F.array(F.lit(1.0))))
    tables.write_edges(spark.createDataFrame([("a", "X"), ("a", "X")], "src_id string, edge_type string"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 1


def test_policy_is_a_table(spark):
    calls = spark.createDataFrame([("gsql",), ("graph__gsql",), ("generate_cypher",), ("run_loading_job_with_file",), ("graph__fetch_vector",), ("get_schema",), ("remove_all",), (None,)], "tool string")
    got = {r.tool: r.decision for r in gateway.decide(calls).collect()}
    assert got == {"gsql": "blocked", "graph__gsql": "blocked", "generate_cypher": "blocked", "run_loading_job_with_file": "blocked", "graph__fetch_vector": "allowed", "get_schema": "unknown", "remove_all": "blocked", None: "unknown"}
    own = spark.createDataFrame([("get_schema", "allowed"), ("fetch_vector", "allowed"), ("fetch_vector", "blocked")], "tool string, decision string")
    mine = {r.tool: r.decision for r in gateway.decide(calls, policy=own).collect()}
    assert mine["get_schema"] == "allowed" and mine["graph__fetch_vector"] == "blocked" and mine["gsql"] == "unknown"
