import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import expansion as ex, extraction as xt, tools, vectors as vx

EDGE = "src_type string, src_id string, edge_type string, dst_type string, dst_id string"
VERTEX = "v_type string, v_id string, name string, year int, description string"


def test_infobox_last_key_wins_and_lines_without_colon_go(spark):
    text = "intro\n[Infobox Olympic event]\n  event: A: B\n  no colon\n  gold: x\n  gold: y\n\n  after: no"
    row = spark.createDataFrame([(text,)], "t string").select(xt.infobox_pairs(F.col("t")).alias("p"), xt.field(xt.infobox_pairs(F.col("t")), "gold").alias("g"), xt.body_field(xt.infobox_body(F.col("t")), "gold").alias("b"), xt.body_field(xt.infobox_body(F.col("t")), "gol").alias("n")).first()
    assert row.b == "y" and row.n is None
    assert [(p.key, p.value) for p in row.p] == [("event", "A: B"), ("gold", "x"), ("gold", "y")] and row.g == "y"


@pytest.mark.parametrize(
    ("title", "event", "teams", "competitors", "team"),
    [("Rowing – Men's eight", "eight", None, None, True), ("x", "Women's individual team", None, None, False), ("Sailing – 470", "470", None, None, True), ("Cycling", "4 × 100", None, None, True), ("a", "b", "12", "12", False), ("a", "b", "12", "24", True), ("a", "b", "", "3", True), ("a", "b", None, "3", False), ("Gymnastics – solo group", "x", None, None, False), ("Canoe", "K-2 500", None, None, True)],
)
def test_team_events(spark, title, event, teams, competitors, team):
    frame = spark.createDataFrame([(title, event, teams, competitors)], "a string, b string, c string, d string")
    assert frame.select(xt.is_team_event(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x")).first().x is team


PAGES = [
    ("Q2", "Judo at the 1996 Summer Olympics – Women's open", "[Infobox Olympic event]\n  event: Women's open\n  games: 1996 Summer\n  venue: Hall A\n  gold: Ann Lee\n  goldNOC: FRA\n  silver: Vacant\n  bronze: Bea\n  bronzeNOC: fr\n\nAnn Lee (FRA) won at Hall A. BEA lost."),
    ("Q1", "Judo at the 1992 Summer Olympics – Team", "[Infobox Olympic event]\n  event: Team\n  venues: Hall A\n  gold: AB\n  goldNOC: GER\n\nGER won judo."),
    ("Q3", "No games here", "[Infobox Olympic event]\n  event: Odd\n  gold: Ann Lee\n  goldNOC: USA\n\nx"),
    ("Q4", "Not an event", "just text"),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "doc_id string, title string, text string")


def test_graph_extraction(spark):
    vertices, edges = xt.extract_graph(pages(spark))
    v = {(r.v_type, r.v_id): r for r in vertices.collect()}
    assert set(v) == {("Event", "Q1"), ("Event", "Q2"), ("Event", "Q3"), ("Sport", "sport_judo"), ("Venue", "venue_hall_a"), ("Country", "country_FRA"), ("Country", "country_GER"), ("Country", "country_USA"), ("Person", "person_ann_lee"), ("Person", "person_bea"), ("Team", "team_Q1_gold")}
    assert v["Event", "Q2"].year == 1996 and v["Event", "Q1"].year == 1992 and v["Event", "Q3"].year == 0
    e = {tuple(r)[1:3] + (r.dst_id,) for r in edges.collect()}
    assert ("person_ann_lee", "REPRESENTS", "country_FRA") in e and ("person_ann_lee", "REPRESENTS", "country_USA") in e and ("Q1", "HELD_AT", "venue_hall_a") in e and ("team_Q1_gold", "PARTICIPATED_IN", "Q1") in e
    assert xt.integrity_errors(vertices, edges).count() == 0
    stats = xt.extraction_stats(pages(spark)).first()
    assert (stats.events, stats.ambiguous_titles, stats.missing_years, stats.missing_venues, stats.vacant_slots, stats.invalid_nocs, stats.team_medals, stats.person_medals) == (3, 1, 1, 1, 1, 1, 1, 3)


def test_integrity_errors_are_named(spark):
    v = spark.createDataFrame([("A", "a", "", 0, "")], VERTEX)
    e = spark.createDataFrame([("A", "a", "E", "A", "zz"), ("A", "b", "E", "A", "a"), ("A", "a", "E", "B", "a"), ("A", "", "E", "A", "a")], EDGE)
    assert sorted((r.problem, r.id) for r in xt.integrity_errors(v, e).collect()) == [("empty_id", ""), ("missing_source", ""), ("missing_source", "b"), ("missing_target", "a"), ("missing_target", "zz"), ("unknown_type", "a")]


def test_mentions_by_kind(spark):
    surfaces = xt.document_surfaces(pages(spark))
    chunks = pages(spark).select(F.col("doc_id").alias("document_id"), F.concat("doc_id", F.lit("#c0000")).alias("chunk_id"), F.substring_index("text", "\n\n", -1).alias("text"))
    found = xt.mentions(chunks, surfaces)
    assert {(r.chunk_id[:2], r.entity_id) for r in found.collect()} == {("Q2", "entity_person_ann_lee"), ("Q2", "entity_country_FRA"), ("Q2", "entity_venue_hall_a"), ("Q1", "entity_country_GER"), ("Q1", "entity_sport_judo")}
    assert [r.document_id for r in xt.title_only(found, surfaces).collect()] == ["Q2"]


def test_knn_matches_brute_force_in_blocks(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[7] = m[3]
    corpus = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, v array<double>").repartition(5)
    queries = corpus.where("id < 20").withColumnRenamed("id", "qid")
    for block in (4096, 3):
        got = {}
        for r in vx.knn(queries, corpus, 5, block=block).collect():
            got.setdefault(r.qid, []).append((r["rank"], r.id, r.distance, r.similarity))
        for q in range(20):
            d = np.round(1 - m[q] @ m.T, 6)
            order = sorted(range(60), key=lambda i: (d[i], i))[:5]
            assert [x[1] for x in sorted(got[q])] == order
            assert all(abs(x[2] - d[x[1]]) < 1e-9 and abs(x[3] - max(0, 1 - d[x[1]])) < 1e-6 for x in got[q])
    assert vx.knn(queries.limit(0), corpus, 5).collect() == []


def test_vector_layers(spark):
    v = [3.0, 4.0, 0.0, 0.0]
    row = spark.createDataFrame([(v,)], "v array<double>").select(vx.l2_normalized(F.col("v")).alias("u"), vx.truncated(F.col("v"), 1).alias("t"), vx.layer_normed(F.col("v")).alias("ln"), vx.mean_pooled(F.array(F.col("v"), F.col("v"), F.col("v")), F.array(F.lit(1), F.lit(0), F.lit(1))).alias("p"), vx.l2_normalized(F.array(F.lit(0.0))).alias("z")).first()
    assert row.u == [0.6, 0.8, 0, 0] and row.t == [1.0] and row.p == v and row.z == [0.0]
    a = np.array(v)
    assert np.allclose(row.ln, (a - a.mean()) / np.sqrt(a.var() + 1e-5))
    with pytest.raises(ValueError):
        vx.truncated(F.col("v"), 769)
    checks = vx.vector_checks(spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [math.nan, 1.0]), (3, [2.0])], "id int, v array<double>"), 2).first()
    assert (checks.n_rows, checks.n_ids, checks.wrong_size, checks.not_finite, checks.zero) == (4, 3, 1, 1, 1)


def seeds(spark, *rows):
    return spark.createDataFrame([(1, c, s, k) for k, (c, s) in enumerate(rows, 1)], "qid int, chunk_id string, similarity double, rank int")


@pytest.mark.parametrize(
    ("question", "sims", "expand", "reason"),
    [("Who won?", [0.9, 0.5], False, "vector_only"), ("What was held at X?", [0.9], True, "relational_1"), ("Who won?", [], True, "no_seeds"), ("Who won?", [0.7], True, "low_confidence"), ("Who won?", [0.75, 0.74], True, "low_margin"), ("Who won?", [0.85, 0.849], False, "vector_only"), ("Who won?", [0.75], False, "vector_only")],
)
def test_gate(spark, question, sims, expand, reason):
    asked = spark.createDataFrame([(1, question)], "qid int, question string")
    row = ex.gate(asked, seeds(spark, *((f"c{i}", s) for i, s in enumerate(sims)))).first()
    assert (row.expand, row.reason) == (expand, reason)
    assert ex.gate(asked, seeds(spark, *((f"c{i}", s) for i, s in enumerate(sims))), ex.Limits(gating=False)).first().reason == "gating_disabled"


def graph(spark):
    rows = [("Chunk", "Q1#c0000", "MENTIONS", "Entity", "entity_p"), ("Chunk", "Q2#c0000", "MENTIONS", "Entity", "entity_v"), ("Chunk", "Q2#c0000", "MENTIONS", "Entity", "entity_s"), ("Chunk", "Q2#c0000", "MENTIONS", "Entity", "entity_Q9")]
    rows += [("Entity", "entity_p", "RESOLVES_TO", "Person", "p"), ("Entity", "entity_v", "RESOLVES_TO", "Venue", "v"), ("Entity", "entity_s", "RESOLVES_TO", "Sport", "s"), ("Entity", "entity_Q9", "RESOLVES_TO", "Event", "Q9")]
    rows += [("Person", "p", "PARTICIPATED_IN", "Event", f"Q{i}") for i in range(1, 9)] + [("Event", f"Q{i}", "HELD_AT", "Venue", "v") for i in range(3, 20)] + [("Event", "Q9", "BELONGS_TO", "Sport", "s")]
    return spark.createDataFrame(rows, EDGE)


def test_expansion_is_bounded_and_keeps_the_best_path(spark):
    s = seeds(spark, ("Q1#c0000", 0.9), ("Q2#c0000", 0.8))
    got = {r.derived_id: r for r in ex.expand(s, graph(spark)).collect()}
    assert set(got) == {f"Q{i}#c0000" for i in (2, 3, 4, 5)} | {f"Q{i}#c0000" for i in (10, 11, 12, 13, 14, 15, 16, 17, 18, 19)} | {"Q9#c0000"}
    assert got["Q3#c0000"].score == pytest.approx(0.9 * 0.81) and got["Q9#c0000"].score == pytest.approx(0.72) and got["Q9#c0000"].hop == 1
    assert "Q1#c0000" not in got  # a seed isn't its own evidence
    few = ex.expand(s, graph(spark), ex.Limits(chunks=2)).collect()
    assert len(few) == 2


def test_fusion_and_ranking(spark):
    s = seeds(spark, ("Q1#c0000", 0.9), ("Q2#c0000", 0.8))
    g = spark.createDataFrame([(1, "Q2#c0000", 0.7, 2, "Q1#c0000", "Q2", ["a -> b"]), (1, "Q3#c0000", 0.75, 2, "Q1#c0000", "Q3", ["c"])], "qid int, derived_id string, score double, hop int, seed string, doc_id string, provenance array<string>")
    fused = {r.chunk_id: r for r in ex.fuse(s, g).collect()}
    assert fused["Q2#c0000"].score == pytest.approx(0.835) and fused["Q2#c0000"].source == "seed+graph" and "a -> b" in fused["Q2#c0000"].provenance
    assert (fused["Q1#c0000"].source, fused["Q3#c0000"].source) == ("seed", "graph")
    ranked = [r.doc_id for r in ex.rank_documents(ex.fuse(s, g)).orderBy("rank").collect()]
    assert ranked == ["Q1", "Q2", "Q3"]


def test_unexpanded_questions_keep_their_seeds(spark):
    asked = spark.createDataFrame([(1, "Who won?")], "qid int, question string")
    out = ex.retrieve(asked, seeds(spark, ("Q1#c0000", 0.9), ("Q2#c0000", 0.5)), graph(spark))
    stats = out["stats"].first()
    assert (stats.expand, stats.n_evidence, stats.n_graph) == (False, 2, 0)
    many = ex.retrieve(spark.createDataFrame([(1, "Which venue?")], "qid int, question string"), seeds(spark, ("Q1#c0000", 0.9), ("Q2#c0000", 0.5)), graph(spark))
    assert many["stats"].first().n_graph <= 20 and many["stats"].first().n_evidence == many["evidence"].count()


def tool_graph(spark):
    v = [("Event", "e1", "Men's Final", 1996, "Men's Final"), ("Event", "e2", "Heat 3 August", 1996, ""), ("Event", "e3", "Final", 1992, ""), ("Person", "p1", "Ann", 0, ""), ("Person", "p2", "", 0, ""), ("Team", "t1", "Duo", 0, ""), ("Country", "c1", "France", 0, ""), ("Venue", "v1", "Hall", 0, ""), ("Sport", "s1", "Judo", 0, "")]
    e = [("Person", "p1", "PARTICIPATED_IN", "Event", "e1"), ("Person", "p1", "PARTICIPATED_IN", "Event", "e2"), ("Person", "p2", "PARTICIPATED_IN", "Event", "e1"), ("Team", "t1", "PARTICIPATED_IN", "Event", "gone"), ("Person", "p1", "REPRESENTS", "Country", "c1"), ("Person", "p2", "REPRESENTS", "Country", "c9"), ("Event", "e1", "HELD_AT", "Venue", "v1"), ("Event", "e3", "HELD_AT", "Venue", "v1"), ("Event", "e1", "BELONGS_TO", "Sport", "s1")]
    return spark.createDataFrame(v, VERTEX), spark.createDataFrame(e, EDGE)


def test_tools(spark):
    v, e = tool_graph(spark)
    part = lambda *ids: spark.createDataFrame(list(ids), "v_type string, v_id string")
    assert {(r.event_id, r.name, r.year) for r in tools.events_for_participants(part(("Team", "t1"), ("Person", "p1")), v, e).collect()} == {("gone", "", 0), ("e1", "Men's Final", 1996), ("e2", "Heat 3 August", 1996)}
    with pytest.raises(ValueError):
        tools.events_for_participants(part(("Sport", "s1")), v, e)
    context = tools.event_context(spark.createDataFrame([("e1",), ("none",)], "event_id string"), v, e).collect()
    assert len(context) == 1 and context[0].sport_name == "Judo" and [(p.id, p.name) for p in context[0].participants] == [("p1", "Ann"), ("p2", "p2")]
    assert {(r.v_id, r.country) for r in tools.countries_of(part(("Person", "p1"), ("Person", "p2")), v, e).collect()} == {("p1", "France"), ("p2", "c9")}
    ids = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "event_id string")
    names = lambda **f: {r.event_id for r in tools.filter_events(ids, v, e, **f).collect()}
    assert names(name="FINAL") == {"e1", "e3"} and names(year=1996, venue_id="v1") == {"e1"} and names(sport="jud") == {"e1"} and names() == {"e1", "e2", "e3"}
    venues = spark.createDataFrame([("v1",)], "venue_id string")
    assert {r.event_id for r in tools.events_for_venues(venues, v, e, bound=1).collect()} == {"e1"}
    assert tools.nodes(v, part(("Event", "nope"))).count() == 0 and tools.edges_of(e, part(("Person", "p1"))).count() == 3


def test_composite_and_its_quirk(spark):
    v, e = tool_graph(spark)
    nobody = spark.createDataFrame([("Person", "zz")], "v_type string, v_id string")
    venues = spark.createDataFrame([("v1",)], "venue_id string")
    assert tools.composite(v, e, nobody, venues)["events"].count() == 0
    assert {r.event_id for r in tools.composite(v, e, nobody, venues, compat=True)["events"].collect()} == {"e1", "e3"}
    ann = spark.createDataFrame([("Person", "p1")], "v_type string, v_id string")
    out = tools.composite(v, e, ann, cue="3 august")
    assert [(r.event_id, r.score) for r in out["events"].orderBy(F.col("score").desc()).collect()] == [("e2", 110.0), ("e1", 0.0)]
    assert out["countries"].first().country_ids == ["c1", "c9"]
