import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.operators import expansion, orchestration

VERTICES = [("Event", f"e{i}", f"Final {i}", 1990 + i % 3, f"d{i}") for i in range(12)] + [("Person", f"p{i}", f"Person {i}", 0, "") for i in range(5)] + [("Venue", "venue_hall", "Hall", 0, ""), ("Venue", "venue_dome", "Dome", 0, "")]
EDGES = (
    [("Event", f"e{i}", "HELD_AT", "Venue", "venue_hall" if i % 2 else "venue_dome") for i in range(12)]
    + [("Person", f"p{i % 5}", "PARTICIPATED_IN", "Event", f"e{i}") for i in range(12)]
    + [("Chunk", f"e{i}#c0000", "MENTIONS", "Entity", f"entity_p{i % 5}") for i in range(12)]
    + [("Entity", f"entity_p{i}", "RESOLVES_TO", "Person", f"p{i}") for i in range(5)]
)
ASKED = [
    ("a", "Who won the event held at Hall in 1991?"),
    ("b", "Who won the event held at Hall, Rome in 1991?"),
    ("c", "What was held at Nowhere in 1992?"),
    ("d", "Who represented the country?"),
    ("e", "Tell me about archery in 1996."),
    ("f", "Tell me about archery."),
    ("g", "How many nations competed in the relay?"),
    ("h", "Who represented the country in 2004?"),
]
STRUCTURED = [("g", 1, "e3", "29", "The relay: nations: 29"), ("g", 2, "e4", None, "nations: 7")]
SEEDS = [(q, f"e{(i * 5 + k * 3) % 12}#c0000", 0.9 - k / 50, k) for i, (q, _) in enumerate(ASKED) if q != "f" for k in range(1, 13)]


def frames(spark):
    return (
        spark.createDataFrame(ASKED, "qid string, question string"),
        spark.createDataFrame(SEEDS, "qid string, chunk_id string, similarity double, rank int"),
        spark.createDataFrame(VERTICES, "v_type string, v_id string, name string, year int, description string"),
        spark.createDataFrame(EDGES, "src_type string, src_id string, edge_type string, dst_type string, dst_id string"),
        spark.createDataFrame(STRUCTURED, "qid string, rank int, document_id string, answer string, fact string"),
    )


def held(venue, year):
    year_of = {v[1]: v[3] for v in VERTICES}
    return sorted(e[1] for e in EDGES if e[2] == "HELD_AT" and e[4] == venue and year in (None, year_of[e[1]]))


def event_facts(events):
    by = {v[1]: v for v in VERTICES}
    facts = [(f"Event:{e}", e, f"Event {by[e][2]} ({by[e][3]}): {by[e][4]}") for e in events]
    for e in events:
        facts += [(f"Person:{p}", e, f"Person {by[p][2]} participated in event {e}") for p in sorted(x[1] for x in EDGES if x[2] == "PARTICIPATED_IN" and x[4] == e)]
    return facts


def fused(spark, qid, most):
    """The tested expansion of one question, as (chunk, document, fact) in order."""
    asked, seeds, _, edges, _ = frames(spark)
    got = expansion.retrieve(asked.where(F.col("qid") == qid), seeds.where((F.col("qid") == qid) & (F.col("rank") <= most)), edges)["evidence"].collect()
    got = sorted(got, key=lambda r: (r.score, r.chunk_id), reverse=True)
    return [(r.chunk_id, r.doc_id, f"Evidence for {r.doc_id} score={r.score:.4f}") for r in got]


def norm(text):
    return " ".join("".join(c if c.isalnum() or c in "_- " else " " for c in text.lower()).split())


def run_by_hand(spark, qid, question, budget=1):
    seeds = [(c, c.split("#")[0]) for q, c, _, _ in SEEDS if q == qid]
    year = re.search(r"\b(19\d\d|20\d\d)\b", question)
    years = set(re.findall(r"\b(19\d\d|20\d\d)\b", question))
    venue = {"a": "venue_hall", "b": "venue_hall_rome", "c": "venue_nowhere"}.get(qid)
    strategy = "structured" if qid in "abcg" else "expansion" if "represented" in question else "vector"
    items, docs, answer = [], [], ""
    if strategy == "structured":
        items = [(f"Structured:{d}", d, f) for q, _, d, _, f in STRUCTURED if q == qid]
        answer = next((a for q, _, _, a, _ in STRUCTURED if q == qid and a), "")
        items += event_facts(held(venue, int(year.group()))) if venue else []
        docs = [d for _, d, _ in items]
    if strategy == "expansion":
        every = fused(spark, qid, 99)
        items, docs = every[:10], [d for _, d, _ in every]
    if strategy == "vector" or not docs:
        items = [(c, d, f"Chunk {c}") for c, d in seeds[:10]]
        docs = [d for _, d in seeds]
    docs = list(dict.fromkeys(docs))
    answer = answer or (docs[0] if docs else "")
    led = dict()
    for s, d, f in items:
        led.setdefault(s, (d, f))

    def verify():
        facts = [f for _, f in led.values()]
        tokens = [t for t in norm(answer).split() if len(t) > 2 or any(c.isdigit() for c in t)]
        grounded = any(norm(answer) in norm(f) or (tokens and all(t in norm(f) for t in tokens)) for f in facts) if answer else bool(facts)
        missing = [y for y in years if not any(y in f for f in facts)]
        if facts and not missing and (grounded or not answer):
            return "SUPPORTED"
        return "REPAIR_REQUIRED" if (answer and not grounded) or missing else "INSUFFICIENT"

    first, plan, recovered = verify(), None, None
    if first == "REPAIR_REQUIRED" and budget > 0:
        repair_venue = {"a": "venue_hall", "b": "venue_hall", "c": "venue_nowhere"}.get(qid)
        more = event_facts(held(repair_venue, int(year.group()))) if repair_venue else []
        plan = "composite" if more else "expansion"
        more = more or fused(spark, qid, 10)
        recovered = len(more)
        for s, d, f in more:
            led.setdefault(s, (d, f))
        docs = list(dict.fromkeys([d for d, _ in led.values()] + docs))
    verdict = verify()
    said = "INSUFFICIENT_EVIDENCE" if verdict == "INSUFFICIENT" and not led else answer
    return (strategy, answer, first, verdict, len(led), plan, recovered, said), docs


@pytest.mark.parametrize("budget", [1, 0])
def test_runs_match_a_run_by_hand(spark, budget):
    asked, seeds, vertices, edges, structured = frames(spark)
    out = orchestration.orchestrate(asked, seeds, vertices, edges, structured, budget=budget)
    runs = {r.run: (r.strategy, r.candidate, r.first_verdict, r.verdict, r.n_facts, r.plan, r.recovered, r.answer) for r in out["runs"].collect()}
    ranked = defaultdict(dict)
    for r in out["documents"].collect():
        ranked[r.run][r["rank"]] = r.document_id
    for qid, question in ASKED:
        want, docs = run_by_hand(spark, qid, question, budget)
        assert runs[qid] == want, qid
        assert [ranked[qid][k] for k in sorted(ranked[qid])] == docs, qid
    plans = {runs[q][5] for q, _ in ASKED}
    assert plans == ({None, "composite", "expansion"} if budget else {None})


def test_no_questions_and_no_seeds(spark):
    asked, seeds, vertices, edges, _ = frames(spark)
    assert orchestration.orchestrate(asked.limit(0), seeds, vertices, edges)["runs"].collect() == []
    out = orchestration.orchestrate(asked, seeds.limit(0), vertices, edges)["runs"].collect()
    assert {r.run: r.answer for r in out}["f"] == "INSUFFICIENT_EVIDENCE" and len(out) == len(ASKED)
