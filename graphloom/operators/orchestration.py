"""The rule-path run for a batch of questions: route, retrieve by strategy, keep a ledger, verify, repair once, answer.

Every step is a join or an aggregate over all questions; a question is a run. Steps that feed several others are written with ``cut``, so nothing is computed twice and plans stay small.
Equal questions with equal seeds have equal runs: the steps take one of them, and what they give is joined to all at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import date_score, doc_of_chunk, normalized, vertex_id
from ..sources import tables
from ..sources.layout import Adjacency, per_key
from . import evidence, expansion, questions, tools
from .expansion import Limits, capped

#: Evidence taken from a retrieval and from a fallback, seeds of a repair, and events expanded when a date is asked for.
TAKEN, FALLBACK, REPAIR_SEEDS, DATED = 10, 5, 10, 10

#: The ledger's input: ``run, seq, source_type, source_id, document_id, fact``.
ITEM = ["run", "seq", "source_type", "source_id", "document_id", "fact"]


def venue_events(asked: DataFrame, vertices: DataFrame, edges: DataFrame | Adjacency, ascii_only: bool = False) -> DataFrame:
    """Events held at the venue of ``qid, venue_id, year`` (and ``date``, if it has one), in that year if one is asked for: ``qid, event_id, name, year, description, nth``.

    In the order of ids; with a date those that match it best come first. All of them count as evidence; how many are expanded to participants is said by ``expanded``.
    """
    ids = asked.select("venue_id").distinct()
    held = per_key(edges, "into", lambda e: e.where("edge_type = 'HELD_AT'").select(F.col("dst_id").alias("venue_id"), F.col("src_id").alias("event_id")).join(ids, "venue_id", "left_semi").distinct())
    events = vertices.where("v_type = 'Event'").select(F.col("v_id").alias("event_id"), "name", F.col("year").alias("event_year"), "description")
    rows = asked.join(held, "venue_id").join(events, "event_id").where(F.col("year").isNull() | (F.col("year") == F.col("event_year")))
    order = [F.col("event_id")]
    expanded = F.lit(tools.BOUND)
    if "date" in asked.columns:
        norm = lambda c: normalized(c, ascii_only)
        rows = rows.withColumn("_score", F.when(F.col("date").isNull(), 0.0).otherwise(date_score(norm(F.col("date")), norm(F.concat_ws(" ", "name", "description")))))
        order = [F.col("_score").desc(), *order]
        expanded = F.when(F.col("date").isNull(), tools.BOUND).otherwise(DATED)
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    return rows.select("qid", "event_id", "name", F.col("event_year").alias("year"), "description", nth.alias("nth"), expanded.alias("expanded"))


def _event_facts(found: DataFrame, vertices: DataFrame, edges: DataFrame | Adjacency, first: int, bound: int = tools.BOUND) -> DataFrame:
    """Events and their first participants as ledger items, numbered from ``first``."""
    own = found.select(F.col("qid").alias("run"), F.struct(F.lit(0).alias("part"), "nth", F.lit("").alias("p")).alias("o"), F.concat(F.lit("Event:"), "event_id").alias("source_id"), F.col("event_id").alias("document_id"), F.format_string("Event %s (%d): %s", F.coalesce("name", F.lit("")), F.coalesce("year", F.lit(0)), F.coalesce("description", F.lit(""))).alias("fact"))
    expanded = found.where("nth <= expanded")
    part = tools.participants_of(expanded, edges, bound)
    part = expanded.join(part, "event_id").join(vertices.select("v_type", "v_id", F.col("name").alias("who")), ["v_type", "v_id"], "left")
    of = part.select(F.col("qid").alias("run"), F.struct(F.lit(1).alias("part"), "nth", F.col("v_id").alias("p")).alias("o"), F.concat_ws(":", "v_type", "v_id").alias("source_id"), F.col("event_id").alias("document_id"), F.format_string("%s %s participated in event %s", "v_type", F.coalesce("who", F.col("v_id")), "event_id").alias("fact"), "who")
    seq = F.row_number().over(Window.partitionBy("run").orderBy("o", "source_id")) + F.lit(first)
    own, of = own.withColumn("who", F.lit("")), of.withColumn("who", F.coalesce(F.nullif("who", F.lit("")), F.substring_index("source_id", ":", -1)))
    return own.unionByName(of).select("run", seq.alias("seq"), F.lit("graph").alias("source_type"), "source_id", "document_id", "fact", "who")


def _asked_once(asked: DataFrame, seeds: DataFrame, apart: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(same, asked, seeds): ``run, as_run``, which names for each run the one that stands for it; questions ``qid, question, list`` of those; and the distinct lists of seeds ``list, chunk_id, similarity, rank``.

    Runs are the same if their questions and their seeds are; none are if they are to be kept ``apart``. A list is named by its length and the sums of two hashes of its rows.
    """
    hashes = [F.xxhash64(F.lit(k), "rank", "chunk_id", "similarity") for k in (1, 2)]
    halves = [F.sum(half) for h in hashes for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    lists = seeds.groupBy("qid").agg(F.concat_ws(":", F.count(F.lit(1)), *halves).alias("list"))
    keyed = asked.select("qid", "question").join(lists, "qid", "left").select("qid", "question", F.coalesce("list", F.lit("")).alias("list"))
    keyed = tables.written(keyed)
    if apart:
        once, same = keyed, keyed.select(F.col("qid").alias("run"), F.col("qid").alias("as_run"))
    else:
        once = tables.written(keyed.groupBy("question", "list").agg(F.min("qid").alias("qid")).select("qid", "question", "list"))
        of = once.select(F.col("qid").alias("as_run"), F.col("question").alias("_question"), F.col("list").alias("_list"))
        same = tables.written(keyed.join(of, F.col("question").eqNullSafe(F.col("_question")) & (F.col("list") == F.col("_list"))).select(F.col("qid").alias("run"), "as_run"))
    first = once.where("list <> ''").groupBy("list").agg(F.min("qid").alias("qid"))
    return same, once, tables.written(seeds.join(first, "qid").select("list", "chunk_id", "similarity", "rank"))


def _expanded(asked: DataFrame, seeds: DataFrame, edges: DataFrame | Adjacency, limits: Limits) -> DataFrame:
    """Fused evidence of questions ``qid, question, list``, numbered from the best: ``qid, nth, chunk_id, doc_id, score, source``.

    It depends on the seeds and on what the gate makes of a question: each list of seeds is expanded once for each pattern that asks for it.
    """
    kinds = asked.select("qid", "question", "list", expansion.relational(F.col("question")).alias("kind"))
    once = tables.written(kinds.groupBy("list", "kind").agg(F.min(F.struct("qid", "question")).alias("r")).select("list", "kind", "r.*"))
    found = expansion.evidence_of(once.select("qid", "question"), once.select("qid", "list").join(seeds, "list").drop("list"), edges, limits)
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("chunk_id").desc()))
    found = found.select("qid", nth.alias("nth"), "chunk_id", "doc_id", "score", "source").join(once.select("qid", "list", "kind"), "qid").drop("qid")
    return kinds.select("qid", "list", "kind").join(tables.written(found), ["list", "kind"]).drop("list", "kind")


def _evidence_items(found: DataFrame, first: int, most: int | None) -> DataFrame:
    """Fused evidence as ledger items, best first."""
    rows = found if most is None else found.where(F.col("nth") <= most)
    return rows.select(F.col("qid").alias("run"), (F.col("nth") + first).alias("seq"), F.when(F.col("source") == "seed", "vector").otherwise("graph").alias("source_type"), F.col("chunk_id").alias("source_id"), F.col("doc_id").alias("document_id"), F.format_string("Evidence for %s score=%.4f", "doc_id", "score").alias("fact"))


def _ranked(items: DataFrame, order: Column) -> DataFrame:
    """Distinct documents of a run in order: ``run, document_id, rank``."""
    first = items.where(F.coalesce("document_id", F.lit("")) != "").groupBy("run", "document_id").agg(F.min(order).alias("o"))
    return first.select("run", "document_id", F.row_number().over(Window.partitionBy("run").orderBy("o", "document_id")).alias("rank"))


def repair(verdicts: DataFrame, asked: DataFrame, kept: DataFrame, seeds: DataFrame, vertices: DataFrame, edges: DataFrame | Adjacency, limits: Limits = Limits(), budget: int = evidence.MAX_REPAIRS, ascii_only: bool = False, cut: Callable[..., DataFrame] = tables.cut) -> tuple[DataFrame, DataFrame]:
    """(items, runs): what one bounded repair recovers for runs with verdict REPAIR_REQUIRED, as ledger items after those of ``kept``, and ``run, plan, recovered``.

    Questions that name a venue get the events held there (in the asked year) and their participants; a run that this gives nothing gets the
    expansion of its first seeds. Without a budget nothing is repaired. asked: analysed questions with the ``list`` of their seeds ``list, chunk_id, similarity, rank``.
    """
    granted = evidence.repairs(verdicts, F.lit(budget)).select("run")
    wanted = cut(asked.join(granted, asked["qid"] == granted["run"], "left_semi").select("qid", "question", "list", "year", F.when(F.col("repair_venue").isNotNull(), vertex_id("venue", F.col("repair_venue"), ascii_only)).alias("venue_id")), "wanted")
    after = kept.groupBy("run").agg(F.max("seq").alias("last"))
    composite = cut(_event_facts(venue_events(wanted.where("venue_id IS NOT NULL").select("qid", "venue_id", "year"), vertices, edges), vertices, edges, 0), "composite")
    rest = wanted.join(composite.select(F.col("run").alias("qid")).distinct(), "qid", "left_anti")
    expanded = _evidence_items(_expanded(rest, seeds.where(F.col("rank") <= REPAIR_SEEDS), edges, limits), 0, None)
    both = composite.select(*ITEM, F.lit("composite").alias("plan")).unionByName(expanded.select(*ITEM, F.lit("expansion").alias("plan")))
    items = cut(both.join(after, "run", "left").withColumn("seq", F.col("seq") + F.coalesce("last", F.lit(0))).select(*ITEM, "plan"), "recovered")
    counts = items.groupBy("run").agg(F.count(F.lit(1)).alias("recovered"), F.first("plan").alias("plan"))
    runs = wanted.select(F.col("qid").alias("run")).join(counts, "run", "left").select("run", F.coalesce("plan", F.lit("expansion")).alias("plan"), F.coalesce("recovered", F.lit(0)).alias("recovered"))
    return items.select(*ITEM), runs


def orchestrate(asked: DataFrame, seeds: DataFrame, vertices: DataFrame, edges: DataFrame | Adjacency, structured: DataFrame | None = None, limits: Limits = Limits(), budget: int = evidence.MAX_REPAIRS, ascii_only: bool = False, cut: Callable[..., DataFrame] = tables.cut, docs: DataFrame | None = None, order: str = "doc_id") -> dict[str, DataFrame]:
    """Rule-path runs of questions ``qid, question`` with seeds ``qid, chunk_id, similarity, rank``: ``runs, documents, ledger, repairs``, and ``same``.

    Runs with equal questions and seeds are taken once: ``same`` (``run, as_run``) names the run that stands for each. Given ``structured`` rows keep runs apart. Vector questions rank their seeds' documents; relational ones are expanded. Structured ones are asked of the corpus ``docs`` (pages ``doc_id, title, text``, first pages by ``order``): counts,
    superlatives, nation look-ups and predecessors; one that gets no answer takes the events of the venue it names and the pages that its cues ground,
    and falls back to its seeds if there are none. Its candidate is the corpus's answer, else the first participant, else the winner on the first page. Without a
    corpus, ``structured`` rows (``qid, rank, document_id, answer, fact``) stand for its answers, and the candidate is the first answer, else the first document.
    A run that verification sends back is repaired once: its ledger grows, its ledger's documents come first, and it is verified again.
    """
    same, once, lists = _asked_once(asked, seeds, apart=structured is not None)
    analysed = cut(questions.route(once), "routed")
    seeds = analysed.select("qid", "list").join(lists, "list").drop("list")
    of = lambda name: analysed.where(F.col("strategy") == name)
    only = lambda df, name: df.join(of(name).select("qid"), "qid", "left_semi")
    each = lambda df: same.join(df.withColumnRenamed("run", "as_run"), "as_run").drop("as_run")
    empty = asked.sparkSession.createDataFrame([], "qid {0}, rank int, document_id string, answer string, fact string".format(asked.schema["qid"].dataType.simpleString()))
    if docs is not None:
        given = cut(questions.structured_answers(of("structured"), docs, order), "given")
        open_ = of("structured").join(given.select("qid").distinct(), "qid", "left_anti")
        grounded = cut(questions.grounded_at_venue(open_.select("qid", "venue", "date", "year"), docs, order), "grounded")
    else:
        given, open_, grounded = empty if structured is None else only(structured, "structured"), of("structured"), empty

    # structured: the corpus's answers, then the venue's events, then grounded pages
    shift, last = F.lit(1_000_000), F.lit(1_000_000_000)
    asks = lambda rows, kind: rows.select(F.col("qid").alias("run"), F.col("rank").alias("seq"), F.lit("structured").alias("source_type"), F.concat(F.lit(kind), "document_id").alias("source_id"), "document_id", "fact", "answer")
    given, grounded = asks(given, "Structured:" if docs is None else "Event:"), asks(grounded, "Event:").withColumn("seq", F.col("seq") + last)
    named = open_.where("venue IS NOT NULL").select("qid", vertex_id("venue", F.col("venue"), ascii_only).alias("venue_id"), "year", *([] if docs is None else ["date"]))
    held = _event_facts(venue_events(named, vertices, edges, ascii_only), vertices, edges, 0)
    found = cut(held.withColumn("seq", F.col("seq") + shift), "found")
    answered = given.select("run").union(found.select("run")).union(grounded.select("run")).distinct()
    plain = of("vector").select("qid").union(of("structured").select("qid").join(answered.select(F.col("run").alias("qid")), "qid", "left_anti"))
    near = seeds.join(plain, "qid", "left_semi")
    vector = near.select(F.col("qid").alias("run"), F.col("rank").alias("seq"), F.lit("vector").alias("source_type"), F.col("chunk_id").alias("source_id"), doc_of_chunk(F.col("chunk_id")).alias("document_id"), F.concat(F.lit("Chunk "), "chunk_id").alias("fact"))
    fused = cut(_expanded(of("expansion"), lists, edges, limits), "evidence")

    graph = given.where("document_id IS NOT NULL").select(*ITEM).unionByName(found.select(*ITEM)).unionByName(grounded.select(*ITEM))
    fallback = F.lit(TAKEN) if docs is None else F.when(F.col("strategy") == "vector", TAKEN).otherwise(FALLBACK)
    taken = vector.join(analysed.select(F.col("qid").alias("run"), fallback.alias("most")), "run").where("seq <= most")
    items = cut(graph.unionByName(taken.select(*ITEM)).unionByName(_evidence_items(fused, 0, TAKEN)), "items")
    every = graph.unionByName(vector.select(*ITEM)).unionByName(_evidence_items(fused, 0, None))
    ranked = cut(_ranked(every, F.col("seq")), "ranked")
    said_by = given.select("run", "seq", "answer").unionByName(grounded.select("run", "seq", "answer"))
    if docs is not None:
        said_by = said_by.unionByName(found.select("run", "seq", F.col("who").alias("answer")))
    answers = said_by.where(F.coalesce("answer", F.lit("")) != "").groupBy("run").agg(F.min_by("answer", "seq").alias("answer"))
    top = ranked.where("rank = 1").select("run", F.col("document_id").alias("top"))
    runs = analysed.select(F.col("qid").alias("run"), "question", "strategy").join(answers, "run", "left").join(top, "run", "left")
    document = F.when((F.col("strategy") != "structured") | F.lit(docs is None), F.col("top"))
    runs = cut(runs.select("run", "question", "strategy", F.coalesce("answer", document, F.lit("")).alias("answer")), "said")

    kept = cut(evidence.ledger(items, checked=True), "kept")
    verdicts = cut(evidence.verify(runs, kept, ascii_only).select("run", "n_facts", "verdict", "focus"), "verdicts")
    more, repaired = repair(verdicts, analysed, kept, lists, vertices, edges, limits, budget, ascii_only, cut)
    repaired = cut(repaired, "repaired")
    whole = cut(evidence.ledger(items.unionByName(more), checked=True), "whole")
    mended = whole.join(repaired.select("run"), "run", "left_semi")
    again = evidence.verify(runs.join(repaired.select("run"), "run", "left_semi"), mended, ascii_only).select("run", "n_facts", "verdict")
    final = verdicts.join(repaired.select("run"), "run", "left_anti").select("run", "n_facts", "verdict").unionByName(again)
    behind = ranked.join(repaired.select("run"), "run", "left_anti").select("run", "document_id", "rank")
    documents = behind.unionByName(evidence.rerank(evidence.ledger_documents(mended), ranked.join(repaired.select("run"), "run", "left_semi")))
    out = runs.select("run", "strategy", F.col("answer").alias("candidate")).join(verdicts.select("run", F.col("verdict").alias("first_verdict")), "run").join(final, "run").join(repaired, "run", "left")
    out = out.withColumn("model", F.lit("")).withColumn("answer", evidence.final_answer()).drop("model")
    return {"runs": each(out), "documents": each(documents), "ledger": each(whole), "repairs": each(repaired), "same": same}
