"""Gated, bounded graph expansion of seeds, fusion and document ranking, for all queries at once.

"The first n edges" means the n smallest target ids. Edge tables are ``src_type, src_id, edge_type, dst_type, dst_id``; they may be adjacencies, whose edges are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.layout import Adjacency, all_edges, per_key
from ..sources.tables import cut

#: Patterns of relational questions, in the order that decides the reason.
RELATIONAL = [
    r"\bheld at\b",
    r"\bevent held\b",
    r"\bvenue\b",
    r"\brepresented\b",
    r"\bwhich country did\b",
    r"\bwhich nation did\b",
    r"\bwho (?:won|competed|participated) in the event held\b",
    r"\bwho (?:won|competed|participated) .* held at\b",
    r"\bwho won the gold medal in the event\b",
]


@dataclass(frozen=True)
class Limits:
    """Fixed values of the expansion."""

    top_k: int = 20
    seeds: int = 5
    entities: int = 5
    vertices: int = 5
    person_events: int = 5
    venue_events: int = 10
    chunks: int = 20
    decay: float = 0.90
    reinforcement: float = 0.05
    confidence: float = 0.72
    margin: float = 0.015
    margin_ceiling: float = 0.80
    gating: bool = True


def relational(question: Column) -> Column:
    """The number of the first relational pattern that a question fits, 0 if it fits none."""
    return F.coalesce(*(F.when(question.rlike("(?i)" + pattern), k) for k, pattern in enumerate(RELATIONAL, 1)), F.lit(0))


def gate(questions: DataFrame, seeds: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``qid, expand, reason`` for questions ``qid, question`` and seeds ``qid, similarity, rank``."""
    tops = seeds.where("rank <= 2").groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("similarity"))).alias("second"))
    rows = questions.join(tops, "qid", "left").withColumn("gap", F.when(F.col("second").isNull(), F.lit(1.0)).otherwise(F.round(F.col("top") - F.col("second"), 9)))
    reason = F.lit("") if limits.gating else F.lit("gating_disabled")
    kind = relational(F.col("question"))
    cases = F.when(F.lit(not limits.gating), reason).when(kind > 0, F.concat(F.lit("relational_"), kind.cast("string")))
    cases = cases.when(F.col("top").isNull(), "no_seeds").when(F.col("top") < limits.confidence, "low_confidence").when((F.col("gap") < limits.margin) & (F.col("top") < limits.margin_ceiling), "low_margin").otherwise("vector_only")
    return rows.select("qid", cases.alias("reason")).withColumn("expand", F.col("reason") != "vector_only").select("qid", "expand", "reason")


def capped(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def _edges(edges: DataFrame, kind: str, *src: str) -> DataFrame:
    rows = edges.where(F.col("edge_type") == kind)
    return rows.where(F.col("src_type").isin(list(src))) if src else rows


def _of_asked(edges: DataFrame | Adjacency, end: str, asked: DataFrame, rows: Callable[[DataFrame], DataFrame], keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` distinct ``rows`` of each key that ``asked`` holds: many questions ask for one key, and the edges of other keys are neither sorted nor shuffled."""
    ids = cut(asked.select(*keys).distinct())
    return per_key(edges, end, lambda e: capped(rows(e).join(ids, keys, "left_semi").distinct(), keys, order, n))


def hop_entities(seeds: DataFrame, edges: DataFrame | Adjacency, limits: Limits = Limits()) -> DataFrame:
    """Seeds ``qid, chunk_id, similarity, rank`` to their entities: the first seeds, and the first mentions of each."""
    first = seeds.where(F.col("rank") <= limits.seeds)
    mentions = lambda e: _edges(e, "MENTIONS", "Chunk").select(F.col("src_id").alias("chunk_id"), F.col("dst_id").alias("entity_id"))
    listed = _of_asked(edges, "out", first, mentions, ["chunk_id"], [F.col("entity_id")], limits.entities)
    return first.join(listed, "chunk_id").select("qid", "chunk_id", "similarity", "rank", "entity_id")


def hop_vertices(entities: DataFrame, edges: DataFrame | Adjacency, limits: Limits = Limits()) -> DataFrame:
    """Entities to the domain vertices they resolve to."""
    resolved = lambda e: _edges(e, "RESOLVES_TO", "Entity").select(F.col("src_id").alias("entity_id"), F.col("dst_type").alias("v_type"), F.col("dst_id").alias("v_id"))
    return entities.join(cut(_of_asked(edges, "out", entities, resolved, ["entity_id"], [F.col("v_id"), F.col("v_type")], limits.vertices)), "entity_id")


def hop_events(vertices: DataFrame, edges: DataFrame | Adjacency, limits: Limits = Limits()) -> DataFrame:
    """Domain vertices to events, with hop count and provenance. Sports and countries are hubs and are not expanded."""
    arrow = lambda *c: F.concat_ws(" -> ", *c)
    named = lambda kind, c: F.concat(F.lit(kind + " "), c)
    start = [F.col("chunk_id"), F.col("entity_id")]
    direct = vertices.where("v_type = 'Event'").select("*", F.col("v_id").alias("event_id"), F.lit(1).alias("hop"), arrow(*start, named("Event", F.col("v_id"))).alias("prov"))
    took_part = lambda e: _edges(e, "PARTICIPATED_IN", "Person", "Team").select(F.col("src_type").alias("v_type"), F.col("src_id").alias("v_id"), F.col("dst_id").alias("event_id"))
    held = lambda e: _edges(e, "HELD_AT", "Event").select(F.lit("Venue").alias("v_type"), F.col("dst_id").alias("v_id"), F.col("src_id").alias("event_id"))
    key, first = ["v_type", "v_id"], [F.col("event_id")]
    by_person = cut(_of_asked(edges, "out", vertices.where("v_type IN ('Person', 'Team')"), took_part, key, first, limits.person_events))
    by_venue = cut(_of_asked(edges, "into", vertices.where("v_type = 'Venue'"), held, key, first, limits.venue_events))
    by_way = vertices.join(by_person.unionByName(by_venue), key).select(*vertices.columns, "event_id", F.lit(2).alias("hop"), arrow(*start, F.concat_ws(" ", "v_type", "v_id"), named("Event", F.col("event_id"))).alias("prov"))
    return direct.unionByName(by_way)


def derived_chunks(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """An event's first chunk as evidence, but for the seed itself; the similarity decays by hop."""
    target = F.concat(F.col("event_id"), F.lit("#c0000"))
    score = F.col("similarity") * F.pow(F.lit(limits.decay), F.col("hop"))
    return events.withColumn("target", target).where("target <> chunk_id").select(
        "qid", F.col("target").alias("derived_id"), F.col("event_id").alias("doc_id"), F.round(score, 9).alias("score"), "hop", F.col("chunk_id").alias("seed"), F.col("rank").alias("seed_rank"),
        F.concat(F.col("prov"), F.lit(" -> Chunk "), F.col("target")).alias("prov"),
    )


def merge_derived(derived: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row a query and chunk: best score (the earlier seed on ties), provenance in seed order; the best chunks, ties by larger id."""
    order = F.struct("score", (-F.col("seed_rank")).alias("r"), (-F.col("hop")).alias("h"))
    merged = derived.groupBy("qid", "derived_id").agg(
        F.max("score").alias("score"),
        F.max_by("hop", order).alias("hop"),
        F.max_by("seed", order).alias("seed"),
        F.min("doc_id").alias("doc_id"),
        F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("seed_rank", "prov"))), lambda x: x["prov"])).alias("provenance"),
    )
    return capped(merged, ["qid"], [F.col("score").desc(), F.col("derived_id").desc()], limits.chunks)


def expand(seeds: DataFrame, edges: DataFrame | Adjacency, limits: Limits = Limits()) -> DataFrame:
    return merge_derived(derived_chunks(hop_events(hop_vertices(cut(hop_entities(seeds, edges, limits)), edges, limits), edges, limits), limits), limits)


def fuse(seeds: DataFrame, graph: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Seeds and derived chunks as one evidence list; a chunk in both gains a share of its graph score."""
    s = seeds.select("qid", F.col("chunk_id").alias("c"), F.col("similarity").alias("sim"), F.substring_index("chunk_id", "#", 1).alias("sdoc"))
    g = graph.select("qid", F.col("derived_id").alias("c"), F.col("score").alias("gs"), F.col("doc_id").alias("gdoc"), "provenance", "hop")
    both = F.col("sim").isNotNull() & F.col("gs").isNotNull()
    own = F.when(F.col("sim").isNotNull(), F.array(F.concat(F.lit("seed "), F.col("c")))).otherwise(F.array().cast("array<string>"))
    return s.join(g, ["qid", "c"], "full_outer").select(
        "qid",
        F.col("c").alias("chunk_id"),
        F.coalesce("sdoc", "gdoc").alias("doc_id"),
        F.round(F.when(both, F.col("sim") + limits.reinforcement * F.col("gs")).otherwise(F.coalesce("sim", "gs")), 6).alias("score"),
        F.when(both, "seed+graph").when(F.col("sim").isNotNull(), "seed").otherwise("graph").alias("source"),
        F.when(F.col("sim").isNotNull(), 0).otherwise(F.col("hop")).alias("hop"),
        F.array_union(own, F.coalesce("provenance", F.array().cast("array<string>"))).alias("provenance"),
    )


def rank_documents(evidence: DataFrame) -> DataFrame:
    """Best evidence a document, ties by larger id; blank ids are left out."""
    best = evidence.where(F.coalesce("doc_id", F.lit("")) != "").groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").desc())))


def paths(entities: DataFrame, vertices: DataFrame, edges: DataFrame | Adjacency, limits: Limits = Limits(), events: DataFrame | None = None) -> DataFrame:
    """The steps that an expansion took, distinct: ``qid, source, edge, target, hop, step``; ``events`` as ``hop_events`` gives them, if they are at hand."""
    step = lambda df, st, sid, kind, tt, tid, hop: df.select("qid", F.concat_ws(" ", st, sid).alias("source"), F.lit(kind).alias("edge") if isinstance(kind, str) else kind.alias("edge"), F.concat_ws(" ", tt, tid).alias("target"), F.lit(hop).alias("hop"))
    context = all_edges(edges).where("edge_type IN ('BELONGS_TO', 'HELD_AT', 'REPRESENTS')").select(F.col("src_type").alias("v_type"), F.col("src_id").alias("v_id"), "edge_type", "dst_type", "dst_id")
    context = context.join(vertices.select("v_type", "v_id").distinct(), ["v_type", "v_id"], "left_semi")
    events = (hop_events(vertices, edges, limits) if events is None else events).where("hop = 2")
    way = F.when(F.col("v_type") == "Venue", "reverse_HELD_AT").otherwise("PARTICIPATED_IN")
    rows = reduce(
        DataFrame.unionByName,
        [
            step(entities, F.lit("Chunk"), F.col("chunk_id"), "MENTIONS", F.lit("Entity"), F.col("entity_id"), 1),
            step(vertices, F.lit("Entity"), F.col("entity_id"), "RESOLVES_TO", F.col("v_type"), F.col("v_id"), 1),
            step(vertices.join(context, ["v_type", "v_id"]), F.col("v_type"), F.col("v_id"), F.col("edge_type"), F.col("dst_type"), F.col("dst_id"), 2),
            step(events, F.col("v_type"), F.col("v_id"), way, F.lit("Event"), F.col("event_id"), 2),
        ],
    ).distinct()
    return rows.withColumn("step", F.format_string("(%s) -[%s]-> (%s)", "source", "edge", "target"))


STATS = ["num_seeds", "num_entities", "num_domain_vertices", "num_graph_paths", "num_graph_derived_chunks", "num_total_evidence_chunks", "num_ranked_docs"]


def _expanded(questions: DataFrame, seeds: DataFrame, edges: DataFrame | Adjacency, limits: Limits, top_k: int | None) -> tuple[DataFrame, ...]:
    """The steps of ``retrieve`` up to the evidence: seeds, decisions, entities, vertices, events, derived chunks, evidence."""
    seeds = cut(seeds.where(F.col("rank") <= (top_k or limits.top_k)))
    decision = cut(gate(questions, seeds, limits))
    chosen = cut(seeds.where(F.col("rank") <= limits.seeds).join(decision.where("expand").select("qid"), "qid", "left_semi"))
    entities = cut(hop_entities(chosen, edges, limits))
    vertices = hop_vertices(entities, edges, limits)
    events = hop_events(vertices, edges, limits)
    graph = merge_derived(derived_chunks(events, limits), limits)
    return seeds, decision, entities, vertices, events, graph, fuse(seeds, graph, limits)


def evidence_of(questions: DataFrame, seeds: DataFrame, edges: DataFrame | Adjacency, limits: Limits = Limits()) -> DataFrame:
    """The evidence of ``retrieve`` alone."""
    return _expanded(questions, seeds, edges, limits, None)[-1]


def retrieve(questions: DataFrame, seeds: DataFrame, edges: DataFrame | Adjacency, limits: Limits = Limits(), top_k: int | None = None) -> dict[str, DataFrame]:
    """Gate, expand, fuse and rank: ``gate, evidence, documents, stats``, and what the expansion met: ``entities, vertices, paths, expansion_stats``.

    Questions that aren't expanded keep their seeds. The first ``top_k`` seeds are used, those of the limits where it is missing or 0.
    """
    seeds, decision, entities, vertices, events, graph, evidence = _expanded(questions, seeds, edges, limits, top_k)
    documents = rank_documents(evidence)
    counts = evidence.groupBy("qid").agg(F.count(F.lit(1)).alias("n_evidence"), F.count_if(F.col("source") == "seed").alias("n_seed"), F.count_if(F.col("source") == "graph").alias("n_graph"), F.count_if(F.col("source") == "seed+graph").alias("n_both"))
    met = {"entities": entities.select("qid", "entity_id").distinct(), "vertices": vertices.select("qid", "v_type", "v_id").distinct(), "paths": paths(entities, vertices, edges, limits, events)}
    each = zip(STATS, (seeds, met["entities"], met["vertices"], met["paths"], graph, evidence, documents), strict=True)
    counted = reduce(DataFrame.unionByName, [rows.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).withColumn("stat", F.lit(name)) for name, rows in each])
    wide = counted.groupBy("qid").agg(*(F.max(F.when(F.col("stat") == name, F.col("n"))).alias(name) for name in STATS))
    expansion_stats = decision.select("qid", F.col("expand").alias("is_graph_expanded")).join(wide, "qid", "left").na.fill(0)
    return {"gate": decision, "evidence": evidence, "documents": documents, "stats": decision.join(counts, "qid", "left").na.fill(0), **met, "expansion_stats": expansion_stats}
