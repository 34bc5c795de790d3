"""Evidence ledger, verification, repair, run state and answers, for many runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import normalized
from .questions import YEAR

#: Kinds of sources, and limits of a run.
SOURCES = ["vector", "graph", "structured"]
MAX_TOOL_CALLS, MAX_REPAIRS = 15, 1


def ledger(items: DataFrame, checked: bool = False) -> DataFrame:
    """First write of a source id in a run stays: adds ``evidence_id`` to ``run, seq, source_type, source_id, document_id``. Raises on an unknown source type, for which the rows are read once more unless they are ``checked``."""
    if not checked and items.where(~F.coalesce(F.col("source_type"), F.lit("")).isin(SOURCES)).take(1):
        raise ValueError(f"a source type is one of {SOURCES}")
    rest = [c for c in items.columns if c not in ("run", "source_id")]
    kept = items.groupBy("run", "source_id").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("run", "source_id", "r.*")
    n = F.row_number().over(Window.partitionBy("run").orderBy("seq", "source_id"))
    return kept.withColumn("evidence_id", F.format_string("ev-%04d", n))


def ledger_documents(kept: DataFrame) -> DataFrame:
    """Distinct documents of a run in ledger order: ``run, document_id, position``."""
    first = kept.where("document_id IS NOT NULL").groupBy("run", "document_id").agg(F.min("seq").alias("seq"))
    return first.select("run", "document_id", F.row_number().over(Window.partitionBy("run").orderBy("seq", "document_id")).alias("position"))


def verify(candidates: DataFrame, facts: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Verdicts of ``run, question, answer`` against facts ``run, evidence_id, fact``.

    Returns ``run, n_facts, missing_years, grounded, supporting, verdict, focus``. Grounded: one fact holds the whole normalized answer, or all
    its tokens of three characters or with a digit; an empty answer is, once there is a fact. Every 19xx/20xx year of the question must
    stand in some fact.
    """
    norm = lambda c: normalized(c, ascii_only)
    answer = norm(F.coalesce("answer", F.lit("")))
    tokens = F.filter(F.split(answer, " "), lambda t: (F.length(t) > 2) | t.rlike("[0-9]"))
    ask = candidates.select("run", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"), answer.alias("a"), tokens.alias("tokens"), F.array_distinct(F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit(YEAR), F.lit(1))).alias("years"))
    # facts are shuffled as they are, and normalized where they meet their answer
    rows = ask.join(facts.select("run", "evidence_id", "fact", F.lit(True).alias("is_fact")), "run", "left")
    rows = rows.withColumn("f", F.when(F.col("is_fact"), norm(F.coalesce("fact", F.lit("")))))
    whole = F.col("f").contains(F.col("a"))
    all_tokens = (F.size("tokens") > 0) & F.forall("tokens", lambda t: F.col("f").contains(t))
    found = rows.groupBy("run", "answer", "years").agg(
        F.count("f").alias("n_facts"),
        F.coalesce(F.bool_or(whole | all_tokens), F.lit(False)).alias("hit"),
        F.array_sort(F.collect_set(F.when(whole, F.col("evidence_id")))).alias("supporting"),
        F.array_distinct(F.flatten(F.collect_set(F.filter("years", lambda y: F.coalesce(F.col("fact"), F.lit("")).contains(y))))).alias("seen"),
    )
    grounded = F.when(F.col("answer") == "", F.col("n_facts") > 0).otherwise(F.col("hit"))
    rows = found.withColumns({"grounded": grounded, "missing_years": F.size(F.array_except("years", "seen"))})
    unsupported = ~F.col("grounded") & (F.col("answer") != "")
    complete = (F.col("missing_years") == 0) & ~unsupported & (F.col("n_facts") > 0)
    verdict = F.when(complete, "SUPPORTED").when(unsupported | (F.col("missing_years") > 0), "REPAIR_REQUIRED").otherwise("INSUFFICIENT")
    focus = F.when(complete, F.lit(None)).when(unsupported, "retrieve_missing_gold_document").when(F.col("missing_years") > 0, "filter_by_year_constraint")
    return rows.select("run", "n_facts", "missing_years", "grounded", "supporting", verdict.alias("verdict"), focus.alias("focus"))


def repairs(verdicts: DataFrame, budget: Column | None = None) -> DataFrame:
    """Runs that one bounded repair is granted: ``run, focus, plan``; verdicts may carry ``venue``. No budget, no repair."""
    left = F.lit(MAX_REPAIRS) if budget is None else budget
    venue = F.col("venue") if "venue" in verdicts.columns else F.lit(None).cast("string")
    return verdicts.where((F.col("verdict") == "REPAIR_REQUIRED") & (left > 0)).select("run", "focus", F.when(venue.isNotNull(), "composite").otherwise("expansion").alias("plan"))


def rerank(ledger_docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """After a repair the ledger's documents come first, then the old ranking, each once: ``run, document_id, rank``."""
    a = ledger_docs.select("run", "document_id", F.struct(F.lit(0).alias("part"), F.col("position").cast("long").alias("p")).alias("o"))
    b = ranked.select("run", "document_id", F.struct(F.lit(1).alias("part"), F.col("rank").cast("long").alias("p")).alias("o"))
    first = a.unionByName(b).groupBy("run", "document_id").agg(F.min("o").alias("o"))
    return first.select("run", "document_id", F.row_number().over(Window.partitionBy("run").orderBy("o", "document_id")).alias("rank"))


def phases(log: DataFrame, max_tools: int = MAX_TOOL_CALLS, max_repairs: int = MAX_REPAIRS, sticky: bool = False) -> DataFrame:
    """The phase after each event of a log ``run, seq, kind, payload``: adds tools, repairs and phase.

    The phase is that of the last event that sets one; calls within the budget don't. A failure is overwritten by later
    events unless ``sticky``.
    """
    w = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).over(w)
    rows = log.withColumns({"tools": counted("TOOL_CALLED"), "repairs": counted("REPAIR_ATTEMPTED")})
    own = (
        F.when(F.col("kind") == "STRATEGY_CHOSEN", "STRATEGY_SELECTED")
        .when((F.col("kind") == "TOOL_CALLED") & (F.col("tools") > max_tools), "FAILED")
        .when(F.col("kind") == "EVIDENCE_ADDED", "EVIDENCE_ACCUMULATED")
        .when(F.col("kind") == "ANSWER_PROPOSED", "VERIFYING")
        .when(F.col("kind") == "REPAIR_ATTEMPTED", F.when(F.col("repairs") > max_repairs, "FAILED").otherwise("REPAIRING"))
        .when(F.col("kind") == "EXECUTION_COMPLETED", "COMPLETED")
        .when(F.col("kind") == "EXECUTION_FAILED", "FAILED")
    )
    rows = rows.withColumn("own", own).withColumn("phase", F.coalesce(F.last("own", ignorenulls=True).over(w), F.lit("INITIALIZED")))
    if sticky:
        rows = rows.withColumn("phase", F.when(F.max(F.col("own") == "FAILED").over(w), "FAILED").otherwise(F.col("phase")))
    return rows.drop("own")


def run_states(log: DataFrame, max_tools: int = MAX_TOOL_CALLS, max_repairs: int = MAX_REPAIRS, sticky: bool = False) -> DataFrame:
    """Final state of each run: ``run, events, phase, tools, repairs, evidence, skills, strategy, answer, failures, terminal``. Raises on an unknown strategy."""
    if log.where((F.col("kind") == "STRATEGY_CHOSEN") & ~F.coalesce(F.col("payload"), F.lit("")).isin("vector", "expansion", "structured", "repair", "auto")).take(1):
        raise ValueError("unknown strategy")
    rows = phases(log, max_tools, max_repairs, sticky)
    last = lambda kind: F.max_by("payload", F.when(F.col("kind") == kind, F.col("seq")))
    only = lambda kind: F.when(F.max(F.when(F.col("kind") == kind, 1)).isNotNull(), last(kind))
    return rows.groupBy("run").agg(
        F.count(F.lit(1)).alias("events"),
        F.max_by("phase", "seq").alias("phase"),
        F.max("tools").alias("tools"),
        F.max("repairs").alias("repairs"),
        F.countDistinct(F.when(F.col("kind") == "EVIDENCE_ADDED", F.col("payload"))).alias("evidence"),
        F.countDistinct(F.when(F.col("kind") == "SKILL_ACTIVATED", F.col("payload"))).alias("skills"),
        only("STRATEGY_CHOSEN").alias("strategy"),
        only("ANSWER_PROPOSED").alias("answer"),
        F.count_if(F.col("phase") == "FAILED").alias("failures"),
    ).withColumn("terminal", F.col("phase").isin("COMPLETED", "FAILED"))


def answers(runs: DataFrame) -> DataFrame:
    """The final answer of ``run, candidate, model, verdict, n_facts``, as ``final_answer`` gives it."""
    return runs.select("run", final_answer().alias("answer"))


def final_answer() -> Column:
    """The final answer of a row with ``candidate, model, verdict, n_facts``: a number stays unless the model's text holds it; otherwise the model's text if it is one; none without evidence."""
    none = "INSUFFICIENT_EVIDENCE"
    c, m = F.coalesce("candidate", F.lit("")), F.coalesce("model", F.lit(""))
    usable = (m != "") & ~m.startswith("Q")
    number = F.when((m != "") & m.contains(c), m).otherwise(c)
    text = F.when(usable & (F.length(F.btrim(m)) > 3), m).otherwise(c)
    answer = F.when((c != "") & (c != none), F.when(c.rlike("^[0-9]+$"), number).otherwise(text)).when(usable, m).otherwise(c)
    return F.when((F.col("verdict") == "INSUFFICIENT") & (F.col("n_facts") == 0), none).otherwise(answer)
