"""Retrieval metrics, reports, run comparison, answer scoring and traces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .ordering import exact_percentiles


def first_gold_rank(queries: DataFrame, ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """``queries`` with ``first_rank`` (1-based; null for a miss) from ranked ``qid, id, rank`` and gold ``qid, id``."""
    hits = ranked.join(gold.select("qid", "id").distinct(), ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("first_rank"))
    return queries.join(hits, "qid", "left")


def hit(first_rank: Column, k: int) -> Column:
    return F.coalesce(first_rank <= k, F.lit(False)) if k > 0 else F.lit(False)


def metric_columns(ks: tuple[int, ...] = (1, 5, 10, 20), digits: int = 6) -> list[Column]:
    rate = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), digits)
    return [F.count(F.lit(1)).alias("n"), *(rate(hit(F.col("first_rank"), k).cast("double")).alias(f"recall_{k}") for k in ks), rate(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr")]


def metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Hit rates and mean reciprocal rank; 0 without queries."""
    return ranks.agg(*metric_columns(ks))


def metrics_by(ranks: DataFrame, key: str, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """The metrics of each group and over all (key null, ``is_total`` 1)."""
    return ranks.rollup(key).agg(F.grouping(key).cast("int").alias("is_total"), *metric_columns(ks))


def latencies(df: DataFrame, key: str, value: str, digits: int = 6) -> DataFrame:
    """Mean and exact, linearly interpolated percentiles by key; a key with many distinct values doesn't meet in one task."""
    found = exact_percentiles(df, key, value, (0.5, 0.95, 0.99)).withColumnRenamed(key, "_key")
    p = lambda x: F.round(F.max(F.when(F.col("share") == x, F.col("percentile"))), digits)
    wide = found.groupBy("_key").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))
    means = df.groupBy(key).agg(F.count(value).alias("n"), F.round(F.avg(value), digits).alias("mean"))
    return means.join(wide, means[key].eqNullSafe(wide["_key"]), "left").drop("_key")


def compare_runs(a: DataFrame, b: DataFrame, key: str, values: list[str], digits: int = 6) -> DataFrame:
    """Values of two runs side by side with their difference, long: ``key, metric, a, b, diff``; rows that one run lacks stay with nulls."""
    long = lambda df, name: df.select(key, F.explode(F.map_from_arrays(F.array(*(F.lit(v) for v in values)), F.array(*(F.col(v).cast("double") for v in values)))).alias("metric", name))
    return long(a, "a").join(long(b, "b"), [key, "metric"], "full_outer").withColumn("diff", F.round(F.col("b") - F.col("a"), digits))


def merge_runs(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both runs by key; the new run's row wins."""
    return new.withColumn("origin", F.lit("new")).unionByName(old.join(new.select(key), key, "left_anti").withColumn("origin", F.lit("old")))


def audit(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: counts, distinct keys and keys that only one run has."""
    side = lambda df, name: df.agg(F.count(F.lit(1)).alias(f"n_{name}"), F.countDistinct(key).alias(f"keys_{name}")).withColumn("one", F.lit(1))
    only = lambda x, y, name: x.select(key).distinct().join(y.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias(f"only_{name}")).withColumn("one", F.lit(1))
    tables = [side(a, "a"), side(b, "b"), only(a, b, "a"), only(b, a, "b")]  # of one row each
    rows = reduce(lambda x, y: x.join(y, "one"), tables).drop("one")
    return rows.withColumn("same", (F.col("n_a") == F.col("n_b")) & (F.col("n_a") == F.col("keys_a")) & (F.col("n_b") == F.col("keys_b")) & (F.col("only_a") + F.col("only_b") == 0))


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    """Counts of each categorical column, long: ``category, value, n``."""
    one = F.explode(F.array(*(F.struct(F.lit(k).alias("category"), F.col(k).cast("string").alias("value")) for k in keys)))
    return df.select(one.alias("x")).groupBy("x.category", "x.value").agg(F.count(F.lit(1)).alias("n"))


def totals(df: DataFrame, key: str, value: Column, name: str = "tokens", digits: int = 6) -> DataFrame:
    """Calls and sum, mean, least and most of a measure by key."""
    rows = df.withColumn("_v", value)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.sum("_v").alias(name), F.round(F.avg("_v"), digits).alias(f"avg_{name}"), F.min("_v").alias(f"min_{name}"), F.max("_v").alias(f"max_{name}"))


#: How an answer asserts a number, in order.
NUMBER_PATTERNS = [
    r"^(\d+)\s+nations",
    r"there were\s+\*{0,2}(\d+)\*{0,2}\s+",
    r"a total of\s+\*{0,2}(\d+)\*{0,2}\s+nations",
    r"(\d+)\s+nations competed",
    r"featured\s+\*{0,2}(\d+)\*{0,2}\s+competing nations",
    r"featured\s+\*{0,2}(\d+)\*{0,2}\s+nations",
    r"in the \d{4} summer olympics,\s+(\d+)\s+nations competed",
    r"^(\d+)\b",
]
#: Number words up to nineteen, and tens.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = {"twenty": 20, "thirty": 30, "forty": 40}


def number_words() -> dict[str, int]:
    """Words of the numbers from zero to forty; a ten and a one are joined by a hyphen or a blank."""
    joined = {f"{ten}{mark}{ONES[one]}": n + one for ten, n in TENS.items() if n < 40 for one in range(1, 10) for mark in "- "}
    return {word: n for n, word in enumerate(ONES)} | TENS | joined


def comparable(c: Column) -> Column:
    """Lower case, dashes and blanks as one blank, other signs dropped, kilometres shortened."""
    low = F.regexp_replace(F.lower(c), r"[\s\-_–—]+", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}_\s]", ""), r"kilometres?", "km"))


def asserted_number(c: Column) -> Column:
    text = F.btrim(c)
    found = [F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")) for p in NUMBER_PATTERNS]
    return F.coalesce(F.when(text.rlike(r"^[0-9]+$"), text), *found).try_cast("long")


def _void(predicted: Column) -> Column:
    return (predicted == "") | (predicted == "INSUFFICIENT_EVIDENCE") | (predicted.startswith("Q") & (F.length(predicted) <= 10))


#: Questions whose answer must be named in full.
EXACT = ["highest number of competitors", "immediately before"]


def strict_verdict(reference: Column, predicted: Column, question: Column | None = None) -> Column:
    """CONFIRMED_CORRECT, CONFIRMED_INCORRECT or MANUAL_REVIEW, by general rules only. Answers to superlative and predecessor questions are never left to review."""
    p, r = F.coalesce(predicted, F.lit("")), F.coalesce(reference, F.lit(""))
    number, whole = asserted_number(p), F.concat(F.lit(" "), F.regexp_replace(p, r"[^\p{L}\p{N}_]", " "), F.lit(" "))
    numeric = F.when(number.isNotNull(), number == r.try_cast("long")).otherwise(whole.contains(F.concat(F.lit(" "), r, F.lit(" "))))
    yes, no = F.lit("CONFIRMED_CORRECT"), F.lit("CONFIRMED_INCORRECT")
    a, b = comparable(r), comparable(p)
    tokens = F.filter(F.split(a, " "), lambda t: F.length(t) > 2)
    some = F.exists(tokens, lambda t: b.contains(t))
    asked = F.lower(F.coalesce(F.lit("") if question is None else question, F.lit("")))
    exact = asked.contains(EXACT[0]) | asked.contains(EXACT[1])
    return F.when(_void(p), no).when(r.rlike(r"^[0-9]+$"), F.when(numeric, yes).otherwise(no)).when(b.contains(a), yes).when(exact, no).when(some, F.lit("MANUAL_REVIEW")).otherwise(no)


def lenient_correct(reference: Column, predicted: Column) -> Column:
    """Digits or number words; containment either way; or at least min(2, n) of the n key tokens."""
    p, r = F.coalesce(predicted, F.lit("")), F.coalesce(reference, F.lit(""))
    words = [F.when(F.lower(p).contains(w), F.lit(str(n))) for w, n in number_words().items()]
    numbers = F.array_union(F.regexp_extract_all(p, F.lit(r"\b(\d+)\b"), F.lit(1)), F.array_compact(F.array(*words)))
    a, b = comparable(r), comparable(p)
    tokens = F.filter(F.split(a, " "), lambda t: F.length(t) > 2)
    hits = F.size(F.filter(tokens, lambda t: b.contains(t)))
    enough = (F.size(tokens) > 0) & (hits >= F.least(F.lit(2), F.size(tokens)))
    return F.when(_void(p), F.lit(False)).when(r.rlike(r"^[0-9]+$"), F.array_contains(numbers, r)).otherwise(b.contains(a) | a.contains(b) | enough)


def score_answers(rows: DataFrame) -> DataFrame:
    """Adds ``strict`` and ``lenient`` to ``qid, reference, predicted`` and, if there is one, ``question``."""
    question = F.col("question") if "question" in rows.columns else None
    return rows.withColumns({"strict": strict_verdict(F.col("reference"), F.col("predicted"), question), "lenient": lenient_correct(F.col("reference"), F.col("predicted"))})


def accuracy_bounds(scored: DataFrame, digits: int = 6) -> DataFrame:
    """Accuracy with manual reviews counted as wrong and as right, and how often the two scorers differ."""
    ok, maybe = F.col("strict") == "CONFIRMED_CORRECT", F.col("strict") == "MANUAL_REVIEW"
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("correct"),
        F.count_if(maybe).alias("review"),
        F.round(F.avg(ok.cast("double")), digits).alias("lower"),
        F.round(F.avg((ok | maybe).cast("double")), digits).alias("upper"),
        F.count_if(ok != F.col("lenient")).alias("disagree"),
    )


def disagreements(scored: DataFrame) -> DataFrame:
    """The scored rows on which the two scorers differ."""
    return scored.where((F.col("strict") == "CONFIRMED_CORRECT") != F.col("lenient"))


def traces(log: DataFrame) -> DataFrame:
    """Finished operations from ``run, op, kind (start or finish), ts``: ``run, op, started, latency_ms, finished``."""
    at = lambda k, f: f(F.when(F.col("kind") == k, F.col("ts")))
    rows = log.groupBy("run", "op").agg(at("start", F.min).alias("started"), at("finish", F.max).alias("ended"))
    return rows.select("run", "op", "started", ((F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1000.0).alias("latency_ms"), F.col("ended").isNotNull().alias("finished"))


def serialized(df: DataFrame) -> DataFrame:
    """Rows as JSON text, column ``value``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
