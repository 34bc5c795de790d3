"""URL filters: allow and block rules, and gradient-boosted trees on lexical features
for the urls that no rule fits (DataFrame functions and Spark ML only).

The trees learn from labelled urls. Features: lengths of url, host and path, path
depth, host labels, digit ratio, character entropy, hyphens, parameter count, longest path segment
and two suffix statistics (the smoothed share of blocked urls among
training urls with the same last host label and the same last two labels; a training url's own label is left out of its own).
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from .common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LEXICAL = ["f_len", "f_host_len", "f_path_len", "f_depth", "f_labels", "f_digits", "f_entropy", "f_hyphens", "f_params", "f_longest", "f_scheme"]
SUFFIX = ["f_suffix1", "f_suffix2"]


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path; both are empty where the url is null or has no ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(url, PARTS, 2))


def rule_match(rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path, or null. rules: a bounded parameter, (verdict, "host/path")."""
    cases = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        host, slash, path = rule.partition("/")
        at_host = (F.col("host") == host) | F.col("host").endswith("." + host)
        cases.append(F.when(at_host & F.col("path").startswith(slash + path), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*cases)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of a text's characters; 0 if it is empty."""
    total = F.length(text)
    seen = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    share = lambda c: (total - F.length(F.replace(text, c, F.lit("")))) / total
    return F.aggregate(seen, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def lexical(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds the lexical features and the suffixes; null urls count as empty."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    number = lambda c: c.cast("double")
    return pages.withColumns(
        {
            "f_len": number(F.length(url)),
            "f_host_len": number(F.length("host")),
            "f_path_len": number(F.length("path")),
            "f_depth": number(F.size(segments)),
            "f_labels": number(F.size(labels)),
            "f_digits": number(F.length(F.regexp_replace(url, "[^0-9]", ""))) / F.greatest(F.length(url), F.lit(1)),
            "f_entropy": entropy(url),
            "f_hyphens": number(F.length("host") - F.length(F.replace(F.col("host"), F.lit("-"), F.lit("")))),
            "f_params": number(F.when(query == "", 0).otherwise(F.size(F.split(query, "&")))),
            "f_longest": number(F.coalesce(F.array_max(F.transform(segments, F.length)), F.lit(0))),
            "f_scheme": F.when(url.startswith("https://"), 1.0).otherwise(0.0),
            "suffix1": F.element_at(F.concat(F.array(F.lit("")), labels), -1),
            "suffix2": F.array_join(F.slice(F.concat(F.array(F.lit(""), F.lit("")), labels), -2, 2), "."),
        }
    )


class UrlModel:
    """Trees and suffix statistics learnt from labelled urls; without both labels, a constant."""

    def __init__(self, model, stats: dict[str, DataFrame], prior: float):
        self.model, self.stats, self.prior = model, stats, prior

    def score(self, pages: DataFrame) -> DataFrame:
        """Adds ``blocked`` (double: 1 to block). pages: rows of lexical()."""
        if self.model is None:
            return pages.withColumn("blocked", F.lit(1.0 if self.prior > 0.5 else 0.0))
        rows = pages
        for k, name in enumerate(SUFFIX, 1):  # no more suffixes than training urls
            rows = rows.join(F.broadcast(self.stats[name]), f"suffix{k}", "left").withColumn(name, F.coalesce(name, F.lit(self.prior)))
        return self.model.transform(VectorAssembler(inputCols=LEXICAL + SUFFIX, outputCol="features").transform(rows)).withColumnRenamed("prediction", "blocked")


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", max_train: int = 20000, trees: int = 12, depth: int = 4, smooth: float = 10.0) -> UrlModel:
    """Learn from labelled urls (label 1: block). The sample is bounded: the ``max_train`` urls with the smallest hashes."""
    rows = lexical(with_parts(labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label")).where("label IS NOT NULL")))
    sample = staged(rows.orderBy(F.xxhash64("url"), "url", "label").limit(max_train), "url-train")
    n, blocked = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not 0 < blocked < n:
        return UrlModel(None, {}, (blocked or 0) / n if n else 0.0)
    prior = blocked / n
    sums = {name: staged(sample.groupBy(f"suffix{k}").agg(F.sum("label").alias("s"), F.count(F.lit(1)).alias("c")), name) for k, name in enumerate(SUFFIX, 1)}
    stats = {name: rows.select(f"suffix{k}", ((F.col("s") + smooth * prior) / (F.col("c") + smooth)).alias(name)) for k, (name, rows) in enumerate(sums.items(), 1)}
    train = sample
    for k, name in enumerate(SUFFIX, 1):
        train = train.join(F.broadcast(sums[name]), f"suffix{k}").withColumn(name, (F.col("s") - F.col("label") + smooth * prior) / (F.col("c") - 1 + smooth)).drop("s", "c")
    ready = VectorAssembler(inputCols=LEXICAL + SUFFIX, outputCol="features").transform(train).select("features", "label").coalesce(2)
    return UrlModel(GBTClassifier(maxIter=trees, maxDepth=depth, seed=7).fit(ready), stats, prior)


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", model: UrlModel | None = None, max_train: int = 20000) -> DataFrame:
    """Verdict of every url: the longest rule that fits it, else the trees.

    Returns ``page_id, host, path, rule, verdict``. Without a model, one
    is learnt from the urls that rules label. Null and empty urls have empty host
    and path and are judged by the model on empty features; with no labelled urls of both kinds the
    model is the majority label (allow if there are none). Urls of any length are read whole; repeated rows are judged alone. Rules of one length that
    both fit are taken in the order given. Other columns are not read, so clashing names don't matter. An empty table gives no rows.
    """
    rows = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))).withColumn("fit", rule_match(rules))
    if model is None:
        model = fit(rows.where("fit IS NOT NULL").select("url", (F.col("fit.verdict") == "block").cast("double").alias("label")), max_train=max_train)
    scored = model.score(lexical(rows))
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("blocked") > 0.5, "block").otherwise("allow")).alias("verdict"))
