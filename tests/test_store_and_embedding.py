import pytest
from pyspark.sql import functions as F

from graphloom.operators import embedding, evaluation
from graphloom.sources import store, tables

SCHEMA = "v_type string, v_id string, name string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_upserts_keep_the_last_write_and_touch_few_buckets(spark):
    kept = store.KeyedStore(spark, tables.fresh_path(spark, "store"), SCHEMA, ["v_type", "v_id"], buckets=32)
    assert rows_of(kept.read()) == [] and kept.upsert(kept.empty) == 0
    make = lambda rows: spark.createDataFrame(rows, SCHEMA + ", seq int")
    assert kept.upsert(make([("E", str(i), "old", 0) for i in range(200)]), "seq") > 25
    before = kept._manifest()[1]
    batch = make([("E", "7", "x", 2), ("E", "7", "y", 5), ("E", "7", "z", 1), ("P", "7", "new", 0), ("P", "7", "new", 0), (None, "7", "n", 0)])
    assert kept.upsert(batch, "seq") <= 3
    want = [("E", str(i), "y" if i == 7 else "old") for i in range(200)] + [("P", "7", "new"), (None, "7", "n")]
    assert rows_of(kept.read().fillna("", ["v_type"])) == sorted((a or "", b, c) for a, b, c in want)
    after = kept._manifest()[1]
    assert sum(before[b] != after[b] for b in before) <= 3
    assert kept.upsert(spark.createDataFrame([(None, "7", "m"), (None, "7", "o")], SCHEMA)) == 1  # without an order the largest stays
    assert {r["name"] for r in kept.read().where("v_type IS NULL").collect()} == {"o"}


def test_a_lost_race_changes_nothing(spark):
    path = tables.fresh_path(spark, "store")
    one, two = (store.KeyedStore(spark, path, SCHEMA, ["v_type", "v_id"], buckets=2) for _ in range(2))
    one.upsert(spark.createDataFrame([("E", "1", "a")], SCHEMA))
    stale = two._manifest()
    one.upsert(spark.createDataFrame([("E", "1", "b")], SCHEMA))
    two._manifest = lambda: stale
    with pytest.raises(RuntimeError):
        two.upsert(spark.createDataFrame([("E", "1", "c")], SCHEMA))
    assert rows_of(one.read()) == [("E", "1", "b")]


class Flaky:
    """Fails on a schedule by how often a batch has been asked for."""

    def __init__(self, statuses):
        self.statuses, self.calls, self.sizes = list(statuses), 0, []

    def embed(self, texts):
        self.calls += 1
        if self.statuses and (status := self.statuses.pop(0)):
            raise embedding.ProviderError(status)
        self.sizes.append(len(texts))
        return [[float(len(t))] for t in texts]


def test_passing_errors_are_retried_with_growing_pauses():
    pauses, provider = [], Flaky([429, 500, 503, 0])
    assert embedding.call(provider, ["ab"], embedding.Calls(pause=1, longest=3), pauses.append) == [[2.0]]
    assert pauses == [1, 2, 3] and provider.calls == 4
    with pytest.raises(embedding.ProviderError):
        embedding.call(Flaky([400]), ["a"], embedding.Calls(), pauses.append)
    with pytest.raises(embedding.ProviderError):
        embedding.call(Flaky([429] * 9), ["a"], embedding.Calls(attempts=3, pause=0), lambda s: None)


class Broken(Flaky):
    def embed(self, texts):
        if any(t.startswith("bad") for t in texts):
            raise embedding.ProviderError(400)
        return super().embed(texts)


def test_a_run_that_ends_early_goes_on(spark):
    docs = spark.createDataFrame([(i, f"bad {i}" if i == 17 else "x" * i) for i in range(60)] + [(None, None)], "id long, text string")
    path = tables.fresh_path(spark, "vectors")
    with pytest.raises(Exception, match="400"):
        embedding.embed_resumed(spark, docs, path, Broken([]), slices=4)
    done = {r["id"] for r in spark.read.parquet(path).collect()} if _exists(spark, path) else set()
    assert None not in done
    docs = docs.withColumn("text", F.regexp_replace("text", "bad", "now"))
    whole = embedding.embed_resumed(spark, docs, path, Flaky([429, 0, 503]), calls=embedding.Calls(size=7, pause=0), slices=4)
    assert 17 not in done and sorted(r["id"] for r in whole.collect()) == list(range(60))
    assert all(r["v"] == [float(r["id"] if r["id"] != 17 else 6)] for r in whole.collect())


def _exists(spark, path):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def test_number_words_and_question_types(spark):
    words = evaluation.number_words()
    assert words["twenty-nine"] == 29 and words["thirty five"] == 35 and words["forty"] == 40 and len(words) == 20 + 3 + 36
    rows = [
        ("29", "Twenty-nine nations took part.", "", True, "CONFIRMED_INCORRECT"),
        ("35", "thirty-five nations", "", True, "CONFIRMED_INCORRECT"),
        ("Lydia Valentin", "Maria Valentin", "Who won immediately before 2012?", False, "CONFIRMED_INCORRECT"),
        ("Lydia Valentin", "Maria Valentin", "Who won?", False, "MANUAL_REVIEW"),
        ("Lydia Valentin", "It was Lydia Valentin", "Who won immediately before 2012?", True, "CONFIRMED_CORRECT"),
        ("Men's eight", "the eight", "Which had the highest number of competitors?", False, "CONFIRMED_INCORRECT"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "qid int, reference string, predicted string, question string, l boolean, s string")
    for r in evaluation.score_answers(df).collect():
        assert (r["lenient"], r["strict"]) == (r["l"], r["s"]), r
