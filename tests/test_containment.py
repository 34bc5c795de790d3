import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import containment, questions
from graphloom.plans import queries


def brute(asked, texts):
    return sorted((q, k) for q, needles in asked for k, t in texts if t is not None and needles is not None and None not in needles and all(n in t for n in needles))


def run(spark, asked, texts, **how):
    a = spark.createDataFrame(asked, "qid int, needles array<string>")
    t = spark.createDataFrame(texts, "key int, text string")
    return sorted((r["qid"], r["key"]) for r in containment.containing(a, t, **how).collect())


@pytest.mark.parametrize("size", [1, 3, 6])
def test_pairs_are_those_of_brute_force(spark, size):
    rng = random.Random(size)
    letters = lambda n: "".join(rng.choice("abcé😀 ") for _ in range(n))
    texts = [(i, letters(rng.randint(0, 30))) for i in range(120)] + [(1000, None), (1001, ""), (1001, ""), (1002, "abc" * 300), (1003, letters(201)), (1004, letters(650)), (1005, letters(25_000))]
    asked = [(i, [letters(rng.randint(0, 7)) for _ in range(rng.randint(0, 3))]) for i in range(80)] + [(900, None), (901, ["a", None]), (902, []), (903, [""]), (904, ["abc" * 20])]
    assert run(spark, asked, texts, size=size) == brute(asked, texts)


def test_frequent_grams_are_split(spark, monkeypatch):
    monkeypatch.setattr(containment, "PART_ROWS", 7)
    texts = [(i, f"every title holds number {i}") for i in range(100)]
    asked = [(0, ["every title"]), (1, ["number 77"]), (2, ["every", "number 5"])]
    assert run(spark, asked, texts) == brute(asked, texts)
    assert run(spark, [], texts) == [] and run(spark, asked, []) == []


def test_lookup_has_no_nested_loop(spark):
    for name in ("lookup_fallback", "lookup_phrases"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_predecessor_rule(spark):
    pages = [("Q1", "Judo at the 1992 Winter Olympics – Men's 60 kg", "gold: A \nx"), ("Q2", "Judo at the 1990 Winter Olympics – Men's 60 kg", "gold: B"), ("Q3", "Judo at the 1996 Summer Olympics – Men's 60 kg", "champ: C"), ("Q0", "judo at the 1996 summer olympics – men's 60 kg", "gold: D"), ("Q4", "Judo at the 1996 Summer Olympics – Men's 60 kg", "gold: E")]
    docs = spark.createDataFrame(pages, "doc_id string, title string, text string")
    ask = lambda e, s, y: f"Who won the gold medal in the {e} event at the {s} Olympics held immediately before {y}?"
    asked = spark.createDataFrame([(1, ask("Judo men's 60 kg", "Winter", 1994)), (2, ask("the Judo 60", "Summer", 2000)), (3, ask("fencing", "Summer", 2000)), (4, "immediately before 2000"), (5, None), (6, "no year")], "qid int, question string")
    got = {r["qid"]: (r["doc_id"], r["prev_year"], r["winner"]) for r in questions.predecessor_by_rule(asked, docs).collect()}
    assert got == {1: ("Q1", 1992, "A"), 2: ("Q3", 1996, "C"), 4: ("Q3", 1996, "C")}


def test_words_of_a_date_are_needles(spark):
    docs = spark.createDataFrame([(1, "August 3, Hall 7"), (2, "March 3")], "key int, text string")
    asked = spark.createDataFrame([(0, "August 3")], "qid int, date string").withColumn("needles", F.split("date", " "))
    assert [r["key"] for r in containment.containing(asked, docs).collect()] == [1]
