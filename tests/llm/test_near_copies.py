import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import near_copies
from tests.llm.test_simhash_and_decontamination import fp_by_brute_force

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_brute_force(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            up[root(b)] = root(a)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    return sorted(min(g) for g in groups.values())


def near(rnd, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def texts():
    rnd = random.Random(8)
    word = lambda: rnd.choice("alpha beta Gamma delta éclair nu xi".split()) + str(rnd.randint(0, 90))
    base = [" ".join(word() for _ in range(rnd.choice([3, 5, 12, 60, 150, 400]))) for _ in range(40)]
    line = " ".join(word() for _ in range(30))
    out = base + [near(rnd, b, rnd.randint(1, 1 + len(b.split()) // 40)) for b in base for _ in range(3)]
    hub = " ".join(word() for _ in range(150))
    out += [near(rnd, hub, rnd.randint(1, 5)) for _ in range(60)]  # one large group, some of it linked by others only
    out += [line + " " + " ".join(word() for _ in range(rnd.randint(0, 40))) for _ in range(60)]  # one common line
    out += ["", None, " \t\n", "one", "ONE", base[0], base[9].upper()]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize(("small", "cell", "hot"), [(16, 2048, 0.01), (3, 7, 2.0), (3, 2048, 0.05)])
def test_kept_rows_match_brute_force_jaccard(spark, monkeypatch, small, cell, hot):
    monkeypatch.setattr(near_copies, "SMALL", small)
    monkeypatch.setattr(near_copies, "CELL", cell)
    monkeypatch.setattr(near_copies, "HOT", hot)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS node", "1 AS mark")
    got = near_copies.keep_one(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == kept_by_brute_force(rows)


def test_stage_drops_copies_beyond_four_bits(spark):
    rnd = random.Random(3)
    base = " ".join(f"w{rnd.randrange(1000)}" for _ in range(120))
    far = next(t for t in (near(rnd, base, 2) for _ in range(500)) if (fp_by_brute_force(t) ^ fp_by_brute_force(base)).bit_count() > 4 and kept_by_brute_force([(1, base), (2, t)]) == [1])
    docs = spark.createDataFrame([(1, base), (2, far), (3, "another text of six words")], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, SF).collect()) == [1, 3]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_stage_matches_brute_force_jaccard_on_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, SF).collect()) == kept_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])


def test_null_identifiers_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(3, "a b c"), (3, "a b c"), (None, "A b c"), (None, "zz yy"), (None, None), (None, "")], "doc_id long, text string")
    assert sorted(((r.doc_id, (r.text or "")) for r in near_copies.keep_one(docs).collect()), key=str) == sorted([(3, "a b c"), (None, "zz yy"), (None, "")], key=str)
    assert near_copies.keep_one(docs.limit(0)).collect() == []


def test_identifiers_of_any_size_and_clashing_names(spark):
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "a b c", 1, 2, "x"), (None, "zz yy", 3, 4, "y"), (big + 2, "A b c", 5, 6, "z")], "doc_id long, text string, _k0 long, _K1 long, node string")
    assert sorted(tuple(r) for r in near_copies.keep_one(docs).collect() if r.doc_id) == [(big, "a b c", 1, 2, "x")]
    named = docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    assert sorted(r.doc_id for r in near_copies.keep_one(named).collect()) == [str(big), "none"]


def test_a_very_long_text_and_its_copy(spark):
    base = " ".join(f"w{i % 5000}x{i % 7}" for i in range(150_000))
    docs = spark.createDataFrame([(2, base + " end"), (1, base), (3, "short")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == [1, 3]


def test_many_repeats_of_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(i, base if i % 2 else base + " end") for i in range(900)], "doc_id long, text string").coalesce(1)
    assert [r.doc_id for r in near_copies.keep_one(docs).collect()] == [0]
