import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import decontaminate as decon, simhash


def fp_by_brute_force(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    tokens, word = [], ""
    for c in low + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            tokens += [word] * bool(word)
            word = ""
        else:
            word += c
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or ([" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts():
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("alpha beta Gamma delta éclair Ünder nu xi".split()) + str(rnd.randint(0, 60)) for _ in range(rnd.randint(1, 90))) for _ in range(40)]
    near = []
    for t in base[:15]:
        w = t.split()
        w[rnd.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return base + near + ["", None, " \t\n", "one", "one two three", "A B c d e", base[0], base[0].upper()]


def components_by_brute_force(rows, k):
    fps = {i: fp_by_brute_force(t or "") for i, t in rows}
    up = {i: i for i in fps}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= k:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (f"{fps[i]:016x}", root(i)) for i in fps}


@pytest.mark.parametrize("k", [0, 4, 9])
def test_components_match_brute_force(spark, k):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("mark", F.lit(1))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_dups(docs, k=k).collect()}
    assert got == components_by_brute_force(rows, k)
    kept = simhash.keep_one(docs, k=k)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()})


def test_repeated_rows_and_null_identifiers(spark):
    docs = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "zz yy"), (None, None)], "doc_id long, text string")
    out = simhash.near_dups(docs).collect()
    assert len(out) == 5 and {r.component_id for r in out} == {3, None}
    assert sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str) == sorted([(3, "a b c d e"), (None, "zz yy"), (None, None)], key=str)
    assert simhash.near_dups(docs.limit(0)).collect() == []


def test_large_buckets_are_linked_without_all_pairs():
    import numpy as np

    rnd = random.Random(1)
    fps = [0]
    for _ in range(300):
        fps.append(fps[-1] ^ (1 << rnd.randrange(64)))
    fps += [rnd.getrandbits(64) for _ in range(50)]
    forest = simhash.Forest()
    simhash.link_bucket(np.array(fps, dtype=np.uint64), np.arange(len(fps)), 4, forest)
    assert len({forest.root(i) for i in range(301)}) == 1
    assert all(forest.root(i) == i for i in range(301, 351))


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert got == {**{i: 1 for i in range(2, 201)}, 1001: 1000}


def test_chains_through_rows_without_identifiers_and_large_identifiers(spark):
    words = [f"w{i}" for i in range(40)]
    chain = [" ".join(words[:i]) for i in range(30, 40)]
    rows = [(2**53 + 1 + 2 * i if i % 3 == 0 else None, t) for i, t in enumerate(chain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    brute = components_by_brute_force(list(enumerate(chain)), 9)
    least = {}
    for i, (_, c) in brute.items():
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    want = sorted(((rows[i][0], f, least.get(c)) for i, (f, c) in brute.items()), key=str)
    assert sorted((tuple(r) for r in simhash.near_dups(docs, k=9).collect()), key=str) == want
    named = simhash.near_dups(docs.selectExpr("cast(doc_id as string) doc_id", "text"), k=9)
    assert sorted({str(r.doc_id) for r in named.collect()}) == sorted({str(r[0]) for r in rows})


def test_a_flushed_forest_still_spans():
    import numpy as np
    import pandas as pd

    rnd = random.Random(2)
    fps = [0]
    for _ in range(400):
        fps.append(fps[-1] ^ (1 << rnd.randrange(64)))
    rows = pd.DataFrame({"key": np.arange(401) // 3, "fp": np.array(fps, np.uint64).view(np.int64), "rep": np.arange(401)})
    links = [tuple(map(int, x)) for out in simhash.link_buckets(2, most_links=5)(iter([rows[:100], rows[100:]])) for x in out.to_numpy()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in links)
    assert {frozenset(x) for x in links} >= {frozenset((i, i + 1)) for i in range(0, 400, 3)}


def test_blocks_grow_with_the_number_of_fingerprints():
    assert [simhash.blocks_for(n, 4) for n in (10, 250_000, 50_000_000, 10**12)] == sorted(simhash.blocks_for(n, 4) for n in (10, 250_000, 50_000_000, 10**12))
    assert simhash.blocks_for(10**12, 4) == 8


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def best_by_brute_force(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_bit_parallel_distance_is_exact():
    rnd = random.Random(2)
    for _ in range(200):
        p = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 80)))
        t = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 120)))
        assert decon.best_distance(decon.masks(p), len(p), t) == best_by_brute_force(p, t)


@pytest.mark.parametrize("block_chars", [10**6, 60])
def test_edited_items_are_found_within_the_budget(spark, block_chars):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    items = [" ".join(word() for _ in range(14)) for _ in range(6)] + ["", None, items0 if (items0 := "Exact Item, with Signs!") else ""]
    docs = []
    for i in range(60):
        noise = [word() for _ in range(40)]
        if i % 3 == 0:
            item = list(items[i % 6])
            for _ in range(rnd.randint(0, 9)):
                at = rnd.randrange(len(item))
                item[at : at + 1] = rnd.choice([["z"], [], ["z", item[at]]])
            noise.insert(20, "".join(item))
        docs.append((i, " ".join(noise)))
    docs += [(100, None), (101, ""), (None, "so EXACT   item with signs"), (102, "exact-item with signs"), (102, "exact-item with signs")]
    got = decon.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), block_chars=block_chars).collect()
    assert len(got) == len(docs)
    want = []
    for i, t in docs:
        hits = []
        for k, item in enumerate(items):
            p = decon.plain(item or "")
            if p and t and (d := best_by_brute_force(f" {p} ", f" {decon.plain(t)} ")) <= int(0.06 * len(p)):
                hits.append((d, k))
        want.append((i, len(hits), min(hits)[1] if hits else None, min(hits)[0] if hits else None, bool(hits)))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_own_columns_are_kept_whatever_their_names(spark):
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "some text", "en", 1, None), (None, "An Item of five words", "fr", None, big), (3, None, None, None, None)], "doc_id long, text string, _k0 string, decon_n long, hits long")
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(None, "an item of five words"), (big, "an item of five words"), (7, "cat"), (8, "")], "item_id long, text string")
    for block in (10, 10**6):
        kept = decon.keep_free(docs, items, block_chars=block)
        assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(3, None, None, None, None), (big, "some text", "en", 1, None)]
        found = {r.doc_id: tuple(r)[1:] for r in decon.decontaminate(docs, items, block_chars=block).collect()}
        assert found == {big: (0, None, None, False), None: (2, None, 0, True), 3: (0, None, None, False)}
    assert decon.keep_free(docs, none).count() == 3 and decon.keep_free(docs.limit(0), items).collect() == []
    assert decon.decontaminate(docs.limit(0), none).collect() == []


def test_items_stand_as_whole_words_in_texts_of_any_length(spark):
    docs = spark.createDataFrame([("a", "the catalogue"), ("b", "w " * 2_000_000 + "The CAT!"), ("b", "cat"), ("c", "cat " * 3)], "doc_id string, text string")
    items = spark.createDataFrame([("x", "cat"), ("y", "a")], "item_id string, text string")
    assert sorted(tuple(r) for r in decon.decontaminate(docs, items).collect()) == [("a", 0, None, None, False), ("b", 1, "x", 0, True), ("b", 1, "x", 0, True), ("c", 1, "x", 0, True)]
    assert sorted(r.doc_id for r in decon.keep_free(docs, items).collect()) == ["a"]


def test_a_large_benchmark_is_read_block_by_block(spark):
    docs = spark.createDataFrame([(i, f"noise before item number {i} of many and noise after") for i in range(30)] + [(5, "again item number 5 of many")], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"item number {i} of many") for i in range(0, 30, 2)], "item_id long, text string")
    assert len(list(decon.blocks_of(items, "item_id", "text", 40))) > 5
    many, one = (sorted(tuple(r) for r in decon.decontaminate(docs, items, rate=0.0, block_chars=n).collect()) for n in (40, 10**6))
    assert many == one and sum(r[1] for r in one) == 15
    plan = decon.decontaminate(docs, items)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("ArrowEvalPython") == 1
