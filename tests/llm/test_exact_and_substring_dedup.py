import collections
import hashlib
import random

import pytest

from graphloom.llm import suffix_dedup
from graphloom.llm.exact_dedup import exact_dedup
from graphloom.llm.suffix_dedup import long_text_phrases, phrases, substring_dedup

DOC = "doc_id long, text string, keep string, n long, mark string"


def documents():
    rnd = random.Random(3)
    passages = ["".join(rnd.choice("abc") for _ in range(rnd.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(passages)[: rnd.randint(3, 60)] + rnd.choice("xyzé") for _ in range(rnd.randint(0, 9)))) for i in range(80)]
    rows += [(500, None), (501, ""), (502, "a" * 300), (503, "q" * 5), (7, "aaab" * 20), (7, "aaab" * 20), (None, "aaab" * 20), (None, None), (9, rows[3][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, None) for r in rows], DOC).repartition(3)


def removed_by_brute_force(rows, length):
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[j : j + length] for j in range(len(b) - length + 1))
    found = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = [True] * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        found.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(found, key=str)


@pytest.mark.parametrize(("length", "window"), [(20, 9), (20, 2), (30, 12), (40, 33)])
def test_substrings_match_brute_force(spark, length, window):
    rows = documents()
    got = substring_dedup(frame(spark, rows), length=length, window=window)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == removed_by_brute_force(rows, length)


@pytest.mark.parametrize("seed", range(4))
def test_common_passages_with_many_surroundings(spark, seed):
    """Passages about as long as the strings, cut at random on both sides: repeated starts depend on both neighbours."""
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice("ab") for _ in range(k))
    passage = word(60)
    rows = []
    for i in range(400):
        a = rnd.randint(0, 45)
        rows.append((i, word(rnd.randint(0, 25)) + passage[a : a + rnd.randint(10, 40)] + word(rnd.randint(0, 25))))
    got = substring_dedup(frame(spark, rows), length=24, window=rnd.choice([6, 10, 17]))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == removed_by_brute_force(rows, 24)


def test_open_starts_are_placed_in_corpus_order(spark, monkeypatch):
    """x shares its phrase suffix with one entry, its parse suffix with another, and one start with a third."""
    rnd = random.Random(0)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randint(15, 40)))) for i in range(1500)]
    got = substring_dedup(frame(spark, rows), length=15, window=8)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == removed_by_brute_force(rows, 15)
    monkeypatch.setattr(suffix_dedup, "open_starts", lambda found, entries, length: found.sparkSession.createDataFrame([], "doc long, mark long, start int, end int"))
    without = substring_dedup(frame(spark, rows), length=15, window=8)
    assert sorted((tuple(r)[:5] for r in without.collect()), key=str) != removed_by_brute_force(rows, 15)


def test_very_long_texts_are_parsed_in_pieces():
    rnd = random.Random(5)
    text = bytes(rnd.choice(b"abcd") for _ in range(5000)) + b"z" * 700 + bytes(rnd.choice(b"abcd") for _ in range(3000))
    whole = [(lo, hi, s) for _, lo, hi, s, _ in phrases([text], 400, 192)]
    assert list(long_text_phrases(text, 400, 192, piece=257)) == whole == list(long_text_phrases(text, 400, 192, piece=1 << 20))
    assert whole[0][0] == 0 and whole[-1][1] == len(text) - 400 and all(a[1] + 1 == b[0] for a, b in zip(whole, whole[1:]))


def test_a_very_long_text_of_repeats(spark):
    rnd = random.Random(6)
    once = "".join(rnd.choice("abcdefgh ") for _ in range(600_000))
    rows = [(1, once + "#" + "x" * 500_000), (2, "y" + once[1000:2000] + "y"), (3, "short")]
    got = {r.doc_id: r for r in substring_dedup(frame(spark, rows)).collect()}
    assert got[1].spans == "1000:2000,600001:1100001" and got[2].spans == "1:1001" and got[3].spans == ""


def test_repeated_rows_and_identifiers_of_any_size_and_type(spark):
    big, text = 2**53 + 1, "one two three " * 40
    rows = [(big, text), (None, text), (big + 2, "x" * 30), (None, "y"), *[(5, text)] * 300]
    got = substring_dedup(frame(spark, rows), length=40, window=20).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == removed_by_brute_force(rows, 40)
    named = spark.createDataFrame([("a", text), ("b", text), (None, "z")], "doc_id string, text string")
    assert sorted(str(r.doc_id) for r in substring_dedup(named, length=40, window=20).collect()) == ["None", "a", "b"]


def test_substrings_of_an_empty_table_and_wrong_parameters(spark):
    assert substring_dedup(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        substring_dedup(frame(spark, []), length=20, window=19)


@pytest.mark.parametrize(("keep", "runs", "fan"), [("max", 64, 16), ("min", 8, 2), ("max", 1, 4), ("max", 9, 3)])
def test_exact_dedup_matches_brute_force(spark, keep, runs, fan):
    rows = documents()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {}
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best[t] = (max(known) if keep == "max" else min(known)) if known else None
    want = sorted(((i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)
    got = exact_dedup(frame(spark, rows), keep=keep, runs=runs, fan=fan)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_exact_dedup_of_an_empty_table(spark):
    assert exact_dedup(frame(spark, [])).collect() == []


@pytest.mark.parametrize("keep", ["max", "min"])
def test_large_null_and_string_identifiers_survive(spark, keep):
    big = 2**53 + 1
    rows = [(big, "a"), (None, "a"), (big + 2, "b"), (None, "b"), (None, "c"), (big + 1, "a"), (4, "x" * 2_000_000), (5, "x" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text_sha256[:4]): (r.keep_id, r.kept) for r in exact_dedup(docs, keep=keep).collect()}
    name = lambda t: hashlib.sha256(t.encode()).hexdigest()[:4]
    best = big + 1 if keep == "max" else big
    assert got[(big, name("a"))] == (best, best == big) and got[(big + 1, name("a"))] == (best, best == big + 1) and got[(None, name("a"))] == (best, False)
    assert got[(big + 2, name("b"))] == (big + 2, True) and got[(None, name("c"))] == (None, True)
    named = {r.doc_id: r.keep_id for r in exact_dedup(docs.selectExpr("cast(doc_id as string) doc_id", "text"), keep=keep).collect() if r.doc_id}
    assert named[str(big)] == str(best) and named["4"] == ("5" if keep == "max" else "4")
