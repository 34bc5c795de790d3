import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import merkle, registry


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def reduced(level):
    """Levels of one tree by the definition."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 8 * 8
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
        i //= 8
    return out


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: reduced([m[2] for m in sorted(groups[g], key=lambda m: m[:3])]) for g in order}
    upper = reduced([trees[g][-1][0] for g in order]) if order else []
    out = []
    for k, g in enumerate(order):
        for i, (_, _, digest, r) in enumerate(sorted(groups[g], key=lambda m: m[:3])):
            path = path_of(trees[g], i) + path_of(upper, k)
            at = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                at = leaf_of((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path:
                at = sha(left + at + right)
            out.append((r[0], digest, trees[g][-1][0], upper[-1][0], sha("".join(a + b for a, b in path)), at, at == upper[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run(docs, **how):
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return sorted(map(tuple, merkle.manifest(docs, tampered=third, changed={"text": lowered}, **how).collect()), key=str)


def made(n, langs):
    return [(i * 7 % n, f"Text {i} ÄÖ" if i % 5 else "plain", langs[i * i % len(langs)], "s" if i % 3 else None, i) for i in range(n)]


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 512, 513, 1500, 4700])
def test_one_group_of_each_size(spark, n):
    rows = made(n, ["en"])
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute([(r[0], r[3], r[2], r[4], r[1]) for r in rows])


def test_rounds_of_blocks_and_many_groups(spark):
    rows = made(3000, ["en"] * 8 + [None, "", "ä", "zz", "Z"])
    docs, expected = spark.createDataFrame(rows, SCHEMA), brute([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    assert run(docs) == expected
    assert run(docs, most=3) == expected  # more groups than the driver takes
    many = made(1400, [f"l{i}" for i in range(700)])
    assert run(spark.createDataFrame(many, SCHEMA), most=600) == brute([(r[0], r[3], r[2], r[4], r[1]) for r in many])


def test_rounds_over_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FAN", 8)
    rows = made(1100, ["en"] * 6 + ["de"])
    assert run(spark.createDataFrame(rows, SCHEMA), most=1) == brute([(r[0], r[3], r[2], r[4], r[1]) for r in rows])


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", None, None, 0), (5, "same", "en", "a", 4), (5, "same", "en", "a", 4), (5, "Same", "en", "a", 4), (-3, "x" * 1_000_000, "en", None, None), (6, None, "", "b", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"pos": F.lit(1), "grp": F.lit("x"), "digest": F.lit(None).cast("string"), "block": F.lit(2)})
    assert run(docs) == brute([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    assert run(docs.where("false")) == []


def test_query_on_whole_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted(map(tuple, registry.QUERIES["op12_merkle_manifest"](spark, d).collect()), key=str)
    assert got == brute(rows)
    assert any(not r[-1] for r in got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    sql = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({registry.ORACLE_SQL['op12_merkle_manifest']})").fetchall()
    assert sorted(sql, key=str) == got
