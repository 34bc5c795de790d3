from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from graphloom.llm import decontaminate as decon, registry, toxicity
from tests.llm.test_near_copies import kept_by_brute_force

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_each_stage_matches_a_brute_force_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    by_name = dict(corpus_pipeline.STAGES)
    assert list(by_name) == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "sharding"]

    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    matcher = toxicity.Matcher(model.terms)
    value = lambda t: sum(a * b for a, b in zip([*toxicity.features(t or "", matcher), 1.0], model.weights, strict=True))
    clean = by_name["toxicity"](spark, docs, SF)
    assert clean.columns == columns
    source = [tuple(r) for r in docs.collect()]
    kept = sorted(r for r in source if value(r[1]) < -0.8472978603872037)  # the logit of 0.3
    assert rows(clean) == kept

    single = by_name["simhash_near_dedup"](spark, clean, SF)
    best = set(kept_by_brute_force([(r[0], r[1]) for r in kept]))  # five-word shingles, Jaccard 0.8
    kept = [r for r in kept if r[0] in best]
    assert single.columns == columns and rows(single) == kept

    items = [decon.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    free = by_name["decontamination"](spark, single, SF)
    full = [(f" {p} ", int(0.06 * len(p)), decon.masks(f" {p} ")) for p in items]
    kept = [r for r in kept if not any(decon.best_distance(bits, len(p), f" {decon.plain(r[1])} ") <= e for p, e, bits in full)]
    assert free.columns == columns and rows(free) == kept

    mixed = by_name["mixing"](spark, free, SF)
    assert mixed.columns == columns
    duckdb_rows = duckdb.connect()
    duckdb_rows.register("documents", free.toPandas())
    sql = registry.ORACLE_SQL["op10_mixing"].replace("SELECT * REPLACE (round(prob, 6) AS prob) FROM mix_rows", "SELECT doc_id FROM mix_rows WHERE kept")
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r[0] for r in duckdb_rows.execute(sql).fetchall())

    sharded = by_name["sharding"](spark, mixed, SF)
    assert sorted(r.doc_id for r in sharded.collect()) == sorted(r.doc_id for r in mixed.collect())


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "shard", "slot", "text"} <= set(out.columns) and out.count() > 0


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op9_chat_format", "op10_mixing"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(shown, r)) for r in got.select(*names).collect()) == sorted(tuple(map(shown, r)) for r in found.fetchall())


def odd_rows(spark):
    big = 2**53 + 1
    rows = [(big, "one two three four five six", "en", "a", None, "n"), (None, "one two three four five six", None, None, big, None), (None, None, None, None, None, None), (4, "", "fr", "b", 1, "m"), (4, "", "fr", "b", 1, "m"), (7, "w" * 300_000 + " end", "en", "a", 2, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, mix_note string")


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_empty_tables(spark, name, stage):
    docs = odd_rows(spark)
    out = stage(spark, docs, SF)
    given = Counter(tuple(r) for r in docs.collect())
    if name == "sharding":
        assert out.count() == 6 and "carried_size" in out.columns
        assert Counter(tuple(r) for r in out.selectExpr("doc_id", "text", "lang", "source", "carried_size", "mix_note").collect()) == given
    else:
        assert out.columns == docs.columns
        kept = Counter(tuple(r) for r in out.collect())
        assert kept <= given
        if name in ("toxicity", "decontamination"):
            assert kept == given
        if name == "simhash_near_dedup":
            assert sorted(str(r[0]) for r in kept) == ["4", "7", str(2**53 + 1)]
    assert stage(spark, docs.limit(0), SF).collect() == []
