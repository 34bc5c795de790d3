import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import evaluation, ordering
from graphloom.sources import tables


def test_positions_number_rows_across_ranges(spark):
    df = spark.createDataFrame([(i * 37 % 1009,) for i in range(1009)], "k int")
    got = {r["k"]: r["position"] for r in ordering.positions(df.repartition(5), "k").collect()}
    assert got == {k: k + 1 for k in range(1009)}
    assert ordering.positions(df.where("false"), "k").count() == 0


def test_sequences(spark):
    a = spark.createDataFrame([("x", 1, "m"), ("y", 2, "m"), ("z", 3, "m")], "k string, seq int, mode string")
    swapped = a.withColumn("seq", F.when(F.col("k") == "x", 2).when(F.col("k") == "y", 1).otherwise(3))
    row = lambda x, y: ordering.compare_sequences(x, y, "k", "seq", "mode").first().asDict()
    assert row(a, a) == {"n_a": 3, "n_b": 3, "n_differ": 0, "first_difference": None, "modes_a": 1, "modes_b": 1, "same": True}
    assert row(a, swapped)["n_differ"] == 2 and row(a, swapped)["first_difference"] == 1 and not row(a, swapped)["same"]
    assert row(a, a.where("seq < 3"))["first_difference"] == 3
    mixed = a.withColumn("mode", F.when(F.col("seq") == 2, "n").otherwise("m"))
    assert row(a, mixed)["modes_b"] == 2 and not row(a, mixed)["same"]
    assert row(a.where("false"), a.where("false"))["same"]


@pytest.mark.parametrize("accuracy", [10_000, 20, 4])
def test_percentiles_are_exact(spark, accuracy):
    rng = random.Random(accuracy)
    rows = [("a", rng.gauss(0, 9)) for _ in range(1500)] + [("b", float(rng.randint(0, 3))) for _ in range(700)] + [("c", 5.0), ("d", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = (0.0, 0.5, 0.95, 0.99, 1.0)
    got = {(r["k"], r["share"]): r["percentile"] for r in ordering.exact_percentiles(df, "k", "v", shares, accuracy).collect()}
    keys = {k for k, v in rows if v is not None}
    assert set(got) == {(k, s) for k in keys for s in shares}
    for (k, s), p in got.items():
        assert p == pytest.approx(np.percentile([v for x, v in rows if x == k and v is not None], 100 * s), abs=1e-9)
    flat = {r["k"]: r for r in evaluation.latencies(df, "k", "v").collect()}
    assert flat["d"]["n"] == 0 and flat["d"]["p50"] is None and flat[None]["p50"] == 1.5


def test_corrupt_lines_are_counted_and_strict_reading_raises(spark, tmp_path):
    good = [json.dumps({"doc_id": f"Q{i}", "title": "t", "text": "x", "more": 1}) for i in range(3)]
    lines = [*good, "", "  ", '{"doc_id": "Q9", "ti', "[1]", "7", '{"title": "no id"}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "c.jsonl")
    report = {r["state"]: r["n"] for r in tables.corpus_report(tables.parse_corpus(spark.read.text(path))).collect()}
    assert report == {"kept": 3, "blank": 2, "corrupt": 3, "no_id": 1}
    rows = tables.read_corpus(spark, path)
    assert sorted(r["doc_id"] for r in rows.collect()) == ["Q0", "Q1", "Q2"] and rows.where("source <> ''").count() == 0
    with pytest.raises(ValueError, match="3 corrupt, 1 no_id"):
        tables.read_corpus(spark, path, strict=True)
    (tmp_path / "d.jsonl").write_text("\n".join(good))
    assert tables.read_corpus(spark, str(tmp_path / "d.jsonl"), strict=True).count() == 3
