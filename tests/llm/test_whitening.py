import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import registry, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, components=8):
    """(vec_id, x, deviation) rows, mean, covariance, eigenvalues and vectors, from Python integers and fractions."""
    kept = [(i, [math.floor(1024 * float(c)) + 100000 for c in v]) for i, v in rows if usable(v)]
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[j] for _, x in kept) for j in range(d)]
    centred = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for _, x in kept])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    deviation = [sum((n * x[j] - sums[j]) ** 2 for j in range(d)) for _, x in kept]
    return [i for i, _ in kept], centred, deviation, covariance, values[order], vectors[:, order]


def compare(got, rows, components=8):
    ids, centred, deviation, covariance, values, vectors = brute(rows, components)
    n, k = len(ids), len(values)
    assert len(got) == n * k
    white = centred @ vectors / np.sqrt(values)
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], []).append(r)
    signs = {}
    for i, (vec, want) in enumerate(zip(ids, white, strict=True)):
        found = sorted(by_row[vec], key=lambda r: r["component"])
        assert [r["component"] for r in found] == list(range(1, k + 1))
        for c, r in enumerate(found):
            assert r["n"] == n and int(r["deviation"]) == deviation[i]
            assert r["explained"] == pytest.approx(values[c] / np.trace(covariance), rel=1e-9)
            assert r["identity_error"] < 1e-9
            if abs(want[c]) > 1e-6:
                sign = signs.setdefault(c, np.sign(want[c] * r["whitened"]))
                assert r["whitened"] * sign == pytest.approx(want[c], rel=1e-6, abs=1e-8)
    return by_row


def test_query_on_whole_embeddings(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    found = registry.QUERIES["op13_embedding_whitening"](spark, d)
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    compare(found.collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).astype("float32").tolist(), 1) for i in range(60)] + [(i, [0.5] * 5, 2) for i in range(100, 140)]
    bad = [(200, None, 0), (201, [1.0, None, 0.0, 0.0, 0.0], 0), (202, [1.0, float("nan"), 0.0, 0.0, 0.0], 0), (203, [float("inf")] * 5, 0), (204, [], 0), (205, [1.0, 2.0], 0)]
    docs = spark.createDataFrame(rows + bad, SCHEMA).withColumns({"component": F.lit(1), "n": F.lit("x")}).repartition(7)
    compare(whitening.whiten(docs).collect(), [r[:2] for r in rows], 5)
    none = whitening.whiten(docs.where("false"))
    assert none.count() == 0 and none.columns[0] == "vec_id"
    assert whitening.whiten(docs.where("vec_id >= 200 AND vec_id < 205")).count() == 0
    twice = spark.createDataFrame([(None, v, 0) for _, v, _ in rows] * 2, SCHEMA)
    assert whitening.whiten(twice).where("vec_id IS NULL AND n = 200").count() == 1000


def test_vectors_without_variance(spark):
    docs = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 0) for i in range(4)], SCHEMA)
    got = whitening.whiten(docs).collect()
    assert len(got) == 12 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in got)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(9)], SCHEMA)
    found = {(r["vec_id"], r["component"]): r for r in whitening.whiten(line).collect()}
    assert found[0, 1]["whitened"] is not None and found[0, 2]["whitened"] is None
    assert found[0, 1]["explained"] == pytest.approx(1) and found[0, 1]["identity_error"] < 1e-9


def test_integers_beyond_64_bits():
    v = np.array([[1e20, -1.0], [3.0, 2.5]])
    x = whitening.to_integers(v, 1024, 100_000)
    assert x[0, 0] == 1024 * int(1e20) + 100_000 and x[1, 1] == 102560
    sums = whitening._column_sums(x)
    assert sums == [int(x[0, 0]) + int(x[1, 0]), int(x[0, 1]) + int(x[1, 1])]
    assert whitening.deviations(x, 2, sums) == [sum((2 * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    small = np.array([[100_001, 99_000], [100_500, 100_500]])
    n = 10**12  # n * x fits, its square doesn't
    sums = [100_100 * n, 99_500 * n]
    assert whitening.deviations(small, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in small]
    assert np.allclose(whitening.centred(small, n, sums), small - np.array([100_100, 99_500]))


def test_pooled_moments_are_those_of_all():
    rng = np.random.default_rng(4)
    parts = [rng.normal(size=(k, 3)) for k in (1, 5, 40)]
    total = None
    for p in parts:
        total = whitening.pooled(total, (len(p), p.mean(0), (p - p.mean(0)).T @ (p - p.mean(0))))
    whole = np.concatenate(parts)
    assert total[0] == 46 and np.allclose(total[1], whole.mean(0))
    assert np.allclose(total[2], (whole - whole.mean(0)).T @ (whole - whole.mean(0)))
