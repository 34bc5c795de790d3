import numpy as np
import pytest

from graphloom.operators import vector_index as vi, vectors
from graphloom.sources import tables


def unit(rows):
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).tolist()


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16)) * 3
    rows = unit(centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)))
    hot = [rows[0]] * 700  # copies of one vector
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows + hot)] + [(9999, None)], "id long, v array<float>")


def rows_of(df):
    return sorted((r["qid"], r["rank"], r["id"], r["distance"]) for r in df.collect())


def test_exact_search_is_brute_force_and_recall_is_kept(spark, clustered, monkeypatch):
    monkeypatch.setattr(vi, "CELL_ROWS", 100)  # a hot list spans several cells
    monkeypatch.setattr(vi, "CELL_QUERIES", 4)
    path = tables.fresh_path(spark, "index")
    vi.build(clustered, path)
    index = vi.open_index(spark, path)
    assert index.counts.sum() == 2200 and index.rows.count() == 2200
    asked = clustered.where("id % 50 = 0 AND v IS NOT NULL").selectExpr("id AS qid", "v")
    truth = vectors.knn(asked, clustered.where("v IS NOT NULL"), 15)
    assert rows_of(vi.search(asked, index, 15, exact=True)) == rows_of(truth)
    assert rows_of(vi.search(asked, index, 15, probes=1, exact=True)) == rows_of(truth)
    found = vi.recall(vi.search(asked, index, 15), truth).first()
    assert found["n_queries"] == asked.count() and found["recall"] >= 0.9
    assert index.probes < len(index.centroids)


def test_more_neighbours_than_rows_and_empty_tables(spark):
    few = spark.createDataFrame([(i, v) for i, v in enumerate(unit(np.random.default_rng(1).normal(size=(5, 4))))], "id long, v array<double>")
    index = vi.build(few, tables.fresh_path(spark, "index"))
    asked = few.selectExpr("id AS qid", "v")
    assert vi.search(asked, index, 9, exact=True).count() == 25
    assert vi.search(asked.where("false"), index, 3).count() == 0
    none = vi.build(few.where("false"), tables.fresh_path(spark, "index"))
    assert vi.search(asked, none, 3, exact=True).count() == 0


def test_no_query_is_on_the_driver_and_the_index_is_read_once(spark, clustered):
    index = vi.build(clustered, tables.fresh_path(spark, "index"))
    plan = vi.search(clustered.where("id < 20").selectExpr("id AS qid", "v"), index, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
