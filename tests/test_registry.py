import math

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import queries, sql

SF = "/root/testdata/sf0.001"
#: A query of each kind; the driver compares all of them at a larger size.
COMPARED = ["knn_topk", "metrics_by_type_rollup", "event_context", "merge_derived", "fuse_and_rank", "retrieval_stats", "chunk_documents", "heading_attach", "extracted_vertices", "mentions", "temporal_predecessor", "route_questions", "verify_answers", "harness_fold", "repair_rerank", "answer_scoring", "tool_gateway"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", COMPARED)
def test_query_matches_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    found = con.execute(sql.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(map(shown, r)) for r in got.select(*names).collect()) == sorted(tuple(map(shown, r)) for r in found.fetchall())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(sql.SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_runs_on_shipped_code(spark):
    from graphloom.plans.ship import ship

    ship(spark)
