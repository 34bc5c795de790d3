import re

import pytest

from graphloom.operators import expansion, tools
from graphloom.plans import queries
from graphloom.sources import layout

SF = "/root/testdata/sf0.001"


def exchanged_scans(df):
    """Scans of stored edges that lie below an exchange, and all such scans, in the plan as it is before it runs."""
    below, scans, shuffled = [], 0, 0
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(re.match(r"[\s:+\-]*", line).group())
        while below and below[-1] >= depth:
            below.pop()
        if "Exchange hashpartitioning" in line:
            below.append(depth)
        if "graphloom_" in line and "Scan parquet" in line:
            scans += 1
            shuffled += bool(below)
    return shuffled, scans


@pytest.fixture(scope="module")
def edges(spark):
    return queries._all_edges(spark, SF)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("hub_edges", [10**6, 20])
def test_operators_read_an_adjacency_like_a_table(spark, edges, hub_edges):
    stored = layout.write_adjacency(edges, hub_edges, buckets=3)
    assert (stored.into.hubs is not None) == (hub_edges == 20)
    vertices = queries.graph_vertices(spark, SF)
    persons = vertices.where("v_type IN ('Person', 'Team')").select("v_type", "v_id")
    assert rows(tools.edges_of(stored, persons).select(*edges.columns)) == rows(tools.edges_of(edges, persons).select(*edges.columns))
    events = vertices.where("v_type = 'Event'").selectExpr("v_id AS event_id")
    assert rows(tools.event_context(events, vertices, stored)) == rows(tools.event_context(events, vertices, edges))
    venues = vertices.where("v_type = 'Venue'").selectExpr("v_id AS venue_id")
    assert rows(tools.events_for_venues(venues, vertices, stored, bound=5)) == rows(tools.events_for_venues(venues, vertices, edges, bound=5))
    seeds = queries._chunk_seeds(spark, SF)
    assert rows(expansion.expand(seeds, stored)) == rows(expansion.expand(seeds, edges))


def test_stored_edges_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = queries._persons(spark.read.parquet(f"{SF}/customer.parquet"))
        stored = queries.stored_edges(spark, SF)
        assert exchanged_scans(tools.edges_of(stored, keys)) == (0, 1)
        assert exchanged_scans(tools.participants_of(spark.createDataFrame([("event_1",)], "event_id string"), stored)) == (0, 1)
        assert exchanged_scans(tools.first_edge(stored, "HELD_AT", "event_id", "venue_id")) == (0, 1)
        assert exchanged_scans(expansion.hop_entities(queries._chunk_seeds(spark, SF), stored)) == (0, 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
