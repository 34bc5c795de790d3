"""Read-only tool policy and extraction of JSON from tool responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Tools that may be called.
ALLOWED = "get_graph_schema show_graph_details get_node get_nodes get_node_edges get_edges get_neighbors run_installed_query search_top_k_similarity fetch_vector".split()
#: Tools that change data or schema, write or run query text, or load.
FORBIDDEN = """
gsql generate_gsql generate_cypher create_graph drop_graph clear_graph_data add_node add_nodes delete_node delete_nodes add_edge add_edges delete_edge delete_edges
install_query drop_query create_loading_job drop_loading_job run_loading_job_with_file run_loading_job_with_data add_vector_attribute drop_vector_attribute upsert_vectors update_schema
""".split()
#: Starts of names of tools that change data, for tools that no policy lists.
MUTATING = "create drop delete upsert insert update load install alter add remove clear write".split()


def standard_policy(spark: SparkSession) -> DataFrame:
    """``tool, decision`` of the listed tools."""
    return spark.createDataFrame([(t, "allowed") for t in ALLOWED] + [(t, "blocked") for t in FORBIDDEN], "tool string, decision string")


def decide(calls: DataFrame, tool_col: str = "tool", policy: DataFrame | None = None) -> DataFrame:
    """Adds ``decision``: allowed, blocked or unknown; only allowed tools may be called.

    Names are compared in lower case and without a namespace (``service__name``). A tool that the policy (``tool, decision``; the standard one unless given) blocks anywhere is
    blocked; one that it doesn't list is blocked if its name starts like a mutation, else unknown.
    """
    rules = (standard_policy(calls.sparkSession) if policy is None else policy).groupBy(F.lower("tool").alias("_tool")).agg(F.max("decision").alias("_decision"))  # blocked comes after allowed
    tool = F.regexp_replace(F.lower(F.coalesce(F.col(tool_col), F.lit(""))), "^[a-z0-9]+__", "")
    mutation = tool.rlike("^(" + "|".join(MUTATING) + ")(_|$)")
    rows = calls.withColumn("_called", tool).join(rules, F.col("_called") == F.col("_tool"), "left")
    return rows.withColumn("decision", F.coalesce("_decision", F.when(mutation, "blocked").otherwise("unknown"))).drop("_called", "_tool", "_decision")


def embedded_json(response: Column) -> Column:
    """The JSON of a response: a fenced block's, or from the first opening to the last closing bracket; null if there is none."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    loose = F.regexp_extract(response, r"(?s)([\[{].*[\]}])", 1)
    found = F.when(fenced != "", fenced).otherwise(F.nullif(loose, F.lit("")))
    return F.when(F.try_parse_json(found).isNotNull(), found)
