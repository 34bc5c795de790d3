"""A corpus and a property graph over the star schema.

Orders play events, customers persons, suppliers teams, nations countries, the part of an
order's first line the venue and its type the sport. ``CORPUS_SQL`` writes each order as an event
page with an infobox; the same statement runs in Spark and in other engines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import table

CORPUS_SQL = r"""
SELECT concat('Q', o_orderkey) AS doc_id, title, sport, yr, competitors, nations,
       concat(title, {nl}, {nl}, '[Infobox Olympic event]', {nl}, '  event: ', event, {nl}, '  games: ', yr, ' ', season,
              {nl}, CASE WHEN o_orderkey % 9 = 0 THEN '  no colon line' ELSE concat('  venue: Venue Hall ', o_custkey % 40) END,
              {nl}, '  date: ', 1 + o_orderkey % 28, ' August ', yr, {nl}, '  competitors: ', competitors,
              {nl}, '  nations: ', nations,
              CASE WHEN o_orderkey % 3 = 0 THEN concat({nl}, '  teams: ', competitors - o_orderkey % 2) ELSE '' END,
              {nl}, '  gold: ', CASE WHEN o_orderkey % 11 = 0 THEN 'Vacant' ELSE c_name END,
              {nl}, '  goldNOC: ', CASE WHEN o_orderkey % 13 = 0 THEN lower(substr(n_name, 1, 3)) ELSE upper(substr(n_name, 1, 3)) END,
              {nl}, '  silver: Customer-', o_custkey % 7, {nl}, '  silverNOC: ABC',
              {nl}, {nl}, 'Overview', {nl}, {nl}, 'Background of the event', {nl}, {nl},
              'The ', event, ' of ', season, ' ', yr, ' took place at Venue Hall ', o_custkey % 40, '. ', c_name, ' won.',
              {nl}, {nl}, 'Results table', {nl}, '1 | ', c_name, ' | ', nations, {nl}, '2 | none | 0',
              {nl}, {nl}, 'a | b | c', {nl}, {nl}, repeat('- item line of the order. ', CAST(o_orderkey % 5 AS INT))) AS text,
       o_orderkey, event, season, c_name, o_custkey
FROM (
    SELECT *, concat(sport, ' at the ', yr, ' ', season, ' Olympics – ', event) AS title
    FROM (
        SELECT o_orderkey, o_custkey, c_name, n_name, CAST(year(o_orderdate) AS INT) AS yr,
               CASE o_custkey % 5 WHEN 0 THEN 'Rowing' WHEN 1 THEN 'Sailing' WHEN 2 THEN 'Archery' WHEN 3 THEN 'Cycling' ELSE 'Swimming' END AS sport,
               CASE o_orderkey % 7 WHEN 0 THEN 'Men''s eight' WHEN 1 THEN 'Women''s individual' WHEN 2 THEN 'Mixed relay' WHEN 3 THEN 'Men''s 470'
                    WHEN 4 THEN 'Group all-around' WHEN 5 THEN 'Men''s marathon' ELSE 'Women''s solo' END AS event,
               CASE WHEN o_orderkey % 2 = 0 THEN 'Summer' ELSE 'Winter' END AS season,
               2 + o_orderkey % 97 AS competitors, 1 + o_custkey % 53 AS nations
        FROM {orders} AS o JOIN {customer} AS c ON o.o_custkey = c.c_custkey JOIN {nation} AS n ON c.c_nationkey = n.n_nationkey
    ) AS a
) AS b
"""

GRAPH_SQL = r"""
WITH first_line AS (
    SELECT l_orderkey, l_partkey FROM (
        SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM {lineitem} AS l) AS x
    WHERE rn = 1
)
SELECT DISTINCT src_type, src_id, edge_type, dst_type, dst_id FROM (
    SELECT 'Person' AS src_type, concat('person_', o_custkey) AS src_id, 'PARTICIPATED_IN' AS edge_type, 'Event' AS dst_type, concat('event_', o_orderkey) AS dst_id FROM {orders} AS o
    UNION ALL SELECT 'Team', concat('team_', l_suppkey), 'PARTICIPATED_IN', 'Event', concat('event_', l_orderkey) FROM {lineitem} AS l
    UNION ALL SELECT 'Person', concat('person_', c_custkey), 'REPRESENTS', 'Country', concat('country_', c_nationkey) FROM {customer} AS c
    UNION ALL SELECT 'Team', concat('team_', s_suppkey), 'REPRESENTS', 'Country', concat('country_', s_nationkey) FROM {supplier} AS s
    UNION ALL SELECT 'Event', concat('event_', l_orderkey), 'HELD_AT', 'Venue', concat('venue_', l_partkey) FROM first_line
    UNION ALL SELECT 'Event', concat('event_', l_orderkey), 'BELONGS_TO', 'Sport', concat('sport_', replace(lower(p_type), ' ', '_')) FROM first_line JOIN {part} AS p ON first_line.l_partkey = p.p_partkey
) AS e
"""

VERTEX_SQL = r"""
SELECT 'Event' AS v_type, concat('event_', o_orderkey) AS v_id, o_orderpriority AS name, CAST(year(o_orderdate) AS INT) AS year, concat(o_orderpriority, ' ', o_orderstatus) AS description FROM {orders} AS o
UNION ALL SELECT 'Person', concat('person_', c_custkey), c_name, 0, c_mktsegment FROM {customer} AS c
UNION ALL SELECT 'Team', concat('team_', s_suppkey), s_name, 0, '' FROM {supplier} AS s
UNION ALL SELECT 'Country', concat('country_', n_nationkey), n_name, 0, '' FROM {nation} AS n
UNION ALL SELECT 'Venue', concat('venue_', p_partkey), p_name, 0, p_brand FROM {part} AS p
UNION ALL SELECT DISTINCT 'Sport', concat('sport_', replace(lower(p_type), ' ', '_')), p_type, 0, '' FROM {part} AS q
"""

TABLES = ("orders", "customer", "nation", "lineitem", "supplier", "part")


#: Orders of one part, where they are spread.
SPREAD_ROWS = 50_000


def spread_out(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to a multiple of the cores, twice at least: a small file is read by one task, whatever is made of its rows, and files of equal size are read by as many tasks as there are cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores * max(2, -(-rows.count() // (cores * SPREAD_ROWS))), key)


def _run(spark: SparkSession, sf_dir: str, sql: str, spread: bool = False) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    if spread:
        used["orders"] = spread_out(used["orders"], "o_orderkey")
    return spark.sql(sql.replace("{nl}", "'\\n'"), **used)


def corpus(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Event pages: ``doc_id, title, sport, yr, competitors, nations, text`` and the columns they are made of; made by all cores if they are ``spread``."""
    return _run(spark, sf_dir, CORPUS_SQL, spread)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges: ``src_type, src_id, edge_type, dst_type, dst_id``.

    The rows of ``GRAPH_SQL``. Keys are made distinct as numbers, kind by kind, and ids are written from them afterwards: no two kinds share an edge, and no ids are shuffled.
    """
    read = lambda name, *columns: table(spark, sf_dir, name).select(*columns)
    sport = F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")).alias("sport")
    first = read("lineitem", "l_orderkey", "l_linenumber", "l_partkey").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("r")).select("l_orderkey", "r.l_partkey")
    played = first.join(read("part", "p_partkey", sport).distinct(), F.col("l_partkey") == F.col("p_partkey"))

    def kind(rows: DataFrame, src_type: str, src: str, edge_type: str, dst_type: str, dst: str) -> DataFrame:
        end = lambda t, c, p: (F.lit(t).alias(f"{p}_type"), F.concat(F.lit(f"{t.lower()}_"), c).alias(f"{p}_id"))
        return rows.select(*end(src_type, src, "src"), F.lit(edge_type).alias("edge_type"), *end(dst_type, dst, "dst"))

    kinds = [
        kind(read("orders", "o_custkey", "o_orderkey").distinct(), "Person", "o_custkey", "PARTICIPATED_IN", "Event", "o_orderkey"),
        kind(read("lineitem", "l_suppkey", "l_orderkey").distinct(), "Team", "l_suppkey", "PARTICIPATED_IN", "Event", "l_orderkey"),
        kind(read("customer", "c_custkey", "c_nationkey").distinct(), "Person", "c_custkey", "REPRESENTS", "Country", "c_nationkey"),
        kind(read("supplier", "s_suppkey", "s_nationkey").distinct(), "Team", "s_suppkey", "REPRESENTS", "Country", "s_nationkey"),
        kind(first, "Event", "l_orderkey", "HELD_AT", "Venue", "l_partkey"),
        kind(played, "Event", "l_orderkey", "BELONGS_TO", "Sport", "sport"),
    ]
    return reduce(DataFrame.unionByName, kinds)


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_type, v_id, name, year, description``; year 0 where a type has none."""
    return _run(spark, sf_dir, VERTEX_SQL)


def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk to entity and entity to vertex edges of the embeddings: chunk ``event_<vec_id>#c0000`` mentions an event, a person, a venue and a team, some also a country or a sport."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"))
    chunk = F.concat(F.lit("event_"), F.col("v"), F.lit("#c0000"))
    kinds = (("Event", "event", 7, 1499, 1), ("Person", "person", 3, 149, 1), ("Venue", "venue", 5, 199, 1), ("Team", "team", 2, 10, 1), ("Country", "country", 1, 25, 2), ("Sport", "sport", 11, 6, 3))
    targets = F.filter(F.array(*(F.when(F.col("v") % every == 0, F.struct(F.lit(t).alias("t"), F.concat(F.lit(f"{k}_"), (F.col("v") * m) % n + 1).alias("id"))) for t, k, m, n, every in kinds)), lambda x: x.isNotNull())
    rows = v.select(chunk.alias("chunk"), F.explode(targets).alias("x"))
    entity = F.concat(F.lit("entity_"), F.col("x.id"))
    mentions = rows.select(F.lit("Chunk").alias("src_type"), F.col("chunk").alias("src_id"), F.lit("MENTIONS").alias("edge_type"), F.lit("Entity").alias("dst_type"), entity.alias("dst_id"))
    resolves = rows.select(F.lit("Entity").alias("src_type"), entity.alias("src_id"), F.lit("RESOLVES_TO").alias("edge_type"), F.col("x.t").alias("dst_type"), F.col("x.id").alias("dst_id"))
    return mentions.unionByName(resolves.distinct())
