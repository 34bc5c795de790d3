"""Graph tools over vertex and edge tables, for whole batches of keys.

vertices: ``v_type, v_id, name, year, description``; edges: ``src_type, src_id, edge_type, dst_type, dst_id``, as a table or as an adjacency, of which only the asked keys are shuffled.
"The first n" means the n smallest ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import constant_date_score, normalized, normalized_constant
from ..sources.layout import Adjacency, per_key
from .expansion import capped

#: Fixed value: most events, participants and provenance steps of one call.
BOUND = 50


#: Up to so many asked events, their edges are taken out before names are joined; beyond, names are joined to all edges, which saves a shuffle.
FEW_EVENTS = 10_000


def hashed(df: DataFrame, *keys: str) -> DataFrame:
    """Adds ``_h``, a hash of the keys: what is sorted by it first compares one number for nearly all pairs, where ids share their first signs."""
    return df.withColumn("_h", F.xxhash64(*keys))


def nodes(vertices: DataFrame, ids: DataFrame) -> DataFrame:
    """Vertices of the given ``v_type, v_id``; unknown ids give no row."""
    return vertices.join(ids.select("v_type", "v_id").distinct(), ["v_type", "v_id"], "left_semi")


def edges_of(edges: DataFrame | Adjacency, ids: DataFrame, edge_type: str = "") -> DataFrame:
    """Edges that leave the given ``v_type, v_id``; an empty type means all types."""
    keys = ids.select(F.col("v_type").alias("src_type"), F.col("v_id").alias("src_id")).distinct()
    of_type = lambda rows: rows if not edge_type else rows.where(F.col("edge_type") == edge_type)
    return per_key(edges, "out", lambda rows: of_type(rows).join(keys, ["src_type", "src_id"], "left_semi"))


def _attributes(vertices: DataFrame, kind: str, id_name: str) -> DataFrame:
    return vertices.where(F.col("v_type") == kind).select(F.col("v_id").alias(id_name), "name", "year", "description")


def _first_events(parts: DataFrame, edges: DataFrame | Adjacency, bound: int) -> DataFrame:
    """``v_type, v_id, event_id``: the first ``bound`` events of persons and teams ``v_type, v_id``."""
    other = parts.where(~F.col("v_type").isin("Person", "Team")).limit(1)
    if other.take(1):
        raise ValueError("a participant is a Person or a Team")
    asked = hashed(parts.select("v_type", "v_id"), "v_type", "v_id")
    key = ["_h", "v_type", "v_id"]

    def first(rows: DataFrame) -> DataFrame:
        held = rows.where("edge_type = 'PARTICIPATED_IN'").select(F.col("src_type").alias("v_type"), F.col("src_id").alias("v_id"), F.col("dst_id").alias("event_id"))
        return capped(hashed(held, "v_type", "v_id").join(asked, key, "left_semi"), key, [F.col("event_id")], bound)

    return per_key(edges, "out", first).select("v_type", "v_id", "event_id")


def events_for_participants(parts: DataFrame, vertices: DataFrame, edges: DataFrame | Adjacency, bound: int = BOUND) -> DataFrame:
    """Events of persons and teams ``v_type, v_id``: the first ``bound`` of each, then their attributes (blank where unknown)."""
    first = hashed(_first_events(parts, edges, bound), "event_id")
    found = first.join(hashed(_attributes(vertices, "Event", "event_id").drop("description"), "event_id"), ["_h", "event_id"], "left")
    return found.select("v_type", "v_id", "event_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("year", F.lit(0)).alias("year"))


def first_edge(edges: DataFrame | Adjacency, kind: str, key: str, value: str) -> DataFrame:
    return per_key(edges, "out", lambda rows: rows.where(F.col("edge_type") == kind).groupBy(F.col("src_id").alias(key)).agg(F.min("dst_id").alias(value)))


def participants_of(event_ids: DataFrame, edges: DataFrame | Adjacency, bound: int = BOUND) -> DataFrame:
    """The first participants of events ``event_id``: ``event_id, v_type, v_id``."""
    ids = event_ids.select("event_id").distinct()

    def found(rows: DataFrame) -> DataFrame:
        part = rows.where("edge_type = 'PARTICIPATED_IN'").select(F.col("dst_id").alias("event_id"), F.col("src_type").alias("v_type"), F.col("src_id").alias("v_id"))
        return capped(part.join(ids, "event_id", "left_semi"), ["event_id"], [F.col("v_id")], bound)

    return per_key(edges, "into", found)


def _named_participants(ids: DataFrame, few: bool, vertices: DataFrame, edges: DataFrame | Adjacency, bound: int) -> DataFrame:
    """``_h, event_id, participants``: the first participants of events with their names. Unless they are few, events that nobody asked for may be among them."""
    names = vertices.select("v_type", "v_id", "name")
    if few or isinstance(edges, Adjacency):
        first = hashed(participants_of(ids, edges, bound).join(names, ["v_type", "v_id"], "left"), "event_id")
    else:
        part = edges.where("edge_type = 'PARTICIPATED_IN'").select(F.col("dst_id").alias("event_id"), F.col("src_type").alias("v_type"), F.col("src_id").alias("v_id"))
        part = hashed(part, "v_type", "v_id").join(hashed(names, "v_type", "v_id"), ["_h", "v_type", "v_id"], "left")
        first = capped(hashed(part.drop("_h"), "event_id"), ["_h", "event_id"], [F.col("v_id")], bound)
    person = F.struct(F.col("v_id").alias("id"), F.coalesce(F.nullif("name", F.lit("")), F.col("v_id")).alias("name"), F.col("v_type").alias("type"))
    return first.groupBy("_h", "event_id").agg(F.array_sort(F.collect_list(person)).alias("participants"))


def event_context(event_ids: DataFrame, vertices: DataFrame, edges: DataFrame | Adjacency, bound: int = BOUND) -> DataFrame:
    """Events ``event_id`` with their first sport and venue and the first participants, as an array of structs; a name falls back to the id."""
    key = ["_h", "event_id"]
    ids = event_ids.select("event_id").distinct()
    few = ids.limit(FEW_EVENTS + 1).count() <= FEW_EVENTS
    asked = hashed(F.broadcast(ids) if few else ids, "event_id")
    ev = hashed(_attributes(vertices, "Event", "event_id"), "event_id").join(asked, key, "left_semi")
    named = lambda kind, id_name: hashed(vertices.where(F.col("v_type") == kind).select(F.col("v_id").alias(id_name), F.col("name").alias(f"{id_name[:-3]}_name")), id_name)
    first = lambda kind: F.min(F.when(F.col("edge_type") == kind, F.col("dst_id")))

    def places(rows: DataFrame) -> DataFrame:
        rows = hashed(rows.where("edge_type IN ('BELONGS_TO', 'HELD_AT')").withColumnRenamed("src_id", "event_id"), "event_id")
        rows = rows.join(asked, key, "left_semi") if few else rows
        return rows.groupBy(*key).agg(first("BELONGS_TO").alias("sport_id"), first("HELD_AT").alias("venue_id"))

    placed, listed = per_key(edges, "out", places), _named_participants(F.broadcast(ids) if few else ids, few, vertices, edges, bound)
    rows = ev.join(placed, key, "left").join(listed, key, "left").drop("_h")
    rows = hashed(rows, "sport_id").join(named("Sport", "sport_id"), ["_h", "sport_id"], "left").drop("_h")
    rows = hashed(rows, "venue_id").join(named("Venue", "venue_id"), ["_h", "venue_id"], "left").drop("_h")
    return rows.select("event_id", "name", "year", "sport_id", "sport_name", "venue_id", "venue_name", F.coalesce("participants", F.array().cast("array<struct<id:string,name:string,type:string>>")).alias("participants"))


def _with_country(found: DataFrame, vertices: DataFrame) -> DataFrame:
    found = found.select(F.col("src_type").alias("v_type"), F.col("src_id").alias("v_id"), F.col("dst_id").alias("country_id"))
    return found.join(_attributes(vertices, "Country", "country_id"), "country_id", "left").select("v_type", "v_id", "country_id", F.coalesce(F.nullif("name", F.lit("")), F.col("country_id")).alias("country"))


def countries_of(parts: DataFrame, vertices: DataFrame, edges: DataFrame | Adjacency) -> DataFrame:
    return _with_country(edges_of(edges, parts, "REPRESENTS"), vertices)


def _represented(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The countries of all participants: as many rows as participants, so it costs less than to make those of many edges distinct."""
    return _with_country(edges.where("edge_type = 'REPRESENTS'"), vertices)


def filter_events(event_ids: DataFrame, vertices: DataFrame, edges: DataFrame | Adjacency, year: int | None = None, sport: str | None = None, venue_id: str | None = None, name: str | None = None, ascii_only: bool = False) -> DataFrame:
    """Events ``event_id`` that meet all given filters. Year first, the venue as a semi-join, names as normalized containment."""
    rows = _attributes(vertices, "Event", "event_id").join(event_ids.select("event_id").distinct(), "event_id", "left_semi")
    if year is not None:
        rows = rows.where(F.col("year") == year)
    norm = lambda c: normalized(c, ascii_only)
    if name:
        cue = F.lit(normalized_constant(name))
        rows = rows.where(norm(F.col("name")).contains(cue) | norm(F.col("description")).contains(cue))
    if venue_id:
        rows = rows.join(per_key(edges, "into", lambda e: e.where((F.col("edge_type") == "HELD_AT") & (F.col("dst_id") == venue_id)).select(F.col("src_id").alias("event_id"))), "event_id", "left_semi")
    if sport:
        cue = F.lit(normalized_constant(sport))
        sports = vertices.where("v_type = 'Sport'").select(F.col("v_id").alias("sport_id"), F.col("name").alias("sport_name"))
        fits = norm(F.coalesce("sport_name", F.lit(""))).contains(cue) | F.lower("sport_id").contains(cue)
        rows = rows.join(first_edge(edges, "BELONGS_TO", "event_id", "sport_id"), "event_id").join(sports, "sport_id", "left").where(fits).drop("sport_id", "sport_name")
    return rows.select("event_id", "name", "year", "description")


def _first_held(venues: DataFrame, edges: DataFrame | Adjacency, bound: int) -> DataFrame:
    """``venue_id, event_id``: the first ``bound`` events held at venues ``venue_id``."""
    ids = venues.select("venue_id").distinct()
    held = lambda rows: rows.where("edge_type = 'HELD_AT'").select(F.col("dst_id").alias("venue_id"), F.col("src_id").alias("event_id")).join(ids, "venue_id", "left_semi")
    return per_key(edges, "into", lambda rows: capped(held(rows), ["venue_id"], [F.col("event_id")], bound))


def events_for_venues(venues: DataFrame, vertices: DataFrame, edges: DataFrame | Adjacency, bound: int = BOUND, **filters) -> DataFrame:
    """Events held at venues ``venue_id``: the first ``bound`` of each venue, then filtered."""
    first = _first_held(venues, edges, bound)
    return first.join(filter_events(first, vertices, edges, **filters), "event_id").select("venue_id", "event_id", "name", "year")


def aggregate_countries(parts: DataFrame, vertices: DataFrame, edges: DataFrame | Adjacency, keys: list[str], bound: int = BOUND) -> DataFrame:
    """Distinct countries of the first participants of each group: ``keys, n_participants, n_countries, country_ids, countries``. A missing type means Person.

    The rows are shuffled twice: by participant, to meet its countries as one array, and by group.
    """
    typed = parts.select(*keys, F.coalesce("v_type", F.lit("Person")).alias("v_type"), "v_id")
    found = countries_of(typed.select("v_type", "v_id"), vertices, edges) if isinstance(edges, Adjacency) else _represented(vertices, edges)
    each = found.groupBy("v_type", "v_id").agg(F.array_sort(F.collect_set(F.struct("country_id", "country"))).alias("c"))
    rows = hashed(typed, "v_type", "v_id").join(hashed(each, "v_type", "v_id"), ["_h", "v_type", "v_id"], "left")
    group = ["_h", *keys]
    n = F.dense_rank().over(Window.partitionBy(*group).orderBy("v_id", "v_type"))
    first = hashed(rows, *keys).withColumn("n", n).where(F.col("n") <= bound)
    # participants without an id stand first and don't count
    counted = F.max("n") - F.coalesce(F.max(F.when(F.col("v_id").isNull(), F.col("n"))), F.lit(0))
    listed = F.filter(F.array_sort(F.array_distinct(F.flatten(F.collect_set("c")))), lambda x: x["country_id"].isNotNull())
    return (
        first.groupBy(*group)
        .agg(counted.cast("long").alias("n_participants"), listed.alias("c"))
        .select(*keys, "n_participants", F.size(F.array_distinct("c.country_id")).cast("long").alias("n_countries"), F.col("c.country_id").alias("country_ids"), F.col("c.country").alias("countries"))
    )


def composite(vertices: DataFrame, edges: DataFrame | Adjacency, parts: DataFrame | None = None, venues: DataFrame | None = None, cue: str = "", compat: bool = False, ascii_only: bool = False, **filters) -> dict[str, DataFrame]:
    """Participants' events that were held at the venues, filtered, ranked by a date cue, with context and countries.

    With ``compat`` an empty set of participants' events falls back to the venues' events; otherwise the intersection is
    meant. The first 10 events are expanded with a cue, else the first 50.
    """
    # ids only: the filter below reads the attributes of what is left
    of_parts = _first_events(parts, edges, BOUND).select("event_id") if parts is not None else None
    of_venues = _first_held(venues, edges, BOUND).select("event_id") if venues is not None else None
    if of_parts is None and of_venues is None:
        chosen = vertices.where("v_type = 'Event'").select(F.col("v_id").alias("event_id"))
    elif of_parts is None or (compat and of_venues is not None and not of_parts.take(1)):
        chosen = of_venues
    else:
        chosen = of_parts if of_venues is None else of_parts.join(of_venues, "event_id", "left_semi")
    kept = filter_events(chosen, vertices, edges, ascii_only=ascii_only, **filters)
    norm = lambda c: normalized(c, ascii_only)
    score = F.round(constant_date_score(cue, norm(F.concat_ws(" ", "name", "description"))), 6) if cue else F.lit(0.0)
    ranked = kept.withColumn("score", score)
    best = ranked.orderBy(F.col("score").desc(), "event_id").limit(10 if cue else BOUND)
    top = vertices.sparkSession.createDataFrame(best.collect(), best.schema)  # BOUND rows at most; the chain before isn't run again
    context = event_context(top, vertices, edges)
    takes = context.select("event_id", F.explode("participants").alias("p")).select(F.lit(1).alias("run"), F.col("p.type").alias("v_type"), F.col("p.id").alias("v_id"))
    return {"events": top, "context": context, "countries": aggregate_countries(takes, vertices, edges, ["run"])}
