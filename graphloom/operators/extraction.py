"""Graph extraction from event pages: infobox, vertices, edges, entity hubs, mentions, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import country_id, team_id, vertex_id

#: The infobox header, medal slots, words for a vacant slot, and the patterns of titles, years and team events.
INFOBOX = "[Infobox Olympic event]"
MEDALS = [("gold", "goldNOC"), ("silver", "silverNOC"), ("bronze", "bronzeNOC"), ("gold2", "goldNOC2"), ("silver2", "silverNOC2"), ("bronze2", "bronzeNOC2")]
VACANT = ["vacant", "none", "tbd", "stripped"]
SPORT_TITLE = r"(?i)^(.+?) at the \d{4} (?:Summer|Winter) Olympics"
YEAR = r"\b(18\d\d|19\d\d|20\d\d)\b"
SOLO = r"(?i)\b(solo|individual)\b"
CREW = r"(?i)\b(49er|470|nacra(?:\s*17)?|yngling|group)\b"
TEAM = r"(?i)\b(team|relay|doubles|pairs?|duet|tournament|two-man|four-man|two-woman|coxless|coxed|eight|quadruple sculls|double sculls|synchronized|team pursuit|team sprint|ice dance)\b|4\s*[×x]\s*\d+|K-2|K-4|C-2|C-4"


SLOTS = range(len(MEDALS))


def infobox_body(text: Column) -> Column:
    """The text after the header up to a blank line; empty without a header."""
    return F.when(text.contains(INFOBOX), F.substring_index(F.substr(text, F.instr(text, F.lit(INFOBOX)) + len(INFOBOX)), "\n\n", 1)).otherwise("")


def body_field(body: Column, key: str) -> Column:
    """A key's last value as field() gives it, straight from the body: one pattern, whose greedy start finds the last line."""
    pattern = rf"(?s)^(?:.*\n)?[^\S\n]*{key}[^\S\n]*:([^\n]*)"
    return F.when(body.rlike(pattern), F.btrim(F.regexp_extract(body, pattern, 1)))


def infobox_pairs(text: Column) -> Column:
    """array<struct<key, value>> in line order: the lines after the header up to a blank line, cut at the first colon; lines without one are dropped."""
    lines = F.filter(F.split(infobox_body(text), "\n"), lambda x: x.contains(":"))
    return F.transform(lines, lambda x: F.struct(F.btrim(F.substring_index(x, ":", 1), F.lit(" \t\u000b\f\r")).alias("key"), F.btrim(F.substr(x, F.instr(x, F.lit(":")) + 1)).alias("value")))


def field(pairs: Column, key: str) -> Column:
    """A key's last value; null if it isn't there."""
    return F.try_element_at(F.filter(pairs, lambda p: p["key"] == key), F.lit(-1))["value"]


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def sport_of(title: Column) -> Column:
    return filled(F.regexp_extract(title, SPORT_TITLE, 1))


def year_of(games: Column, title: Column) -> Column:
    return F.coalesce(filled(F.regexp_extract(games, YEAR, 1)), filled(F.regexp_extract(title, YEAR, 1)), F.lit("0")).cast("int")


def is_team_event(title: Column, event: Column, teams: Column, competitors: Column) -> Column:
    """Solo words first, then crew classes, team words, and a teams field that differs from the competitors."""
    both = F.concat_ws(" ", title, event)
    n = lambda c: F.regexp_extract(c, r"(\d+)", 1)
    same = (n(teams) != "") & (n(competitors) != "") & (n(teams).try_cast("long") == n(competitors).try_cast("long"))
    return F.when(both.rlike(SOLO), F.lit(False)).when(both.rlike(CREW), F.lit(True)).when(title.rlike(TEAM) | event.rlike(TEAM), F.lit(True)).when(teams.isNull(), F.lit(False)).otherwise(~F.coalesce(same, F.lit(False)))


def once(rows: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` and ``columns``, each computed once a row: a generator of one row, which Spark doesn't copy into the uses of its columns as it does with a projection."""
    return rows.select(*keep, F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def read_fields(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``doc_id, title`` and the asked infobox keys of pages that have an infobox line: the body is cut into pairs once."""
    rows = docs.where(infobox_body(F.coalesce("text", F.lit(""))).contains(":")).withColumn("title", F.coalesce("title", F.lit("")))
    return once(once(rows, ["doc_id", "title"], {"pairs": infobox_pairs(F.col("text"))}), ["doc_id", "title"], {name: field(F.col("pairs"), key) for name, key in columns.items()})


#: The infobox keys of an event, and of its medal slots (w: winner, n: country code).
EVENT_KEYS = {k: k for k in ("event", "games", "venue", "venues", "teams", "competitors")}
SLOT_KEYS = {f"w{k}": m for k, (m, _) in enumerate(MEDALS)} | {f"n{k}": n for k, (_, n) in enumerate(MEDALS)}


def events(docs: DataFrame) -> DataFrame:
    """One row a page that has an infobox: identifiers, names, year, team flag, and the medal slots' winners and codes (``w0, n0, ...``)."""
    rows = read_fields(docs, EVENT_KEYS | SLOT_KEYS)
    named = {
        "event": F.coalesce(filled(F.col("event")), F.col("title")),
        "games": filled(F.col("games")),
        "venue": F.coalesce(filled(F.col("venue")), filled(F.col("venues"))),
    }
    rows = once(rows, ["doc_id", "title", "teams", "competitors", *SLOT_KEYS], named)
    found = {"sport": sport_of(F.col("title")), "year": year_of(F.coalesce("games", F.lit("")), F.col("title")), "team_event": is_team_event(F.col("title"), F.col("event"), F.col("teams"), F.col("competitors"))}
    return once(rows, rows.columns, found)


def medal_slots(found: DataFrame) -> DataFrame:
    """The six slots as rows ``doc_id, medal, winner, noc, team_event, vacant, noc_valid``; empty slots are left out."""
    slots = F.array(*(F.struct(F.lit(m).alias("medal"), F.col(f"w{k}").alias("winner"), F.col(f"n{k}").alias("noc")) for k, (m, _) in enumerate(MEDALS)))
    rows = found.select("doc_id", "team_event", F.explode(slots).alias("s")).select("doc_id", "team_event", "s.*").where(filled(F.col("winner")).isNotNull())
    noc = F.coalesce("noc", F.lit(""))
    return rows.withColumns({"vacant": F.lower("winner").isin(VACANT), "noc_valid": (F.length(noc) == 3) & (F.upper(noc) == noc) & noc.rlike("[A-Z]")})


def slot_columns(docs: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Event pages with an id column for each entity; every field, winner and id is computed once."""
    rows = events(docs)
    base = ["doc_id", "title", "event", "year", "sport", "venue", "team_event"]
    won = lambda k: filled(F.col(f"w{k}"))
    code = lambda k: F.coalesce(f"n{k}", F.lit(""))
    rows = once(rows, [*base, *(f"n{k}" for k in SLOTS)], {f"w{k}": F.when(~F.lower(won(k)).isin(VACANT), won(k)) for k in SLOTS})
    valid = lambda k: F.col(f"w{k}").isNotNull() & (F.length(code(k)) == 3) & (F.upper(code(k)) == code(k)) & code(k).rlike("[A-Z]")
    ids = {f"i{k}": F.when(F.col(f"w{k}").isNotNull(), F.when(F.col("team_event"), team_id(F.col(f"w{k}"), F.col("doc_id"), F.lit(m), ascii_only)).otherwise(vertex_id("person", F.col(f"w{k}"), ascii_only))) for k, (m, _) in enumerate(MEDALS)}
    nocs = {f"n{k}": F.when(valid(k), F.col(f"n{k}")) for k in SLOTS}
    named = {"sport_id": F.when(F.col("sport").isNotNull(), vertex_id("sport", F.col("sport"), ascii_only)), "venue_id": F.when(F.col("venue").isNotNull(), vertex_id("venue", F.col("venue"), ascii_only)), "kind": F.when(F.col("team_event"), "Team").otherwise("Person")}
    columns = ids | nocs | named
    if not ascii_only:  # the one Arrow function may not stand in a generator
        return rows.select(*base, *(f"w{k}" for k in SLOTS), *(c.alias(k) for k, c in columns.items()))
    return once(rows, [*base, *(f"w{k}" for k in SLOTS)], columns)


def _present(*structs: Column) -> Column:
    return F.array_compact(F.array(*structs))


def extract_graph(docs: DataFrame, ascii_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of event pages, each in one pass over the documents; see ``graph_of``."""
    return graph_of(slot_columns(docs, ascii_only))


def graph_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of ``slot_columns``.

    vertices: ``v_type, v_id, name, year, description``. Of writes to one id the first in doc_id order stays, for events the last.
    edges: ``src_type, src_id, edge_type, dst_type, dst_id``, distinct.
    """
    c, zero, blank = F.col, F.lit(0), F.lit("")

    def vertex(key: Column, kind: Column, name: Column, year: Column = zero, description: Column = blank) -> Column:
        return F.when(key.isNotNull(), F.struct(kind.alias("v_type"), key.alias("v_id"), name.alias("name"), year.cast("int").alias("year"), description.alias("description")))

    made = _present(
        vertex(c("doc_id"), F.lit("Event"), c("title"), c("year"), c("title")),
        vertex(c("sport_id"), F.lit("Sport"), c("sport")),
        vertex(c("venue_id"), F.lit("Venue"), c("venue")),
        *(vertex(c(f"i{k}"), c("kind"), c(f"w{k}")) for k in SLOTS),
        *(vertex(country_id(c(f"n{k}")), F.lit("Country"), c(f"n{k}")) for k in SLOTS),
    )
    found = rows.select(c("doc_id").alias("seq"), F.inline(made))
    written = F.struct("name", "year", "description")
    best = found.groupBy("v_type", "v_id").agg(F.min_by(written, F.struct("seq", "name")).alias("first"), F.max_by(written, F.struct("seq", "name")).alias("last"))
    vertices = best.select("v_type", "v_id", F.when(c("v_type") == "Event", c("last")).otherwise(c("first")).alias("r")).select("v_type", "v_id", "r.*")

    def edge(src_type: Column, src: Column, kind: str, dst_type: str, dst: Column) -> Column:
        return F.when(src.isNotNull() & dst.isNotNull(), F.struct(src_type.alias("src_type"), src.alias("src_id"), F.lit(kind).alias("edge_type"), F.lit(dst_type).alias("dst_type"), dst.alias("dst_id")))

    linked = _present(
        edge(F.lit("Event"), c("doc_id"), "BELONGS_TO", "Sport", c("sport_id")),
        edge(F.lit("Event"), c("doc_id"), "HELD_AT", "Venue", c("venue_id")),
        *(edge(c("kind"), c(f"i{k}"), "PARTICIPATED_IN", "Event", c("doc_id")) for k in SLOTS),
        *(edge(c("kind"), c(f"i{k}"), "REPRESENTS", "Country", country_id(c(f"n{k}"))) for k in SLOTS),
    )
    return vertices, rows.select(F.inline(linked)).distinct()


def entity_hub(vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, RESOLVES_TO edges): one entity ``entity_<v_id>`` for each domain vertex."""
    eid = F.concat(F.lit("entity_"), F.col("v_id"))
    entities = vertices.select(F.lit("Entity").alias("v_type"), eid.alias("v_id"), "name", F.col("v_type").alias("entity_type"), "description")
    edges = vertices.select(F.lit("Entity").alias("src_type"), eid.alias("src_id"), F.lit("RESOLVES_TO").alias("edge_type"), F.col("v_type").alias("dst_type"), F.col("v_id").alias("dst_id"))
    return entities, edges


def mentions(chunks: DataFrame, surfaces: DataFrame) -> DataFrame:
    """``chunk_id, entity_id``: chunks that hold an entity of their own document.

    chunks: ``document_id, chunk_id, text``; surfaces: ``document_id, entity_id, entity_type, surface``. An equi-join on the document, then
    containment: countries as whole words, sports and events in any case, others verbatim.
    """
    named = surfaces.where("surface <> ''").groupBy("document_id").agg(F.collect_set(F.struct("entity_id", "entity_type", "surface")).alias("named"))  # at most a page's entities
    rows = chunks.select("document_id", "chunk_id", "text").join(named, "document_id")
    # word bounds without a pattern made of data: no letter, digit or underscore beside the surface. Both forms are made once a chunk
    padded = F.concat(F.lit(" "), F.regexp_replace("text", r"[^\p{L}\p{N}_]", " "), F.lit(" "))
    rows = once(rows, ["chunk_id", "text", "named"], {"padded": padded, "low": F.lower("text")})

    def hit(e: Column) -> Column:
        s = e["surface"]
        return F.when(e["entity_type"] == "Country", F.col("padded").contains(F.concat(F.lit(" "), s, F.lit(" ")))).when(e["entity_type"].isin("Sport", "Event"), F.col("low").contains(F.lower(s))).otherwise(F.col("text").contains(s))

    return rows.select("chunk_id", F.explode(F.filter("named", hit)["entity_id"]).alias("entity_id")).distinct()


def document_surfaces(docs: DataFrame, ascii_only: bool = False) -> DataFrame:
    """The entities of each page with the text they would be mentioned by, in one pass: ``document_id, entity_id, entity_type, surface``."""
    rows = slot_columns(docs, ascii_only)
    c = F.col
    entity = lambda key, kind, s: F.when(key.isNotNull(), F.struct(F.concat(F.lit("entity_"), key).alias("entity_id"), kind.alias("entity_type"), s.alias("surface")))
    made = _present(
        entity(c("doc_id"), F.lit("Event"), c("event")),
        entity(c("sport_id"), F.lit("Sport"), c("sport")),
        entity(c("venue_id"), F.lit("Venue"), c("venue")),
        *(entity(c(f"i{k}"), c("kind"), c(f"w{k}")) for k in SLOTS),
        *(entity(country_id(c(f"n{k}")), F.lit("Country"), c(f"n{k}")) for k in SLOTS),
    )
    return rows.select(c("doc_id").alias("document_id"), F.inline(F.array_distinct(made)))


def sport_surfaces(docs: DataFrame, ascii_only: bool = False) -> DataFrame:
    """The rows of ``document_surfaces`` that are sports, which titles name: no infobox is cut into fields for them."""
    title = F.coalesce("title", F.lit(""))
    rows = once(docs.where(infobox_body(F.coalesce("text", F.lit(""))).contains(":")), ["doc_id"], {"sport": sport_of(title)}).where("sport IS NOT NULL")
    return rows.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("entity_"), vertex_id("sport", F.col("sport"), ascii_only)).alias("entity_id"), F.lit("Sport").alias("entity_type"), F.col("sport").alias("surface"))


def title_only(found: DataFrame, surfaces: DataFrame, kind: str = "Sport") -> DataFrame:
    """Entities of a kind that no chunk of their document mentions."""
    hit = found.select(F.substring_index("chunk_id", "#", 1).alias("document_id"), "entity_id").distinct()
    return surfaces.where(F.col("entity_type") == kind).join(hit, ["document_id", "entity_id"], "left_anti").select("document_id", "entity_id")


def extraction_stats(docs: DataFrame) -> DataFrame:
    """Counters of an extraction, one row."""
    ev = events(docs)
    per_doc = ev.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("sport").isNull()).alias("ambiguous_titles"),
        F.count_if(F.col("year") == 0).alias("missing_years"),
        F.count_if(F.col("venue").isNull()).alias("missing_venues"),
        F.count_if("team_event").alias("team_events"),
    )
    per_slot = medal_slots(ev).agg(
        F.count(F.lit(1)).alias("slots"),
        F.count_if("vacant").alias("vacant_slots"),
        F.count_if(~F.col("vacant") & ~F.col("noc_valid")).alias("invalid_nocs"),
        F.count_if(~F.col("vacant") & F.col("team_event")).alias("team_medals"),
        F.count_if(~F.col("vacant") & ~F.col("team_event")).alias("person_medals"),
    )
    one = F.lit(1)  # two tables of one row
    return per_doc.withColumn("k", one).join(per_slot.withColumn("k", one), "k").drop("k")


def integrity_errors(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``problem, edge_type, id`` of edges without an end, with an unknown target type, or with empty ids."""
    keys = vertices.select("v_type", "v_id")
    types = F.broadcast(keys.select("v_type").distinct())  # a graph has few types
    c = F.col
    end = lambda p, name: F.struct(F.lit(name).alias("problem"), c("edge_type").alias("edge_type"), c(f"{p}_type").alias("v_type"), c(f"{p}_id").alias("v_id"))
    ends = edges.select(F.inline(F.array(end("src", "missing_source"), end("dst", "missing_target"))))
    # the ends meet the vertices once, sorted by a number first: types and ids share their first signs
    key = lambda rows: rows.withColumn("_h", F.xxhash64("v_type", "v_id"))
    missing = key(ends).join(key(keys), ["_h", "v_type", "v_id"], "left_anti").select("problem", "edge_type", c("v_id").alias("id"))
    unknown = edges.select(c("dst_type").alias("v_type"), "edge_type", "dst_id").join(types, "v_type", "left_anti").select(F.lit("unknown_type").alias("problem"), "edge_type", c("dst_id").alias("id"))
    empty = edges.where((F.coalesce("src_id", F.lit("")) == "") | (F.coalesce("dst_id", F.lit("")) == "")).select(F.lit("empty_id").alias("problem"), "edge_type", F.coalesce("src_id", F.lit("")).alias("id"))
    return reduce(DataFrame.unionByName, [missing, unknown, empty])
