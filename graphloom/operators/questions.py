"""Question analysis, routing, and structured questions over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import cut
from .containment import containing
from .extraction import filled

#: The patterns of venue, date and year in a question. The repair pattern stops at a comma.
VENUE = r"(?i)held at (.+?)(?: on | in \d{4}| in the| at the|\?|$)"
REPAIR_VENUE = r"(?i)held at (.+?)(?:,| on | in \d{4}| in the| at the|\?|$)"
DATE = r"(?i) on (.+?)(?:at the|\?|$)"
YEAR = r"\b(19\d\d|20\d\d)\b"


def _trimmed(c: Column) -> Column:
    return filled(F.regexp_replace(c, r"^[\s\-?]+|[\s\-?]+$", ""))


def analyse(questions: DataFrame) -> DataFrame:
    """Adds venue, repair_venue, date, year and the intent flags to ``qid, question``."""
    q = F.coalesce(F.col("question"), F.lit(""))
    low = F.lower(q)
    any_of = lambda *words: reduce_or([low.contains(w) for w in words])
    rows = questions.withColumns(
        {
            "venue": _trimmed(F.regexp_extract(q, VENUE, 1)),
            "repair_venue": _trimmed(F.regexp_extract(q, REPAIR_VENUE, 1)),
            "date": _trimmed(F.regexp_extract(q, DATE, 1)),
            "year": filled(F.regexp_extract(q, YEAR, 1)).cast("int"),
            "is_nation_lookup": any_of("how many nations competed in", "nations competed in"),
            "is_event_agg": any_of("had more than") | (low.contains("more than") & low.contains("competitors")),
            "is_superlative": any_of("highest number of competitors", "most competitors"),
            "is_temporal": any_of("immediately before"),
            "is_relational": any_of("represented", "competed", "participated", "won the gold medal in the event"),
        }
    )
    rows = rows.withColumn("is_nation_agg", F.col("is_nation_lookup") | any_of("how many nations", "which country", "which nation"))
    rows = rows.withColumn("is_venue", F.col("venue").isNotNull() | any_of("held at", "venue"))
    return rows.withColumn("is_structured", F.col("is_nation_lookup") | F.col("is_event_agg") | F.col("is_superlative") | F.col("is_temporal") | F.col("is_venue"))


def reduce_or(conditions: list[Column]) -> Column:
    found = conditions[0]
    for c in conditions[1:]:
        found = found | c
    return found


def route(questions: DataFrame) -> DataFrame:
    """Adds ``strategy``: structured and venue questions to the graph tools, other relational ones to expansion, the rest to vectors."""
    return analyse(questions).withColumn("strategy", F.when(F.col("is_structured") | F.col("is_venue") | F.col("is_nation_agg"), "structured").when(F.col("is_relational"), "expansion").otherwise("vector"))


def number_after(text: Column, label: str) -> Column:
    return filled(F.regexp_extract(text, rf"{label}:\s*(\d+)", 1)).cast("int")


def text_after(text: Column, label: str) -> Column:
    return filled(F.regexp_extract(text, rf"(?m)\b{label}: *([^\n]+)$", 1))


#: What a question after games names, and one after a count.
GAMES = ["sport", "year", "season"]
COUNTED = [*GAMES, "threshold"]


def _games(asked: DataFrame, docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Event pages of the asked sport and games, with their competitors ``n``: asked ``sport, year, season`` joined on these three, which the title names. Ask distinct games: the pages of one are many."""
    parts = docs.select("doc_id", "title", number_after(F.col("text"), "competitors").alias("n"), F.col(order).alias("_order"), F.lower(F.regexp_extract("title", r"(?i)^(.+?) at the (\d{4}) (Summer|Winter) Olympics", 1)).alias("_sport"), filled(F.regexp_extract("title", r"(?i)^(.+?) at the (\d{4}) (Summer|Winter) Olympics", 2)).cast("int").alias("_year"), F.lower(F.regexp_extract("title", r"(?i)^(.+?) at the (\d{4}) (Summer|Winter) Olympics", 3)).alias("_season"))
    keys = [F.lower("sport") == F.col("_sport"), F.col("year") == F.col("_year"), F.lower("season") == F.col("_season")]
    return asked.join(parts.where("_sport <> ''"), keys)


def count_over_threshold(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """Events of a sport and games with more than ``threshold`` competitors: ``qid, n``; 0 if there are none."""
    hits = _games(asked.select(*COUNTED).distinct(), docs).where("n > threshold").groupBy(*COUNTED).agg(F.count(F.lit(1)).alias("total"))
    return asked.select("qid", *COUNTED).join(hits, COUNTED, "left").select("qid", F.coalesce("total", F.lit(0)).alias("n"))


def superlative(asked: DataFrame, docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """The event with the most competitors, the first on ties: ``qid, doc_id, event, competitors``."""
    rows = _games(asked.select(*GAMES).distinct(), docs, order).where("n IS NOT NULL")
    best = rows.groupBy(*GAMES).agg(F.min_by(F.struct("doc_id", "title", "n"), F.struct((-F.col("n")).alias("a"), F.col("_order").alias("b"))).alias("r"))
    return asked.select("qid", *GAMES).join(best, GAMES).select("qid", "r.doc_id", F.btrim(F.element_at(F.split("r.title", "–"), -1)).alias("event"), F.col("r.n").alias("competitors"))


def lookup_nations(asked: DataFrame, docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Nations of the page with the asked title, else of the first page whose title contains it: ``qid, doc_id, nations``.

    Distinct phrases are looked up once, in distinct titles. The exact match is an equi-join; phrases that it leaves open go through the gram index of titles.
    """
    low = docs.select("doc_id", F.lower("title").alias("t"), number_after(F.col("text"), "nations").alias("nations"), F.col(order).alias("o"))
    low = cut(low.groupBy("t").agg(F.min_by(F.struct("doc_id", "nations"), "o").alias("page"), F.min("o").alias("o")))  # the first page of a title
    ask = asked.select("qid", F.lower("phrase").alias("p"))
    phrases = ask.select("p").where("p IS NOT NULL").distinct()
    first = lambda rows: rows.groupBy("p").agg(F.min_by("page", "o").alias("r"))
    exact = first(phrases.join(low, F.col("p") == F.col("t")))
    left = phrases.join(exact.select("p"), "p", "left_anti")
    loose = first(containing(left.withColumn("needles", F.array("p")), low, text="t", key="t"))
    return ask.join(exact.unionByName(loose), "p").select("qid", "r.doc_id", "r.nations")


def predecessor(docs: DataFrame) -> DataFrame:
    """For every event page the page of the same sport, season and event of the latest earlier games: ``doc_id, prev_doc_id, prev_year, prev_winner``.

    Games of one series are ordered by year; pages of one year count as one step, represented by the smallest doc_id.
    """
    rows = docs.select("doc_id", F.lower("sport").alias("sport"), "season", "event", F.col("yr").alias("year"), F.coalesce(text_after(F.col("text"), "gold"), text_after(F.col("text"), "champ")).alias("winner"))
    series = ["sport", "season", "event"]
    games = rows.groupBy(*series, "year").agg(F.min(F.struct("doc_id", "winner")).alias("r"))
    w = Window.partitionBy(*series).orderBy("year")
    before = games.select(*series, "year", F.lag("r").over(w).alias("p"), F.lag("year").over(w).alias("prev_year"))
    return rows.join(before, [*series, "year"]).select("doc_id", F.col("p.doc_id").alias("prev_doc_id"), "prev_year", F.col("p.winner").alias("prev_winner"))


def predecessor_games(year: Column, season: Column) -> Column:
    """Four years before; the Winter games of 1994 follow those of 1992."""
    return F.when((F.lower(season) == "winter") & (year == 1994), 1992).otherwise(year - 4)


#: How a question names the games before, the event, and words that name none.
BEFORE = r"immediately before (\d{4})"
MEDAL_EVENT = r"(?i)gold medal in the (.*?) event at the"
NOT_CUES = ["event", "the", "summer", "winter", "olympics"]


def predecessor_by_rule(asked: DataFrame, docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Questions ``qid, question`` after the winner at the games before a year: ``qid, doc_id, prev_year, season, event, winner``.

    The page is the first one whose title names the games four years before (1992 before the Winter games of 1994) and holds all words of the asked event. Titles are
    searched through their gram index. A question without such a year or page gives no row; one without an event takes the first page of the games.
    """
    q = F.coalesce(F.col("question"), F.lit(""))
    year = filled(F.regexp_extract(q, BEFORE, 1)).cast("int")
    rows = asked.select("qid", year.alias("year"), F.when(F.lower(q).contains("winter"), "Winter").otherwise("Summer").alias("season"), F.btrim(F.regexp_extract(q, MEDAL_EVENT, 1)).alias("event")).where("year IS NOT NULL")
    rows = rows.withColumn("prev_year", predecessor_games(F.col("year"), F.col("season")))
    words = F.filter(F.split(F.lower("event"), r"\s+"), lambda w: (w != "") & ~w.isin(NOT_CUES))
    games = F.concat_ws(" ", F.col("prev_year").cast("string"), F.col("season"), F.lit("Olympics"))
    rows = rows.withColumn("games", games).withColumn("needles", F.array_sort(F.array_distinct(F.concat(words, F.array(F.lower("games"))))))
    pages = docs.select("doc_id", "title", F.coalesce(filled(F.regexp_extract("text", r"gold:\s*([^\n]+)", 1)), filled(F.regexp_extract("text", r"champ:\s*([^\n]+)", 1)), F.lit("")).alias("w"), F.col(order).alias("o"))
    pages = cut(pages.groupBy("title").agg(F.min_by(F.struct("doc_id", "w"), "o").alias("page"), F.min("o").alias("o")).withColumn("t", F.lower("title")))  # the first page of a title
    found = containing(rows.select("games", "needles").distinct(), pages, text="t", key="title").where(F.col("title").contains(F.col("games")))
    best = found.groupBy("games", "needles").agg(F.min_by("page", "o").alias("r"))
    return rows.join(best, ["games", "needles"]).select("qid", "r.doc_id", "prev_year", "season", "event", F.btrim("r.w").alias("winner"))


#: Questions about the events of games, and the words before a title.
MORE_THAN = r"(?i)how many (.*?) events at the (\d{4}) (Summer|Winter) Olympics had more than (\d+) competitors"
HIGHEST = r"(?i)which (.*?) event at the (\d{4}) (Summer|Winter) Olympics had the highest number of competitors"
NATIONS_IN = r"(?i)how many nations competed in\s*"

STRUCTURED = ["qid", "rank", "document_id", "answer", "fact"]


def structured_answers(asked: DataFrame, docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """What the corpus answers to analysed questions: ``qid, rank, document_id, answer, fact``.

    Counts over a threshold, then superlatives, nation look-ups and predecessors: the first kind that a question belongs to and that finds something. A count is an
    answer even if it is 0 (a row without a document). Questions with no such answer give no row.
    """
    q = F.coalesce(F.col("question"), F.lit(""))
    at = lambda pattern, k: F.regexp_extract(q, pattern, k)
    games = lambda flag, pattern: asked.where(F.col(flag) & (at(pattern, 2) != "")).select("qid", F.btrim(F.lower(at(pattern, 1))).alias("sport"), at(pattern, 2).cast("int").alias("year"), at(pattern, 3).alias("season"), *([at(pattern, 4).cast("int").alias("threshold")] if pattern is MORE_THAN else []))
    row = lambda df, kind, rank, doc, answer, fact: df.select("qid", F.lit(kind).alias("kind"), rank.cast("int").alias("rank"), doc.alias("document_id"), answer.alias("answer"), fact.alias("fact"))
    of_games = F.concat_ws(" ", F.col("year").cast("string"), F.col("season"), F.lit("Olympics"))

    counted = games("is_event_agg", MORE_THAN)
    hits = _games(counted.select(*COUNTED).distinct(), docs, order).where("n > threshold")
    hits = hits.withColumns({"nth": F.row_number().over(Window.partitionBy(*COUNTED).orderBy("_order")), "total": F.count(F.lit(1)).over(Window.partitionBy(*COUNTED))})
    hits = cut(hits.select(*COUNTED, "nth", "total", "doc_id", F.format_string("Event %s at %s had %d competitors (> %d threshold).", "title", of_games, "n", "threshold").alias("fact")))
    listed = counted.select("qid", *COUNTED).join(hits, COUNTED, "left")
    counts = row(listed, 0, F.coalesce("nth", F.lit(1)), F.col("doc_id"), F.coalesce("total", F.lit(0)).cast("string"), F.col("fact"))

    asked_best = games("is_superlative", HIGHEST)
    best = superlative(asked_best, docs, order).join(asked_best, "qid")
    most = row(best, 1, F.lit(1), F.col("doc_id"), F.col("event"), F.format_string("Event %s had the highest number of competitors (%d) in %s at the %s.", "event", "competitors", "sport", of_games))

    phrase = F.btrim(F.regexp_replace(F.regexp_replace(q, NATIONS_IN, ""), r"\?+$", ""))
    found = lookup_nations(asked.where("is_nation_lookup").select("qid", phrase.alias("phrase")), docs, order).where("nations IS NOT NULL").join(docs.select("doc_id", "title"), "doc_id")
    nations = row(found, 2, F.lit(1), F.col("doc_id"), F.col("nations").cast("string"), F.format_string("%s had %d competing nations.", "title", "nations"))

    year = filled(F.regexp_extract("question", BEFORE, 1))
    before = predecessor_by_rule(asked.where("is_temporal").select("qid", "question"), docs, order).join(asked.select("qid", year.alias("target")), "qid")
    earlier = row(before, 3, F.lit(1), F.col("doc_id"), F.col("winner"), F.format_string("At the %d %s Olympics (held immediately before %s), the gold medal in %s was won by %s.", "prev_year", "season", "target", "event", "winner"))

    rows = counts.unionByName(most).unionByName(nations).unionByName(earlier)
    first = F.min("kind").over(Window.partitionBy("qid"))
    return rows.withColumn("first", first).where("kind = first").select(*STRUCTURED)


def grounded_at_venue(asked: DataFrame, docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Pages whose text holds the venue of ``qid, venue, date, year``, the year and all words of the date: ``qid, rank, document_id, answer, fact``, by the pages' order. Distinct cues are looked up once, through the gram index."""
    words = F.filter(F.split(F.lower(F.coalesce("date", F.lit(""))), r"[\s–-]+"), lambda w: F.length(w) > 1)
    needles = F.array_sort(F.array_distinct(F.concat(F.array(F.lower("venue")), F.coalesce(F.array(F.col("year").cast("string")), F.array().cast("array<string>")), words)))
    needles = F.filter(needles, lambda n: n.isNotNull())
    ask = asked.where("venue IS NOT NULL").withColumn("needles", needles)
    pages = docs.select("doc_id", "title", F.lower("text").alias("t"), F.btrim(F.coalesce(filled(F.regexp_extract("text", r"gold:\s*([^\n]+)", 1)), filled(F.regexp_extract("text", r"champ:\s*([^\n]+)", 1)), F.lit(""))).alias("winner"), F.col(order).alias("o"))
    found = containing(ask.select("needles").distinct(), pages, text="t", key="doc_id").drop("t")
    rank = F.row_number().over(Window.partitionBy("needles").orderBy("o"))
    found = found.withColumn("rank", rank)
    on = F.when(F.coalesce("date", F.lit("")) != "", F.concat(F.lit(" on "), F.col("date"))).otherwise("")
    fact = F.concat(F.lit("Event "), "title", F.lit(" held at "), "venue", on, F.lit(" won by "), F.when(F.col("winner") == "", "Unknown").otherwise(F.col("winner")), F.lit("."))
    return ask.join(found, "needles").select("qid", "rank", F.col("doc_id").alias("document_id"), F.col("winner").alias("answer"), fact.alias("fact"))


def grounded_in(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """Pages of the asked venue that hold every word of the date: ``qid, doc_id``; asked ``qid, venue, date``. Joined on the infobox's venue."""
    pages = docs.select("doc_id", "text", text_after(F.col("text"), "venue").alias("venue"))
    words = F.filter(F.split("date", r"\s+"), lambda w: w != "")
    return asked.join(pages, "venue").where(F.forall(words, lambda w: F.lower("text").contains(F.lower(w)))).select("qid", "doc_id")


def with_fallback(found: DataFrame, seeds: DataFrame, most: int = 10) -> DataFrame:
    """Results ``qid, doc_id``; a query without any gets its best vector documents ``qid, doc_id, rank``."""
    none = seeds.join(found.select("qid").distinct(), "qid", "left_anti").where(F.col("rank") <= most)
    return found.select("qid", "doc_id", F.lit("structured").alias("source")).unionByName(none.select("qid", "doc_id", F.lit("vector").alias("source")))
