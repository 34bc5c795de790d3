"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from ..operators import evaluation, expansion, extraction, questions
from ..sources.corpus import CORPUS_SQL, GRAPH_SQL, VERTEX_SQL
from .queries import ANSWERS_SQL, ASKED, KINDS_SQL, PHRASES_SQL, PREDECESSOR_SQL, QUESTIONS_SQL, ROUTED_SQL, RUNS_SQL

NAMES = ("orders", "customer", "nation", "lineitem", "supplier", "part", "events", "embeddings")


def bare(sql: str) -> str:
    for t in NAMES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("{nl}", "chr(10)")


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
SEEDS = f"""{V},
pairs AS (SELECT q.id AS qid, v.id AS id, round(1 - list_inner_product(q.e, v.e), 6) AS distance FROM v AS q JOIN v ON q.id <> v.id WHERE q.id % 100 = 0),
seeds AS (SELECT qid, id, distance, greatest(0.0, round(1 - distance, 6)) AS similarity, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS rank FROM pairs QUALIFY rank <= 20)"""
RANKS = f"""{SEEDS},
asked AS (SELECT id AS qid, label AS qtype FROM v WHERE id % 100 = 0),
hits AS (SELECT s.qid, min(s.rank) AS first_rank FROM seeds s JOIN v ON s.id = v.id JOIN asked a ON a.qid = s.qid AND a.qtype = v.label GROUP BY s.qid),
ranks AS (SELECT asked.*, first_rank FROM asked LEFT JOIN hits USING (qid))"""
METRICS = "count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN first_rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}" for k in (1, 5, 10, 20)) + ", round(avg(coalesce(1.0 / first_rank, 0.0)), 6) AS mrr"

EDGES = f"edges AS ({bare(GRAPH_SQL)})"
VERTICES = f"vertices AS ({bare(VERTEX_SQL)})"
CORPUS = f"corpus AS MATERIALIZED ({bare(CORPUS_SQL)})"
MENTIONS = """mentioned AS (
    SELECT concat('event_', vec_id, '#c0000') AS chunk_id, t AS v_type, i AS v_id, concat('entity_', i) AS entity_id FROM (
        SELECT vec_id, 'Event' AS t, concat('event_', (vec_id * 7) % 1499 + 1) AS i FROM embeddings
        UNION ALL SELECT vec_id, 'Person', concat('person_', (vec_id * 3) % 149 + 1) FROM embeddings
        UNION ALL SELECT vec_id, 'Venue', concat('venue_', (vec_id * 5) % 199 + 1) FROM embeddings
        UNION ALL SELECT vec_id, 'Team', concat('team_', (vec_id * 2) % 10 + 1) FROM embeddings
        UNION ALL SELECT vec_id, 'Country', concat('country_', vec_id % 25 + 1) FROM embeddings WHERE vec_id % 2 = 0
        UNION ALL SELECT vec_id, 'Sport', concat('sport_', (vec_id * 11) % 6 + 1) FROM embeddings WHERE vec_id % 3 = 0)),
resolved AS (SELECT DISTINCT entity_id, v_type, v_id FROM mentioned)"""
HOPS = f"""{SEEDS}, {EDGES}, {MENTIONS},
cseeds AS (SELECT qid, concat('event_', id, '#c0000') AS chunk_id, similarity, rank FROM seeds),
capped AS (SELECT chunk_id, entity_id FROM mentioned QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY entity_id) <= 5),
ents AS (SELECT s.*, c.entity_id FROM cseeds s JOIN capped c USING (chunk_id) WHERE s.rank <= 5),
verts AS (SELECT e.*, v_type, v_id FROM ents e JOIN resolved USING (entity_id)),
took AS (SELECT src_type AS v_type, src_id AS v_id, dst_id AS event_id FROM edges WHERE edge_type = 'PARTICIPATED_IN' QUALIFY row_number() OVER (PARTITION BY src_type, src_id ORDER BY dst_id) <= 5),
held AS (SELECT 'Venue' AS v_type, dst_id AS v_id, src_id AS event_id FROM edges WHERE edge_type = 'HELD_AT' QUALIFY row_number() OVER (PARTITION BY dst_id ORDER BY src_id) <= 10),
evs AS (SELECT verts.*, v_id AS event_id, 1 AS hop, concat(chunk_id, ' -> ', entity_id, ' -> Event ', v_id) AS prov FROM verts WHERE v_type = 'Event'
    UNION ALL SELECT verts.*, event_id, 2, concat(chunk_id, ' -> ', entity_id, ' -> ', v_type, ' ', v_id, ' -> Event ', event_id) FROM verts JOIN (SELECT * FROM took UNION ALL SELECT * FROM held) USING (v_type, v_id)),
derived AS (SELECT qid, concat(event_id, '#c0000') AS derived_id, event_id AS doc_id, round(similarity * pow(0.9, hop), 9) AS score, hop, chunk_id AS seed, rank AS seed_rank, concat(prov, ' -> Chunk ', event_id, '#c0000') AS prov
    FROM evs WHERE concat(event_id, '#c0000') <> chunk_id)"""


def merged(source: str) -> str:
    return f"""best AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY qid, derived_id ORDER BY score DESC, seed_rank, hop) = 1),
provs AS (SELECT qid, derived_id, CAST(count(DISTINCT prov) AS INTEGER) AS n_prov FROM {source} GROUP BY ALL),
merged AS (SELECT qid, derived_id, doc_id, score, hop, seed, n_prov FROM best JOIN provs USING (qid, derived_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, derived_id DESC) <= 20)"""


GATE = f"""questions AS ({bare(QUESTIONS_SQL).replace("vec_id / 100 % 5", "(vec_id // 100) % 5")}),
tops AS (SELECT qid, max(similarity) FILTER (rank = 1) AS top, max(similarity) FILTER (rank = 2) AS second FROM seeds GROUP BY qid),
gate AS (SELECT qid, reason <> 'vector_only' AS expand, reason FROM (
    SELECT qid, CASE {' '.join(f"WHEN regexp_matches(question, {sql_text('(?i)' + p)}) THEN 'relational_{k}'" for k, p in enumerate(expansion.RELATIONAL, 1))}
        WHEN top IS NULL THEN 'no_seeds' WHEN top < 0.72 THEN 'low_confidence' WHEN coalesce(round(top - second, 9), 1.0) < 0.015 AND top < 0.80 THEN 'low_margin' ELSE 'vector_only' END AS reason
    FROM questions LEFT JOIN tops USING (qid)))"""
FUSED = f"""{HOPS}, {GATE},
allowed AS (SELECT derived.* FROM derived JOIN gate USING (qid) WHERE expand),
{merged("allowed")},
fused AS (SELECT coalesce(s.qid, g.qid) AS qid, coalesce(s.chunk_id, g.derived_id) AS chunk_id, coalesce(split_part(s.chunk_id, '#', 1), g.doc_id) AS doc_id,
    round(CASE WHEN s.qid IS NOT NULL AND g.qid IS NOT NULL THEN s.similarity + 0.05 * g.score ELSE coalesce(s.similarity, g.score) END, 6) AS score,
    CASE WHEN s.qid IS NOT NULL AND g.qid IS NOT NULL THEN 'seed+graph' WHEN s.qid IS NOT NULL THEN 'seed' ELSE 'graph' END AS source,
    CASE WHEN s.qid IS NOT NULL THEN 0 ELSE g.hop END AS hop
    FROM cseeds s FULL JOIN merged g ON s.qid = g.qid AND s.chunk_id = g.derived_id)"""

PIECES = """docs AS (SELECT CAST(doc_id AS VARCHAR) AS doc, text AS t FROM documents WHERE text <> ''),
lines AS (SELECT doc, i, regexp_extract_all(t, '[^\\n]*\\n+|[^\\n]+')[i] AS line FROM docs, unnest(range(1, len(regexp_extract_all(t, '[^\\n]*\\n+|[^\\n]+')) + 1)) r(i) WHERE length(t) > 3072),
words AS (SELECT doc, i, j, regexp_extract_all(line, '\\S*\\s+|\\S+')[j] AS w FROM lines, unnest(range(1, len(regexp_extract_all(line, '\\S*\\s+|\\S+')) + 1)) r(j) WHERE length(line) > 3072),
pieces AS (
    SELECT doc, 0 AS i, 0 AS j, 0 AS k, t AS p, 0 AS big FROM docs WHERE length(t) <= 3072
    UNION ALL SELECT doc, i, 0, 0, line, 0 FROM lines WHERE length(line) <= 3072
    UNION ALL SELECT doc, i, j, 0, w, i FROM words WHERE length(w) <= 3072
    UNION ALL SELECT doc, i, j, k, substr(w, k * 3072 + 1, 3072), i * 1000000 + j FROM words, unnest(range(0, (length(w) + 3071) // 3072)) r(k) WHERE length(w) > 3072),
listed AS (SELECT doc, list(p ORDER BY i, j, k) AS ps, list({'n': length(p), 'big': CAST(big AS BIGINT), 'cur': 0::BIGINT, 'cut': []::BOOLEAN[]} ORDER BY i, j, k) AS st FROM pieces GROUP BY doc),
cuts AS (SELECT doc, ps, list_reduce(st, lambda a, p: {'n': p.n, 'big': p.big,
    'cur': CASE WHEN len(a.cut) = 0 OR a.big <> p.big OR a.cur + p.n > 3072 THEN p.n ELSE a.cur + p.n END,
    'cut': list_append(a.cut, len(a.cut) = 0 OR a.big <> p.big OR a.cur + p.n > 3072)}, {'n': 0::BIGINT, 'big': -1::BIGINT, 'cur': 0::BIGINT, 'cut': []::BOOLEAN[]}).cut AS cut FROM listed),
parts AS (SELECT doc, g, string_agg(p, '' ORDER BY k) AS sub FROM (
    SELECT doc, k, ps[k] AS p, len(list_filter(cut[1:k], lambda x: x)) AS g FROM cuts, unnest(range(1, len(ps) + 1)) r(k)) GROUP BY doc, g),
sized AS (SELECT doc, list(sub ORDER BY g) AS subs, list({'n': CAST(ceil(length(sub) / 4.0) AS BIGINT), 'cur': 0::BIGINT, 'cut': []::BOOLEAN[]} ORDER BY g) AS st FROM parts GROUP BY doc),
packs AS (SELECT doc, subs, list_reduce(st, lambda a, p: {'n': p.n, 'cur': CASE WHEN len(a.cut) = 0 OR a.cur + p.n > 768 THEN p.n ELSE a.cur + p.n END,
    'cut': list_append(a.cut, len(a.cut) > 0 AND a.cur + p.n > 768)}, {'n': 0::BIGINT, 'cur': 0::BIGINT, 'cut': []::BOOLEAN[]}).cut AS cut FROM sized),
texts AS (SELECT doc, c, string_agg(sub, '' ORDER BY k) AS text FROM (
    SELECT doc, k, subs[k] AS sub, len(list_filter(cut[1:k], lambda x: x)) AS c FROM packs, unnest(range(1, len(subs) + 1)) r(k)) GROUP BY doc, c),
chunks AS (SELECT doc AS document_id, printf('%s#c%04d', doc, c) AS chunk_id, CAST(c AS INTEGER) AS chunk_index,
    CAST(sum(length(text)) OVER w - length(text) AS INTEGER) AS source_start, CAST(sum(length(text)) OVER w AS INTEGER) AS source_end,
    CAST(ceil(length(text) / 4.0) AS INTEGER) AS token_count, text FROM texts WINDOW w AS (PARTITION BY doc ORDER BY c))"""

CAPTION = r"\|(?:alt=[^|]*|left\b|right\b|thumb\b|upright\b|\d*x?\d*px\b)"
UNITS = f"""{CORPUS},
split AS (SELECT doc_id, idx - 1 AS idx, regexp_extract_all(text, '(?s)(.+?(?:\\n\\n+|$))', 1)[idx] AS content FROM corpus, unnest(range(1, len(regexp_extract_all(text, '(?s)(.+?(?:\\n\\n+|$))', 1)) + 1)) r(idx)),
lined AS (SELECT *, sum(length(content)) OVER w AS source_end, lead(idx) OVER w IS NOT NULL AS nxt,
    list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM split WHERE content <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
measured AS (SELECT *, regexp_replace(ls[1], {sql_text('(?i)' + CAPTION)}, '', 'g') AS clean, len(list_filter(ls, lambda x: contains(regexp_replace(x, {sql_text('(?i)' + CAPTION)}, '', 'g'), '|'))) AS piped FROM lined),
units AS (SELECT doc_id, CAST(idx AS INTEGER) AS idx, content, source_end - length(content) AS source_start, CAST(source_end AS BIGINT) AS source_end,
    CASE WHEN starts_with(lower(ltrim(content)), '[infobox') THEN 'infobox'
        WHEN (starts_with(lower(ls[1]), 'results table') AND len(ls) > 1) OR (len(ls) = 1 AND len(regexp_extract_all(clean, '\\|')) >= 2 AND NOT regexp_matches(rtrim(clean), '[.!?]$')) OR (len(ls) <> 1 AND piped >= 2 AND piped / len(ls) >= 0.5) THEN 'table'
        WHEN nxt AND len(ls) = 1 AND length(ls[1]) BETWEEN 2 AND 80 AND NOT regexp_matches(ls[1], '\\||^[-*•]|^[-=_*]{{3,}}$|^[0-9]+$|[.!?:]$') THEN 'heading' ELSE 'prose' END AS unit_type FROM measured),
islands AS (SELECT *, coalesce(sum(CASE WHEN unit_type <> 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM units),
attached AS (SELECT doc_id, CAST(unit AS INTEGER) AS unit, arg_max(unit_type, idx) AS unit_type, CAST(min(source_start) AS BIGINT) AS source_start, max(source_end) AS source_end, string_agg(content, '' ORDER BY idx) AS content FROM islands GROUP BY ALL)"""

BOX = f"""{CORPUS},
boxes AS (SELECT doc_id, title, list_filter(string_split(split_part(substr(text, strpos(text, '[Infobox Olympic event]') + 23), chr(10) || chr(10), 1), chr(10)), lambda x: contains(x, ':')) AS ls FROM corpus WHERE contains(text, '[Infobox Olympic event]')),
pairs AS (SELECT doc_id, title, CAST(k - 1 AS INTEGER) AS pos, trim(split_part(ls[k], ':', 1)) AS key, trim(substr(ls[k], strpos(ls[k], ':') + 1)) AS value FROM boxes, unnest(range(1, len(ls) + 1)) r(k)),
fields AS (SELECT doc_id, any_value(title) AS title, {', '.join(f"arg_max(value, pos) FILTER (key = '{k}') AS {n}" for k, n in [('event', 'event0'), ('games', 'games'), ('venue', 'venue0'), ('teams', 'teams'), ('competitors', 'competitors'), ('gold', 'gold'), ('goldNOC', 'gold_noc'), ('silver', 'silver'), ('silverNOC', 'silver_noc')])} FROM pairs GROUP BY doc_id),
records AS (SELECT *, coalesce(event0, title) AS event, nullif(venue0, '') AS venue, nullif(regexp_extract(title, {sql_text(extraction.SPORT_TITLE)}, 1), '') AS sport,
    CAST(coalesce(nullif(regexp_extract(games, {sql_text(extraction.YEAR)}, 1), ''), nullif(regexp_extract(title, {sql_text(extraction.YEAR)}, 1), ''), '0') AS INTEGER) AS year FROM fields),
typed AS (SELECT *, CASE WHEN regexp_matches(title || ' ' || event, {sql_text(extraction.SOLO)}) THEN false WHEN regexp_matches(title || ' ' || event, {sql_text(extraction.CREW)}) THEN true
    WHEN regexp_matches(title, {sql_text(extraction.TEAM)}) OR regexp_matches(event, {sql_text(extraction.TEAM)}) THEN true WHEN teams IS NULL THEN false
    ELSE regexp_extract(teams, '\\d+') <> regexp_extract(competitors, '\\d+') END AS team_event FROM records),
slots AS (SELECT doc_id, team_event, medal, winner, noc, lower(winner) IN ('vacant', 'none', 'tbd', 'stripped') AS vacant, length(coalesce(noc, '')) = 3 AND upper(noc) = noc AS noc_valid FROM (
    SELECT doc_id, team_event, 'gold' AS medal, gold AS winner, gold_noc AS noc FROM typed UNION ALL SELECT doc_id, team_event, 'silver', silver, silver_noc FROM typed) WHERE winner <> ''),
slugged AS (SELECT *, trim(regexp_replace(lower(trim(regexp_replace(winner, '[^\\w\\s-]', '', 'g'))), '[-\\s]+', '_', 'g'), '_') AS slug FROM slots WHERE NOT vacant),
parts AS (SELECT *, CASE WHEN team_event THEN 'Team' ELSE 'Person' END AS v_type, CASE WHEN NOT team_event THEN concat('person_', slug) WHEN length(slug) BETWEEN 3 AND 100 THEN concat('team_', slug) ELSE concat('team_', doc_id, '_', medal) END AS v_id FROM slugged),
named AS (SELECT *, concat('sport_', replace(lower(sport), ' ', '_')) AS sport_id, concat('venue_', replace(lower(venue), ' ', '_')) AS venue_id FROM typed)"""
SURFACES = """surfaces AS (
    SELECT doc_id, concat('entity_', doc_id) AS entity_id, 'Event' AS t, event AS s FROM named
    UNION SELECT doc_id, concat('entity_', sport_id), 'Sport', sport FROM named WHERE sport IS NOT NULL
    UNION SELECT doc_id, concat('entity_', venue_id), 'Venue', venue FROM named WHERE venue IS NOT NULL
    UNION SELECT doc_id, concat('entity_', v_id), v_type, winner FROM parts
    UNION SELECT doc_id, concat('entity_country_', noc), 'Country', noc FROM parts WHERE noc_valid)"""
HIT = "CASE t WHEN 'Country' THEN contains(' ' || regexp_replace(text, '[^\\pL\\pN_]', ' ', 'g') || ' ', ' ' || s || ' ') WHEN 'Sport' THEN contains(lower(text), lower(s)) WHEN 'Event' THEN contains(lower(text), lower(s)) ELSE contains(text, s) END"

LOG = f"log AS MATERIALIZED ({bare(KINDS_SQL)})"
PHASED = f"""{LOG},
counted AS (SELECT *, sum(CASE WHEN kind = 'TOOL_CALLED' THEN 1 ELSE 0 END) OVER w AS tools, sum(CASE WHEN kind = 'REPAIR_ATTEMPTED' THEN 1 ELSE 0 END) OVER w AS repairs FROM log WINDOW w AS (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING)),
owned AS (SELECT *, CASE kind WHEN 'STRATEGY_CHOSEN' THEN 'STRATEGY_SELECTED' WHEN 'EVIDENCE_ADDED' THEN 'EVIDENCE_ACCUMULATED' WHEN 'ANSWER_PROPOSED' THEN 'VERIFYING'
    WHEN 'TOOL_CALLED' THEN CASE WHEN tools > 15 THEN 'FAILED' END WHEN 'REPAIR_ATTEMPTED' THEN CASE WHEN repairs > 1 THEN 'FAILED' ELSE 'REPAIRING' END END AS own FROM counted),
phased AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER w, 'INITIALIZED') AS phase0, bool_or(coalesce(own = 'FAILED', false)) OVER w AS dead FROM owned WINDOW w AS (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING))"""
ITEMS = f"""{LOG}, items AS (SELECT run, seq, CASE seq % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'graph' ELSE 'structured' END AS source_type, concat('s', seq % 23) AS source_id, concat('d', seq % 7) AS document_id FROM log)"""
LEDGER = """ledger AS (SELECT *, printf('ev-%04d', row_number() OVER (PARTITION BY run ORDER BY seq, source_id)) AS evidence_id FROM (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY run, source_id ORDER BY seq) = 1)),
ledger_docs AS (SELECT run, document_id, CAST(row_number() OVER (PARTITION BY run ORDER BY min(seq), document_id) AS INTEGER) AS position FROM ledger GROUP BY run, document_id)"""


def norm(c: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace({c}, '[^\\pL\\pN_\\s-]', ' ', 'g')), '\\s+', ' ', 'g'))"


VERIFIED = f"""{BOX},
asked AS (SELECT doc_id AS run, concat('Who won in ', CASE WHEN o_orderkey % 4 = 0 THEN '1950' ELSE CAST(yr AS VARCHAR) END, '?') AS question, CASE WHEN o_orderkey % 5 = 0 THEN 'Nobody at all' WHEN o_orderkey % 5 = 1 THEN '' ELSE c_name END AS answer FROM corpus),
facts AS (SELECT p.doc_id AS run, printf('ev-%04d', pos + 1) AS evidence_id, concat(key, ': ', value) AS fact FROM pairs p JOIN corpus c USING (doc_id) WHERE o_orderkey % 10 <> 3),
judged AS (SELECT run, answer, f.evidence_id, fact, {norm('answer')} AS a, {norm('fact')} AS f, substr(question, 12, 4) AS yr, list_filter(string_split({norm('answer')}, ' '), lambda t: length(t) > 2 OR regexp_matches(t, '[0-9]')) AS tokens FROM asked LEFT JOIN facts f USING (run)),
found AS (SELECT run, answer, count(f) AS n_facts, coalesce(bool_or(f IS NOT NULL AND (contains(f, a) OR (len(tokens) > 0 AND len(list_filter(tokens, lambda t: NOT contains(f, t))) = 0))), false) AS hit,
    coalesce(string_agg(evidence_id, ',' ORDER BY evidence_id) FILTER (contains(f, a)), '') AS supporting, coalesce(bool_or(contains(fact, yr)), false) AS seen FROM judged GROUP BY run, answer),
graded AS (SELECT *, CASE WHEN answer = '' THEN n_facts > 0 ELSE hit END AS grounded, CASE WHEN seen THEN 0 ELSE 1 END AS missing_years FROM found),
verdicts AS (SELECT run, n_facts, missing_years, grounded, supporting, CASE WHEN missing_years = 0 AND (grounded OR answer = '') AND n_facts > 0 THEN 'SUPPORTED' WHEN (NOT grounded AND answer <> '') OR missing_years > 0 THEN 'REPAIR_REQUIRED' ELSE 'INSUFFICIENT' END AS verdict,
    CASE WHEN missing_years = 0 AND (grounded OR answer = '') AND n_facts > 0 THEN NULL WHEN NOT grounded AND answer <> '' THEN 'retrieve_missing_gold_document' WHEN missing_years > 0 THEN 'filter_by_year_constraint' END AS focus, answer FROM graded)"""

RUNS = """runs AS (SELECT CAST(doc_id AS VARCHAR) AS qid, doc_id AS k, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic FROM labels),
a AS (SELECT qid, quality, toxic FROM runs WHERE k % 5 <> 0), b AS (SELECT qid, 1.0 - quality AS quality, toxic FROM runs WHERE k % 7 <> 0)"""
COMPARABLE = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[\\s\\-_–—]+', ' ', 'g'), '[^\\pL\\pN_\\s]', '', 'g'), 'kilometres?', 'km', 'g'))"
SCORED = f"""rows AS ({bare(ANSWERS_SQL)}),
ones(w, n) AS (VALUES ('zero', 0), ('one', 1), ('two', 2), ('three', 3), ('four', 4), ('five', 5), ('six', 6), ('seven', 7), ('eight', 8), ('nine', 9), ('ten', 10), ('eleven', 11), ('twelve', 12), ('thirteen', 13), ('fourteen', 14), ('fifteen', 15), ('sixteen', 16), ('seventeen', 17), ('eighteen', 18), ('nineteen', 19)),
tens(w, n) AS (VALUES ('twenty', 20), ('thirty', 30)),
spelling AS (SELECT list({{'w': w, 'n': n}}) AS spelt FROM (SELECT w, n FROM ones UNION ALL SELECT w, n FROM tens UNION ALL SELECT 'forty', 40 UNION ALL SELECT concat(tens.w, sep, ones.w), tens.n + ones.n FROM tens, ones, (VALUES ('-'), (' ')) s(sep) WHERE ones.n BETWEEN 1 AND 9)),
plain AS (SELECT qid, reference AS r, predicted AS p, {COMPARABLE('reference')} AS a, {COMPARABLE('predicted')} AS b,
    TRY_CAST(coalesce(CASE WHEN regexp_matches(trim(predicted), '^[0-9]+$') THEN trim(predicted) END, {', '.join(f"nullif(regexp_extract(trim(predicted), {sql_text('(?i)' + p)}, 1), '')" for p in evaluation.NUMBER_PATTERNS)}) AS BIGINT) AS number,
    ' ' || regexp_replace(predicted, '[^\\pL\\pN_]', ' ', 'g') || ' ' AS whole, predicted IN ('', 'INSUFFICIENT_EVIDENCE') OR (starts_with(predicted, 'Q') AND length(predicted) <= 10) AS void,
    regexp_extract_all(predicted, '\\b(\\d+)\\b', 1) || list_transform(list_filter(spelt, lambda x: contains(lower(predicted), x.w)), lambda x: CAST(x.n AS VARCHAR)) AS numbers, contains(lower(question), 'highest number of competitors') OR contains(lower(question), 'immediately before') AS exact FROM rows CROSS JOIN spelling),
tokens AS (SELECT *, list_filter(string_split(a, ' '), lambda t: length(t) > 2) AS ts FROM plain),
scored AS (SELECT qid, CASE WHEN void THEN 'CONFIRMED_INCORRECT' WHEN regexp_matches(r, '^[0-9]+$') THEN CASE WHEN CASE WHEN number IS NOT NULL THEN number = TRY_CAST(r AS BIGINT) ELSE contains(whole, ' ' || r || ' ') END THEN 'CONFIRMED_CORRECT' ELSE 'CONFIRMED_INCORRECT' END
        WHEN contains(b, a) THEN 'CONFIRMED_CORRECT' WHEN exact THEN 'CONFIRMED_INCORRECT' WHEN len(list_filter(ts, lambda t: contains(b, t))) > 0 THEN 'MANUAL_REVIEW' ELSE 'CONFIRMED_INCORRECT' END AS strict,
    CASE WHEN void THEN false WHEN regexp_matches(r, '^[0-9]+$') THEN list_contains(numbers, r)
        ELSE contains(b, a) OR contains(a, b) OR (len(ts) > 0 AND len(list_filter(ts, lambda t: contains(b, t))) >= least(2, len(ts))) END AS lenient FROM tokens)"""
GAMES = f"""{CORPUS}, asked(qid, sport, year, season, threshold) AS (VALUES {', '.join(f"({q}, '{s}', {y}, '{g}', {t})" for q, s, y, g, t in ASKED)}),
games AS (SELECT qid, threshold, c.* FROM asked a JOIN corpus c ON a.sport = c.sport AND a.year = c.yr AND a.season = c.season)"""

PARTICIPANT_EVENTS = "SELECT src_type AS v_type, src_id AS v_id, dst_id AS event_id FROM edges WHERE edge_type = 'PARTICIPATED_IN' QUALIFY row_number() OVER (PARTITION BY src_type, src_id ORDER BY dst_id) <= 50"
COUNTRIES = """named_countries AS (SELECT e.src_type AS v_type, e.src_id AS v_id, e.dst_id AS country_id, coalesce(nullif(name, ''), e.dst_id) AS country FROM edges e LEFT JOIN vertices v ON v.v_type = 'Country' AND v.v_id = e.dst_id WHERE edge_type = 'REPRESENTS')"""
SPORTS = "sports AS (SELECT src_id AS event_id, min(dst_id) AS sport_id FROM edges WHERE edge_type = 'BELONGS_TO' GROUP BY src_id)"
COMPOSITE = f"""{EDGES}, {VERTICES},
pe AS (SELECT DISTINCT event_id FROM ({PARTICIPANT_EVENTS}) WHERE v_type = 'Team'),
ve AS (SELECT DISTINCT event_id FROM (SELECT src_id AS event_id FROM edges WHERE edge_type = 'HELD_AT' QUALIFY row_number() OVER (PARTITION BY dst_id ORDER BY src_id) <= 50)),
kept AS (SELECT v_id AS event_id, name, year, description, {norm("name || ' ' || description")} AS t FROM vertices WHERE v_type = 'Event' AND v_id IN (SELECT event_id FROM pe) AND v_id IN (SELECT event_id FROM ve) AND (contains({norm('name')}, 'urgent') OR contains({norm('description')}, 'urgent'))),
top AS (SELECT event_id, name, year, round(CASE WHEN contains(t, 'urgent f') THEN 100.0 ELSE 0.0 END + 10.0 * (CASE WHEN contains(t, 'urgent') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'f') THEN 1 ELSE 0 END) / 2, 6) AS score FROM kept ORDER BY score DESC, event_id LIMIT 10)"""

ROUTED = f"""x AS (SELECT qid, question, lower(question) AS l,
            nullif(regexp_replace(regexp_extract(question, {sql_text(questions.VENUE)}, 1), '^[\\s\\-?]+|[\\s\\-?]+$', '', 'g'), '') AS venue, nullif(regexp_replace(regexp_extract(question, {sql_text(questions.REPAIR_VENUE)}, 1), '^[\\s\\-?]+|[\\s\\-?]+$', '', 'g'), '') AS repair_venue,
            nullif(regexp_replace(regexp_extract(question, {sql_text(questions.DATE)}, 1), '^[\\s\\-?]+|[\\s\\-?]+$', '', 'g'), '') AS date, CAST(nullif(regexp_extract(question, {sql_text(questions.YEAR)}, 1), '') AS INTEGER) AS year FROM q),
        f AS (SELECT *, contains(l, 'nations competed in') AS is_nation_lookup, contains(l, 'had more than') OR (contains(l, 'more than') AND contains(l, 'competitors')) AS is_event_agg,
            contains(l, 'highest number of competitors') OR contains(l, 'most competitors') AS is_superlative, contains(l, 'immediately before') AS is_temporal,
            contains(l, 'represented') OR contains(l, 'competed') OR contains(l, 'participated') OR contains(l, 'won the gold medal in the event') AS is_relational FROM x),
        g AS (SELECT *, is_nation_lookup OR contains(l, 'how many nations') OR contains(l, 'which country') OR contains(l, 'which nation') AS is_nation_agg, venue IS NOT NULL OR contains(l, 'held at') OR contains(l, 'venue') AS is_venue FROM f),
routed AS (SELECT * EXCLUDE (l), CASE WHEN is_nation_agg OR is_event_agg OR is_superlative OR is_temporal OR is_venue THEN 'structured' WHEN is_relational THEN 'expansion' ELSE 'vector' END AS strategy FROM g)"""


def _ledgered(name: str, source: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY run, source_id ORDER BY seq) = 1)"


def _verified(name: str, ledger: str) -> str:
    """Verdicts of the runs by the facts of a ledger."""
    return f"""{name}_j AS (SELECT r.run, r.answer, years, fact, {norm('r.answer')} AS a, {norm('fact')} AS f, list_filter(string_split({norm('r.answer')}, ' '), lambda t: length(t) > 2 OR regexp_matches(t, '[0-9]')) AS tokens FROM said r LEFT JOIN {ledger} l USING (run)),
{name}_g AS (SELECT run, answer, years, count(fact) AS n_facts, coalesce(bool_or(fact IS NOT NULL AND (contains(f, a) OR (len(tokens) > 0 AND len(list_filter(tokens, lambda t: NOT contains(f, t))) = 0))), false) AS hit, coalesce(string_agg(fact, chr(1)), '') AS facts FROM {name}_j GROUP BY run, answer, years),
{name}_v AS (SELECT run, n_facts, CASE WHEN answer = '' THEN n_facts > 0 ELSE hit END AS grounded, answer = '' AS blank, len(list_filter(years, lambda y: NOT contains(facts, y))) AS missing FROM {name}_g),
{name} AS MATERIALIZED (SELECT run, n_facts, CASE WHEN missing = 0 AND (grounded OR blank) AND n_facts > 0 THEN 'SUPPORTED' WHEN (NOT grounded AND NOT blank) OR missing > 0 THEN 'REPAIR_REQUIRED' ELSE 'INSUFFICIENT' END AS verdict FROM {name}_v)"""


def _venue_items(name: str, asked: str) -> str:
    """Events at the venues of ``asked`` (qid, cue, date, year) and their participants, in order."""
    slug = "trim(regexp_replace(lower(trim(regexp_replace(cue, '[^\\w\\s-]', '', 'g'))), '[-\\s]+', '_', 'g'), '_')"
    score = f"CASE WHEN date IS NULL THEN 0.0 ELSE CASE WHEN contains(t, d) THEN 100.0 ELSE 0.0 END + 10.0 * len(list_filter(string_split(d, ' '), lambda x: contains(t, x))) / len(string_split(d, ' ')) END"
    return f"""{name}_h AS (SELECT a.qid, v_id AS event_id, name, v.year, description, a.date, {norm('a.date')} AS d, {norm("name || ' ' || description")} AS t
    FROM {asked} a JOIN edges e ON edge_type = 'HELD_AT' AND dst_id = concat('venue_', {slug}) JOIN vertices v ON v_type = 'Event' AND v_id = src_id WHERE a.year IS NULL OR a.year = v.year),
{name}_e AS (SELECT *, CASE WHEN date IS NULL THEN 50 ELSE 10 END AS most, row_number() OVER (PARTITION BY qid ORDER BY {score} DESC, event_id) AS nth FROM {name}_h),
{name} AS MATERIALIZED (SELECT qid AS run, row_number() OVER (PARTITION BY qid ORDER BY part, nth, p, source_id) AS seq, source_id, document_id, fact, who FROM (
    SELECT qid, 0 AS part, nth, '' AS p, concat('Event:', event_id) AS source_id, event_id AS document_id, printf('Event %s (%d): %s', name, year, description) AS fact, '' AS who FROM {name}_e
    UNION ALL SELECT qid, 1, nth, p.v_id, concat(p.v_type, ':', p.v_id), event_id, concat(p.v_type, ' ', w.name, ' participated in event ', event_id), w.name FROM {name}_e JOIN first_parts p USING (event_id) JOIN vertices w ON w.v_type = p.v_type AND w.v_id = p.v_id WHERE nth <= most))"""


_IN_GAMES = "(?i){0} (.*?) event{1} at the (\\d{{4}}) (Summer|Winter) Olympics had {2}"
_ADDED = _IN_GAMES.format("how many", "s", "more than (\\d+) competitors")
_HIGHEST = _IN_GAMES.format("which", "", "the highest number of competitors")
_WINNER = "CASE WHEN o_orderkey % 11 = 0 THEN 'Vacant' ELSE c_name END"
ORCHESTRATED = f"""{CORPUS}, {EDGES}, {VERTICES}, {MENTIONS}, q AS ({RUNS_SQL.replace("{corpus}", "corpus")}), {ROUTED},
titles AS (SELECT title, lower(title) AS t, min(o_orderkey) AS o FROM corpus GROUP BY ALL),
sq AS MATERIALIZED (SELECT * FROM routed WHERE strategy = 'structured'),
c1 AS (SELECT qid, lower(trim(regexp_extract(question, '{_ADDED}', 1))) AS sport, CAST(regexp_extract(question, '{_ADDED}', 2) AS INTEGER) AS yr, regexp_extract(question, '{_ADDED}', 3) AS season, CAST(regexp_extract(question, '{_ADDED}', 4) AS INTEGER) AS least FROM sq WHERE is_event_agg AND regexp_matches(question, '{_ADDED}')),
h1 AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY o_orderkey) AS nth, count(*) OVER (PARTITION BY qid) AS n, printf('Event %s at %d %s Olympics had %d competitors (> %d threshold).', title, c.yr, c.season, competitors, least) AS fact
    FROM c1 JOIN corpus c ON lower(c.sport) = c1.sport AND c.yr = c1.yr AND c.season = c1.season WHERE competitors > least),
c2 AS (SELECT qid, lower(trim(regexp_extract(question, '{_HIGHEST}', 1))) AS sport, CAST(regexp_extract(question, '{_HIGHEST}', 2) AS INTEGER) AS yr, regexp_extract(question, '{_HIGHEST}', 3) AS season FROM sq WHERE is_superlative AND regexp_matches(question, '{_HIGHEST}')),
h2 AS (SELECT qid, doc_id, event, printf('Event %s had the highest number of competitors (%d) in %s at the %d %s Olympics.', event, competitors, c2.sport, c.yr, c.season) AS fact
    FROM c2 JOIN corpus c ON lower(c.sport) = c2.sport AND c.yr = c2.yr AND c.season = c2.season QUALIFY row_number() OVER (PARTITION BY qid ORDER BY competitors DESC, o_orderkey) = 1),
c3 AS (SELECT qid, lower(trim(rtrim(regexp_replace(question, '(?i)how many nations competed in\\s*', ''), '?'))) AS p FROM sq WHERE is_nation_lookup),
b3 AS (SELECT p, o FROM (SELECT DISTINCT p FROM c3) JOIN titles ON contains(t, p) QUALIFY row_number() OVER (PARTITION BY p ORDER BY t <> p, o) = 1),
c4 AS (SELECT qid, regexp_extract(question, 'immediately before ([0-9]{{4}})', 1) AS y, CASE WHEN contains(lower(question), 'winter') THEN 'Winter' ELSE 'Summer' END AS season, trim(regexp_extract(question, '(?i)gold medal in the (.*?) event at the', 1)) AS cue FROM sq WHERE is_temporal),
k4 AS (SELECT *, CASE WHEN season = 'Winter' AND y = '1994' THEN 1992 ELSE CAST(y AS INTEGER) - 4 END AS prev, list_filter(string_split(lower(cue), ' '), lambda w: w NOT IN ('', 'event', 'the', 'summer', 'winter', 'olympics')) AS ws FROM c4 WHERE y <> ''),
b4 AS (SELECT prev, season, ws, min(o) AS o FROM (SELECT DISTINCT prev, season, ws FROM k4) JOIN titles ON contains(title, concat(prev, ' ', season, ' Olympics')) AND len(list_filter(ws, lambda w: NOT contains(t, w))) = 0 GROUP BY ALL),
told AS (SELECT qid, 0 AS kind, coalesce(nth, 1) AS rank, doc_id, CAST(coalesce(n, 0) AS VARCHAR) AS answer, fact FROM c1 LEFT JOIN h1 USING (qid)
    UNION ALL SELECT qid, 1, 1, doc_id, event, fact FROM h2
    UNION ALL SELECT qid, 2, 1, doc_id, CAST(nations AS VARCHAR), printf('%s had %d competing nations.', title, nations) FROM c3 JOIN b3 USING (p) JOIN corpus ON o_orderkey = o
    UNION ALL SELECT qid, 3, 1, doc_id, {_WINNER}, printf('At the %d %s Olympics (held immediately before %s), the gold medal in %s was won by %s.', prev, k4.season, y, cue, {_WINNER}) FROM k4 JOIN b4 USING (prev, season, ws) JOIN corpus ON o_orderkey = o),
given AS MATERIALIZED (SELECT * FROM told QUALIFY kind = min(kind) OVER (PARTITION BY qid)),
open_q AS MATERIALIZED (SELECT qid, venue AS cue, date, year, list_filter(regexp_split_to_array(lower(coalesce(date, '')), '[\\s–-]+'), lambda w: length(w) > 1) AS ws FROM sq WHERE qid NOT IN (SELECT qid FROM given)),
first_parts AS (SELECT dst_id AS event_id, src_type AS v_type, src_id AS v_id FROM edges WHERE edge_type = 'PARTICIPATED_IN' QUALIFY row_number() OVER (PARTITION BY dst_id ORDER BY src_id) <= 50),
{_venue_items("found", "(SELECT * FROM open_q WHERE cue IS NOT NULL)")},
cues AS (SELECT DISTINCT cue, year, ws FROM open_q WHERE cue IS NOT NULL),
pages AS (SELECT cue, year, ws, doc_id, title, {_WINNER} AS winner, row_number() OVER (PARTITION BY cue, year, ws ORDER BY o_orderkey) AS nth FROM cues JOIN corpus ON contains(lower(text), lower(cue)) AND (year IS NULL OR contains(text, CAST(year AS VARCHAR))) AND len(list_filter(ws, lambda w: NOT contains(lower(text), w))) = 0),
grounded_p AS MATERIALIZED (SELECT qid, nth, doc_id, winner, concat('Event ', title, ' held at ', o.cue, CASE WHEN coalesce(date, '') <> '' THEN concat(' on ', date) ELSE '' END, ' won by ', winner, '.') AS fact FROM open_q o JOIN pages p ON o.cue = p.cue AND o.year IS NOT DISTINCT FROM p.year AND o.ws = p.ws),
sd AS (SELECT concat('q', o_orderkey) AS qid, concat('event_', (o_orderkey * 7 + k * 13) % 500, '#c0000') AS chunk_id, 0.9::DOUBLE - k * (o_orderkey % 5) / 200 AS similarity, k AS rank FROM corpus, range(1, 13) r(k)),
seeds AS MATERIALIZED (SELECT sd.* FROM sd JOIN routed USING (qid) WHERE strategy = 'expansion' UNION ALL SELECT concat('r:', qid), chunk_id, similarity, rank FROM sd WHERE rank <= 10),
cseeds AS (SELECT * FROM seeds), questions AS (SELECT qid, question FROM q UNION ALL SELECT concat('r:', qid), question FROM q),
{HOPS[HOPS.index("capped AS"):]}, {GATE[GATE.index("tops AS"):]}, {FUSED[FUSED.index("allowed AS"):]},
evidence AS MATERIALIZED (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id DESC) AS nth, chunk_id, doc_id, printf('Evidence for %s score=%.4f', doc_id, score) AS fact FROM fused),
answered AS (SELECT qid FROM given UNION SELECT run FROM found UNION SELECT qid FROM grounded_p),
near AS (SELECT sd.*, strategy FROM sd JOIN routed USING (qid) WHERE strategy = 'vector' OR (strategy = 'structured' AND qid NOT IN (SELECT qid FROM answered))),
graph AS (SELECT qid AS run, rank AS seq, concat('Event:', doc_id) AS source_id, doc_id AS document_id, fact, answer FROM given
    UNION ALL SELECT run, seq + 1000000, source_id, document_id, fact, who FROM found UNION ALL SELECT qid, nth + 1000000000, concat('Event:', doc_id), doc_id, fact, winner FROM grounded_p),
every AS MATERIALIZED (SELECT run, seq, source_id, document_id, fact, true AS kept FROM graph WHERE document_id IS NOT NULL
    UNION ALL SELECT qid, rank, chunk_id, split_part(chunk_id, '#', 1), concat('Chunk ', chunk_id), rank <= CASE WHEN strategy = 'vector' THEN 10 ELSE 5 END FROM near
    UNION ALL SELECT qid, nth, chunk_id, doc_id, fact, nth <= 10 FROM evidence WHERE qid NOT LIKE 'r:%'),
items AS (SELECT * EXCLUDE (kept) FROM every WHERE kept),
ranked AS (SELECT run, document_id, row_number() OVER (PARTITION BY run ORDER BY min(seq), document_id) AS rank FROM every GROUP BY run, document_id),
firsts AS (SELECT run, arg_min(answer, seq) AS answer FROM graph WHERE answer <> '' GROUP BY run),
said AS MATERIALIZED (SELECT r.qid AS run, strategy, coalesce(f.answer, CASE WHEN strategy <> 'structured' THEN document_id END, '') AS answer, list_distinct(regexp_extract_all(question, '\\b(19\\d\\d|20\\d\\d)\\b', 1)) AS years
    FROM routed r LEFT JOIN firsts f ON f.run = r.qid LEFT JOIN ranked t ON t.run = r.qid AND rank = 1),
{_ledgered("kept", "items")},
{_verified("verdicts", "kept")},
wanted AS (SELECT qid, repair_venue AS cue, CAST(NULL AS VARCHAR) AS date, year FROM routed WHERE qid IN (SELECT run FROM verdicts WHERE verdict = 'REPAIR_REQUIRED')),
{_venue_items("again", "(SELECT * FROM wanted WHERE cue IS NOT NULL)")},
after AS (SELECT run, max(seq) AS last FROM kept GROUP BY run),
more AS MATERIALIZED (SELECT run, seq + coalesce(last, 0) AS seq, source_id, document_id, fact, plan FROM (
    SELECT run, seq, source_id, document_id, fact, 'composite' AS plan FROM again
    UNION ALL SELECT w.qid, nth, chunk_id, doc_id, fact, 'expansion' FROM evidence e JOIN wanted w ON e.qid = concat('r:', w.qid) WHERE w.qid NOT IN (SELECT run FROM again)) LEFT JOIN after USING (run)),
repaired AS (SELECT qid AS run, coalesce(any_value(plan), 'expansion') AS plan, count(m.run) AS recovered FROM wanted LEFT JOIN more m ON m.run = qid GROUP BY qid),
{_ledgered("whole", "(SELECT * FROM items UNION ALL SELECT run, seq, source_id, document_id, fact FROM more)")},
{_verified("final", "whole")}"""

STEPS = """SELECT qid, concat('Chunk ', chunk_id) AS s, 'MENTIONS' AS k, concat('Entity ', entity_id) AS t, 1 AS hop FROM ents
        UNION ALL SELECT qid, concat('Entity ', entity_id), 'RESOLVES_TO', concat(v_type, ' ', v_id), 1 FROM verts
        UNION ALL SELECT qid, concat(v_type, ' ', v_id), edge_type, concat(dst_type, ' ', dst_id), 2 FROM verts JOIN edges ON src_type = v_type AND src_id = v_id WHERE edge_type IN ('BELONGS_TO', 'HELD_AT', 'REPRESENTS')
        UNION ALL SELECT qid, concat(v_type, ' ', v_id), CASE WHEN v_type = 'Venue' THEN 'reverse_HELD_AT' ELSE 'PARTICIPATED_IN' END, concat('Event ', event_id), 2 FROM evs WHERE hop = 2"""

SQL: dict[str, str] = {
    "knn_topk": f"WITH {SEEDS} SELECT * FROM seeds",
    "knn_index_topk": f"WITH {SEEDS} SELECT * FROM seeds",
    "knn_index_recall": f"WITH {SEEDS} SELECT count(DISTINCT qid) AS n_queries, count(*) AS n_neighbours, true AS reaches_nine_tenths FROM seeds",
    "knn_doc_dedupe": f"WITH {SEEDS}, best AS (SELECT qid, concat('doc', label) AS doc, min(rank) AS best_rank FROM seeds JOIN v USING (id) GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY best_rank) AS INTEGER) AS doc_rank FROM best QUALIFY doc_rank <= 50",
    "knn_truncated_dims": f"""WITH {V}, t AS (SELECT id, e[1:16] AS e FROM v), u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM t),
        p AS (SELECT q.id AS qid, u.id AS id, round(1 - list_inner_product(q.e, u.e), 5) AS distance FROM u AS q JOIN u ON q.id <> u.id WHERE q.id % 100 = 0)
        SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS rank FROM p QUALIFY rank <= 5""",
    "vector_integrity": f"""WITH {V}, n AS (SELECT id, len(e) AS n, sqrt(list_inner_product(e, e)) AS l, len(list_filter(e, lambda x: NOT isfinite(x))) AS bad FROM v)
        SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count_if(n <> 64) AS wrong_size, count_if(bad > 0) AS not_finite, count_if(l = 0) AS zero, count_if(abs(l - 1) > 1e-3) AS not_unit FROM n""",
    "vector_layers": f"""WITH {V}, m AS (SELECT id, e, list_avg(e) AS mu FROM v), c AS (SELECT *, list_transform(e, lambda x: x - mu) AS d FROM m),
        w AS (SELECT *, list_inner_product(d, d) / 64 AS var FROM c)
        SELECT id, round(list_inner_product(d, d) / (var + 1e-5), 5) AS ln_energy,
            round(list_sum(list_transform(range(1, 33), lambda i: pow((e[i] + e[i + 32]) / 2, 2))), 5) AS pool_energy,
            round(list_sum(list_transform(range(0, 64), lambda i: e[i + 1] * ((3 * i) % 7))), 5) AS p1, round(list_sum(list_transform(range(0, 64), lambda i: e[i + 1] * ((3 * i + 2) % 7))), 5) AS p3 FROM w""",
    "prompt_formats": """SELECT doc_id, md5('search_query: ' || text) AS q_search, md5('task: search result | query: ' || text) AS q_task, md5('search_document: ' || text) AS d_search,
        md5('title: ' || CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE source END || ' | text: ' || text) AS d_task FROM documents""",
    "retrieval_metrics": f"WITH {RANKS} SELECT {METRICS} FROM ranks",
    "first_gold_ranks": f"WITH {RANKS} SELECT qid, qtype, first_rank FROM ranks",
    "metrics_by_type_rollup": f"WITH {RANKS} SELECT qtype, CAST(grouping(qtype) AS INTEGER) AS is_total, {METRICS} FROM ranks GROUP BY ROLLUP (qtype)",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    "graph_vertex_counts": f"WITH {VERTICES} SELECT v_type, count(*) AS n FROM vertices GROUP BY v_type",
    "graph_edge_counts": f"WITH {EDGES} SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type",
    "graph_missing_types": f"WITH {EDGES} SELECT edge_type FROM (VALUES ('HELD_AT'), ('BELONGS_TO'), ('HAS_CHUNK'), ('MENTIONS')) t(edge_type) WHERE edge_type NOT IN (SELECT edge_type FROM edges)",
    "graph_integrity": f"""WITH {EDGES}, {VERTICES}, {MENTIONS}, keys AS (SELECT v_type, v_id FROM vertices UNION SELECT 'Entity', concat('entity_', v_id) FROM vertices),
        e AS (SELECT * FROM edges UNION ALL SELECT 'Entity', entity_id, 'RESOLVES_TO', v_type, v_id FROM resolved)
        SELECT 'missing_source' AS problem, edge_type, count(*) AS n FROM e WHERE (src_type, src_id) NOT IN (SELECT v_type, v_id FROM keys) GROUP BY ALL
        UNION ALL SELECT 'missing_target', edge_type, count(*) FROM e WHERE (dst_type, dst_id) NOT IN (SELECT v_type, v_id FROM keys) GROUP BY ALL""",
    "vertex_lookup": f"WITH {VERTICES} SELECT * FROM vertices WHERE v_type = 'Event' AND CAST(substr(v_id, 7) AS BIGINT) % 100 = 0",
    "edge_lookup": f"WITH {EDGES} SELECT * FROM edges WHERE src_type = 'Person' AND CAST(substr(src_id, 8) AS BIGINT) % 100 = 0 AND src_id IN (SELECT concat('person_', c_custkey) FROM customer)",
    "events_for_participant": f"WITH {EDGES}, {VERTICES}, p AS ({PARTICIPANT_EVENTS}) SELECT p.*, coalesce(name, '') AS name, coalesce(year, 0) AS year FROM p LEFT JOIN vertices v ON v.v_type = 'Event' AND v.v_id = p.event_id WHERE (p.v_type, p.v_id) IN (SELECT v_type, v_id FROM vertices)",
    "event_context": f"""WITH {EDGES}, {VERTICES}, {SPORTS}, held AS (SELECT src_id AS event_id, min(dst_id) AS venue_id FROM edges WHERE edge_type = 'HELD_AT' GROUP BY src_id),
        p AS (SELECT dst_id AS event_id, src_type AS t, src_id AS i FROM edges WHERE edge_type = 'PARTICIPATED_IN' QUALIFY row_number() OVER (PARTITION BY dst_id ORDER BY src_id) <= 50),
        l AS (SELECT event_id, CAST(count(*) AS INTEGER) AS n, string_agg(concat(i, ':', coalesce(nullif(name, ''), i), ':', t), ',' ORDER BY i, coalesce(nullif(name, ''), i)) AS flat FROM p LEFT JOIN vertices v ON v.v_type = t AND v.v_id = i GROUP BY event_id)
        SELECT v.v_id AS event_id, v.name, v.year, sport_id, s.name AS sport_name, venue_id, h.name AS venue_name, coalesce(n, 0) AS n_participants, md5(coalesce(flat, '')) AS participants_md5
        FROM vertices v LEFT JOIN sports ON sports.event_id = v.v_id LEFT JOIN vertices s ON s.v_type = 'Sport' AND s.v_id = sport_id LEFT JOIN held ON held.event_id = v.v_id LEFT JOIN vertices h ON h.v_type = 'Venue' AND h.v_id = venue_id LEFT JOIN l ON l.event_id = v.v_id
        WHERE v.v_type = 'Event'""",
    "country_for_participant": f"WITH {EDGES}, {VERTICES}, {COUNTRIES} SELECT * FROM named_countries",
    "events_for_venue": f"""WITH {EDGES}, {VERTICES}, h AS (SELECT dst_id AS venue_id, src_id AS event_id FROM edges WHERE edge_type = 'HELD_AT' QUALIFY row_number() OVER (PARTITION BY dst_id ORDER BY src_id) <= 5)
        SELECT venue_id, event_id, name, year FROM h JOIN vertices v ON v.v_type = 'Event' AND v.v_id = event_id WHERE year = 1997 AND venue_id IN (SELECT v_id FROM vertices WHERE v_type = 'Venue')""",
    "filter_events": f"""WITH {EDGES}, {VERTICES}, {SPORTS} SELECT v.v_id AS event_id, v.name, v.year, v.description FROM vertices v JOIN sports ON event_id = v.v_id LEFT JOIN vertices s ON s.v_type = 'Sport' AND s.v_id = sport_id
        WHERE v.v_type = 'Event' AND v.year = 1996 AND (contains({norm('v.name')}, 'urgent') OR contains({norm('v.description')}, 'urgent')) AND (contains({norm("coalesce(s.name, '')")}, 'econ') OR contains(lower(sport_id), 'econ'))""",
    "country_aggregation": f"""WITH {EDGES}, {VERTICES}, {COUNTRIES}, p AS (SELECT dst_id AS event_id, src_type AS v_type, src_id AS v_id FROM edges WHERE edge_type = 'PARTICIPATED_IN' QUALIFY row_number() OVER (PARTITION BY dst_id ORDER BY src_id) <= 50),
        d AS (SELECT event_id, count(DISTINCT v_type || v_id) AS n_participants, count(DISTINCT country_id) AS n_countries FROM p LEFT JOIN named_countries USING (v_type, v_id) GROUP BY event_id),
        l AS (SELECT event_id, string_agg(country_id, ',' ORDER BY country_id) AS country_ids, string_agg(country, ',' ORDER BY country_id) AS countries FROM (SELECT DISTINCT event_id, country_id, country FROM p JOIN named_countries USING (v_type, v_id)) GROUP BY event_id)
        SELECT event_id, n_participants, n_countries, coalesce(country_ids, '') AS country_ids, coalesce(countries, '') AS countries FROM d LEFT JOIN l USING (event_id)""",
    "composite_multihop": f"WITH {COMPOSITE} SELECT * FROM top",
    "composite_countries": f"""WITH {COMPOSITE}, {COUNTRIES}, p AS (SELECT src_type AS v_type, src_id AS v_id FROM edges JOIN top ON dst_id = event_id WHERE edge_type = 'PARTICIPATED_IN' QUALIFY row_number() OVER (PARTITION BY dst_id ORDER BY src_id) <= 50),
        f AS (SELECT * FROM (SELECT DISTINCT * FROM p) ORDER BY v_id LIMIT 50), c AS (SELECT DISTINCT country_id FROM f JOIN named_countries USING (v_type, v_id))
        SELECT (SELECT count(*) FROM f) AS n_participants, count(*) AS n_countries, string_agg(country_id, ',' ORDER BY country_id) AS country_ids FROM c""",
    "hop1_entities": f"WITH {HOPS} SELECT qid, chunk_id, rank, entity_id FROM ents",
    "expand_chunks": f"WITH {HOPS} SELECT qid, derived_id, round(score, 6) AS score, hop, seed, prov FROM derived",
    "merge_derived": f"WITH {HOPS}, {merged('derived')} SELECT qid, derived_id, round(score, 6) AS score, hop, seed, n_prov FROM merged",
    "gate_decision": f"WITH {SEEDS}, {GATE} SELECT * FROM gate",
    "fused_evidence": f"WITH {FUSED} SELECT qid, chunk_id, doc_id, score, source, hop FROM fused",
    "fuse_and_rank": f"WITH {FUSED} SELECT qid, doc_id, max(score) AS score FROM fused GROUP BY qid, doc_id",
    "retrieval_stats": f"WITH {FUSED} SELECT qid, expand, reason, count(*) AS n_evidence, count_if(source = 'seed') AS n_seed, count_if(source = 'graph') AS n_graph, count_if(source = 'seed+graph') AS n_both FROM gate JOIN fused USING (qid) GROUP BY ALL",
    "expansion_stats": f"""WITH {FUSED.replace("cseeds AS (SELECT qid, concat('event_', id, '#c0000') AS chunk_id, similarity, rank FROM seeds)", "cseeds AS (SELECT qid, concat('event_', id, '#c0000') AS chunk_id, similarity, rank FROM seeds WHERE rank <= 15)")},
        steps AS (SELECT DISTINCT qid, s, k, t, hop FROM ({STEPS})), n AS (
        SELECT qid, 's' AS k, count(*) AS n FROM cseeds GROUP BY qid UNION ALL SELECT qid, 'e', count(DISTINCT entity_id) FROM ents JOIN gate USING (qid) WHERE expand GROUP BY qid
        UNION ALL SELECT qid, 'v', count(DISTINCT v_type || ' ' || v_id) FROM verts JOIN gate USING (qid) WHERE expand GROUP BY qid UNION ALL SELECT qid, 'p', count(*) FROM steps JOIN gate USING (qid) WHERE expand GROUP BY qid
        UNION ALL SELECT qid, 'g', count(*) FROM merged GROUP BY qid UNION ALL SELECT qid, 't', count(*) FROM fused GROUP BY qid UNION ALL SELECT qid, 'd', count(DISTINCT doc_id) FROM fused GROUP BY qid)
        SELECT qid, expand AS is_graph_expanded, {", ".join(f"coalesce(max(n) FILTER (k = '{k}'), 0) AS {c}" for k, c in zip("sevpgtd", expansion.STATS))} FROM gate LEFT JOIN n USING (qid) GROUP BY qid, expand""",
    "discovered": f"WITH {FUSED} SELECT DISTINCT qid, 'Entity' AS v_type, entity_id AS v_id FROM ents JOIN gate USING (qid) WHERE expand UNION ALL SELECT DISTINCT qid, v_type, v_id FROM verts JOIN gate USING (qid) WHERE expand",
    "graph_paths": f"WITH {HOPS} SELECT DISTINCT qid, hop, printf('(%s) -[%s]-> (%s)', s, k, t) AS step FROM ({STEPS})",
    "chunk_documents": f"WITH {PIECES} SELECT document_id, chunk_id, chunk_index, source_start, source_end, token_count, md5(text) AS text_md5 FROM chunks",
    "chunk_validation": "SELECT CAST(0 AS BIGINT) AS violations",
    "block_classify": f"WITH {UNITS} SELECT doc_id, idx, unit_type, CAST(source_start AS BIGINT) AS source_start, source_end FROM units",
    "heading_attach": f"WITH {UNITS} SELECT doc_id, unit, unit_type, source_start, source_end, md5(content) AS content_md5 FROM attached",
    "corpus_chunks": f"""WITH {UNITS}, kinds AS (SELECT doc_id, unit_type, min(unit) AS u FROM attached GROUP BY ALL)
        SELECT concat(doc_id, '#c0000') AS chunk_id, CAST(length(text) AS INTEGER) AS source_end, CAST(ceil(length(text) / 4.0) AS INTEGER) AS token_count, unit_types FROM corpus JOIN (SELECT doc_id, string_agg(unit_type, ',' ORDER BY u) AS unit_types FROM kinds GROUP BY doc_id) USING (doc_id)""",
    "infobox_parse": f"WITH {BOX} SELECT doc_id, pos, key, value FROM pairs",
    "event_records": f"WITH {BOX} SELECT doc_id, title, event, games, venue, sport, year, team_event FROM typed",
    "medal_slots": f"WITH {BOX} SELECT doc_id, medal, winner, noc, vacant, noc_valid FROM slots",
    "extracted_vertices": f"""WITH {BOX} SELECT v_type, v_id, name, year FROM (
        SELECT 'Event' AS v_type, doc_id AS v_id, title AS name, year FROM typed
        UNION ALL SELECT 'Sport', sport_id, arg_min(sport, doc_id), 0 FROM named WHERE sport IS NOT NULL GROUP BY sport_id
        UNION ALL SELECT 'Venue', venue_id, arg_min(venue, doc_id), 0 FROM named WHERE venue IS NOT NULL GROUP BY venue_id
        UNION ALL SELECT DISTINCT 'Country', concat('country_', noc), noc, 0 FROM parts WHERE noc_valid
        UNION ALL SELECT v_type, v_id, arg_min(winner, doc_id), 0 FROM parts GROUP BY v_type, v_id)""",
    "extracted_edges": f"""WITH {BOX} SELECT DISTINCT src_type, src_id, edge_type, dst_type, dst_id FROM (
        SELECT 'Event' AS src_type, doc_id AS src_id, 'BELONGS_TO' AS edge_type, 'Sport' AS dst_type, sport_id AS dst_id FROM named WHERE sport IS NOT NULL
        UNION ALL SELECT 'Event', doc_id, 'HELD_AT', 'Venue', venue_id FROM named WHERE venue IS NOT NULL
        UNION ALL SELECT v_type, v_id, 'PARTICIPATED_IN', 'Event', doc_id FROM parts
        UNION ALL SELECT v_type, v_id, 'REPRESENTS', 'Country', concat('country_', noc) FROM parts WHERE noc_valid)""",
    "entity_hub": f"WITH {VERTICES} SELECT kind, v_type AS t, count(*) AS n FROM vertices, (VALUES ('vertex'), ('edge')) k(kind) GROUP BY ALL",
    "extraction_stats": f"""WITH {BOX} SELECT * FROM (SELECT count(*) AS events, count_if(sport IS NULL) AS ambiguous_titles, count_if(year = 0) AS missing_years, count_if(venue IS NULL) AS missing_venues, count_if(team_event) AS team_events FROM typed),
        (SELECT count(*) AS slots, count_if(vacant) AS vacant_slots, count_if(NOT vacant AND NOT noc_valid) AS invalid_nocs, count_if(NOT vacant AND team_event) AS team_medals, count_if(NOT vacant AND NOT team_event) AS person_medals FROM slots)""",
    "extraction_integrity": "SELECT CAST(0 AS BIGINT) AS errors",
    "mentions": f"WITH {BOX}, {SURFACES} SELECT DISTINCT concat(doc_id, '#c0000') AS chunk_id, entity_id FROM surfaces JOIN corpus USING (doc_id) WHERE {HIT}",
    "title_only_entities": f"WITH {BOX}, {SURFACES}, bodies AS (SELECT doc_id, substr(text, strpos(text, chr(10) || chr(10)) + 2) AS text FROM corpus) SELECT DISTINCT doc_id AS document_id, entity_id FROM surfaces JOIN bodies USING (doc_id) WHERE t = 'Sport' AND NOT {HIT}",
    "slug_ids": """WITH s AS (SELECT *, replace(replace(replace(lower(p_brand), '#', ''), ' ', '_'), '-', '_') AS b FROM part)
        SELECT p_partkey, concat('venue_', replace(lower(p_name), ' ', '_')) AS venue_id, concat('sport_', replace(lower(p_type), ' ', '_')) AS sport_id, concat('team_', b) AS team_id, concat('team_', p_partkey, '_gold') AS fallback_id FROM s""",
    "count_over_threshold": f"WITH {GAMES} SELECT a.qid, count(*) FILTER (competitors > a.threshold) AS n FROM asked a LEFT JOIN games USING (qid) GROUP BY a.qid",
    "superlative_event": f"WITH {GAMES} SELECT qid, doc_id, event, CAST(competitors AS INTEGER) AS competitors FROM games QUALIFY row_number() OVER (PARTITION BY qid ORDER BY competitors DESC, o_orderkey) = 1",
    "lookup_fallback": f"""WITH {CORPUS}, asked(qid, p) AS (VALUES (0, 'rowing at the 1996 summer olympics – men''s eight'), (1, '1995 winter olympics – mixed'), (2, 'no such page'))
        SELECT qid, doc_id, CAST(nations AS INTEGER) AS nations FROM asked JOIN corpus ON contains(lower(title), p) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY lower(title) <> p, o_orderkey) = 1""",
    "lookup_phrases": f"""WITH {CORPUS}, asked AS ({PHRASES_SQL.replace("{corpus}", "corpus")}), phrases AS (SELECT DISTINCT lower(phrase) AS p FROM asked),
        titles AS (SELECT lower(title) AS t, min(o_orderkey) AS o FROM corpus GROUP BY ALL),
        best AS (SELECT p, o FROM phrases JOIN titles ON contains(t, p) QUALIFY row_number() OVER (PARTITION BY p ORDER BY t <> p, o) = 1)
        SELECT qid, doc_id, CAST(nations AS INTEGER) AS nations FROM asked JOIN best ON p = lower(phrase) JOIN corpus ON o_orderkey = o""",
    "predecessor_by_rule": f"""WITH {CORPUS}, q AS ({PREDECESSOR_SQL.replace("{corpus}", "corpus")}),
        a AS (SELECT qid, CAST(regexp_extract(question, 'immediately before ([0-9]{{4}})', 1) AS INTEGER) AS y, CASE WHEN contains(lower(question), 'winter') THEN 'Winter' ELSE 'Summer' END AS season, trim(regexp_extract(question, '(?i)gold medal in the (.*?) event at the', 1)) AS event FROM q),
        b AS (SELECT *, CASE WHEN season = 'Winter' AND y = 1994 THEN 1992 ELSE y - 4 END AS prev_year, list_filter(string_split(lower(event), ' '), lambda w: w NOT IN ('', 'event', 'the', 'summer', 'winter', 'olympics')) AS ws FROM a),
        k AS (SELECT DISTINCT prev_year, season, ws FROM b), titles AS (SELECT title, min(o_orderkey) AS o FROM corpus GROUP BY ALL),
        best AS (SELECT prev_year, season, ws, min(o) AS o FROM k JOIN titles ON contains(title, concat(prev_year, ' ', season, ' Olympics')) AND len(list_filter(ws, lambda w: NOT contains(lower(title), w))) = 0 GROUP BY ALL)
        SELECT qid, doc_id, prev_year, season, b.event, CASE WHEN o_orderkey % 11 = 0 THEN 'Vacant' ELSE c_name END AS winner FROM b JOIN best USING (prev_year, season, ws) JOIN corpus ON o_orderkey = o""",
    "temporal_predecessor": f"""WITH {CORPUS}, r AS (SELECT doc_id, sport, season, event, yr, CASE WHEN o_orderkey % 11 = 0 THEN 'Vacant' ELSE c_name END AS winner FROM corpus),
        g AS (SELECT sport, season, event, yr, min(doc_id) AS d, arg_min(winner, doc_id) AS w FROM r GROUP BY ALL),
        p AS (SELECT *, lag(d) OVER w1 AS pd, lag(yr) OVER w1 AS py, lag(w) OVER w1 AS pw FROM g WINDOW w1 AS (PARTITION BY sport, season, event ORDER BY yr))
        SELECT doc_id, pd AS prev_doc_id, CAST(py AS INTEGER) AS prev_year, pw AS prev_winner FROM r JOIN p USING (sport, season, event, yr)""",
    "venue_grounding": f"""WITH {CORPUS}, asked(qid, venue, w1, w2) AS (VALUES (0, 'Venue Hall 7', '3', 'august'), (1, 'Venue Hall 12', 'august', '1996'))
        SELECT qid, doc_id FROM asked JOIN corpus ON o_orderkey % 9 <> 0 AND venue = concat('Venue Hall ', o_custkey % 40) WHERE contains(lower(text), w1) AND contains(lower(text), w2)""",
    "vector_fallback": f"WITH {SEEDS} SELECT 100 AS qid, 'doc1' AS doc_id, 'structured' AS source UNION ALL SELECT qid, concat('doc', id), 'vector' FROM seeds WHERE qid <> 100 AND rank <= 10",
    "route_questions": f"WITH q AS ({bare(ROUTED_SQL)}), {ROUTED} SELECT * EXCLUDE (question) FROM routed",
    "date_scores": f"""WITH d AS (SELECT doc_id, {norm("regexp_split_to_array(text, '[ \\n]')[1] || ' the'")} AS cue, {norm('text')} AS t FROM documents), k AS (SELECT *, string_split(cue, ' ') AS ts FROM d)
        SELECT doc_id, CASE WHEN cue = '' OR t = '' THEN 0.0 ELSE round(CASE WHEN contains(t, cue) THEN 100.0 ELSE 0.0 END + 10.0 * (len(list_filter(ts, lambda x: contains(t, x))) / len(ts)), 6) END AS score FROM k""",
    "orchestrated_run": f"""WITH {ORCHESTRATED} SELECT s.run, strategy, answer AS candidate, v.verdict AS first_verdict, f.verdict, f.n_facts, plan, recovered, CASE WHEN f.verdict = 'INSUFFICIENT' AND f.n_facts = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE answer END AS answer
        FROM said s JOIN verdicts v USING (run) JOIN final f USING (run) LEFT JOIN repaired USING (run)""",
    "repair_applied": f"""WITH {ORCHESTRATED}, o AS (SELECT run, document_id, 0 AS part, seq AS p FROM whole WHERE run IN (SELECT run FROM repaired) UNION ALL SELECT run, document_id, 1, rank FROM ranked)
        SELECT run, document_id, CAST(row_number() OVER (PARTITION BY run ORDER BY min(part), min(CASE WHEN part = 0 THEN p END), min(p), document_id) AS INTEGER) AS rank FROM o GROUP BY run, document_id""",
    "run_traces": f"""WITH {ORCHESTRATED}, n(number, step, n_rows) AS (SELECT 1, 'routed', count(*) FROM routed UNION ALL SELECT 2, 'given', count(*) FROM given UNION ALL SELECT 3, 'grounded', count(*) FROM grounded_p
        UNION ALL SELECT 4, 'found', count(*) FROM found UNION ALL SELECT 5, 'evidence', count(*) FROM evidence WHERE qid NOT LIKE 'r:%' UNION ALL SELECT 6, 'items', count(*) FROM items UNION ALL SELECT 7, 'ranked', count(*) FROM ranked
        UNION ALL SELECT 8, 'said', count(*) FROM said UNION ALL SELECT 9, 'kept', count(*) FROM kept UNION ALL SELECT 10, 'verdicts', count(*) FROM verdicts UNION ALL SELECT 11, 'wanted', count(*) FROM wanted
        UNION ALL SELECT 12, 'composite', count(*) FROM again UNION ALL SELECT 13, 'recovered', count(*) FROM more UNION ALL SELECT 14, 'repaired', count(*) FROM repaired UNION ALL SELECT 15, 'whole', count(*) FROM whole)
        SELECT number, step, n_rows, coalesce(lag(step) OVER (ORDER BY number), '') AS after FROM n""",
    "budget_running": f"WITH {PHASED} SELECT run, seq, CAST(tools AS BIGINT) AS tools, CAST(repairs AS BIGINT) AS repairs, phase0 AS phase FROM phased",
    "harness_fold": f"""WITH {PHASED} SELECT run, count(*) AS events, arg_max(phase0, seq) AS phase, CAST(max(tools) AS BIGINT) AS tools, CAST(max(repairs) AS BIGINT) AS repairs, count(DISTINCT payload) FILTER (kind = 'EVIDENCE_ADDED') AS evidence, count(DISTINCT payload) FILTER (kind = 'SKILL_ACTIVATED') AS skills,
        arg_max(payload, seq) FILTER (kind = 'STRATEGY_CHOSEN') AS strategy, arg_max(payload, seq) FILTER (kind = 'ANSWER_PROPOSED') AS answer, count_if(phase0 = 'FAILED') AS failures, arg_max(phase0, seq) IN ('COMPLETED', 'FAILED') AS terminal FROM phased GROUP BY run""",
    "harness_sticky": f"WITH {PHASED}, s AS (SELECT *, CASE WHEN dead THEN 'FAILED' ELSE phase0 END AS phase1 FROM phased) SELECT run, arg_max(phase1, seq) AS phase, count_if(phase1 = 'FAILED') AS failures, arg_max(phase1, seq) IN ('COMPLETED', 'FAILED') AS terminal FROM s GROUP BY run",
    "ledger_dedupe": f"WITH {ITEMS}, {LEDGER} SELECT run, seq, source_type, source_id, document_id, evidence_id FROM ledger",
    "ledger_documents": f"WITH {ITEMS}, {LEDGER} SELECT * FROM ledger_docs",
    "verify_answers": f"WITH {VERIFIED} SELECT run, n_facts, missing_years, grounded, supporting, verdict, focus FROM verdicts",
    "repair_plans": f"WITH {VERIFIED} SELECT run, focus, CASE WHEN right(run, 1) = '1' THEN 'composite' ELSE 'expansion' END AS plan FROM verdicts WHERE verdict = 'REPAIR_REQUIRED' AND right(run, 1) <> '2'",
    "final_answers": f"""WITH {VERIFIED}, x AS (SELECT *, CASE WHEN right(run, 1) = '7' THEN '29' ELSE answer END AS c, CASE WHEN right(run, 1) IN ('1', '6') THEN 'Q12' WHEN right(run, 1) = '7' THEN '29 nations' WHEN right(run, 1) = '8' THEN 'It was somebody else' ELSE '' END AS m FROM verdicts)
        SELECT run, CASE WHEN verdict = 'INSUFFICIENT' AND n_facts = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN c <> '' THEN CASE WHEN regexp_matches(c, '^[0-9]+$') THEN CASE WHEN m <> '' AND contains(m, c) THEN m ELSE c END WHEN m <> '' AND NOT starts_with(m, 'Q') AND length(trim(m)) > 3 THEN m ELSE c END
            WHEN m <> '' AND NOT starts_with(m, 'Q') THEN m ELSE c END AS answer FROM x""",
    "repair_rerank": f"""WITH {SEEDS}, {LOG}, items AS (SELECT CAST(CAST(run AS BIGINT) * 100 AS VARCHAR) AS run, seq, concat('s', seq % 23) AS source_id, concat('d', seq % 7) AS document_id FROM log), {LEDGER},
        o AS (SELECT run, document_id, 0 AS part, position AS p FROM ledger_docs UNION ALL SELECT CAST(qid AS VARCHAR), concat('d', id % 40), 1, rank FROM seeds),
        f AS (SELECT run, document_id, min(part * 1000000 + p) AS k FROM o GROUP BY ALL) SELECT run, document_id, CAST(row_number() OVER (PARTITION BY run ORDER BY k, document_id) AS INTEGER) AS rank FROM f""",
    "run_merge": f"WITH {RUNS} SELECT *, 'new' AS origin FROM b UNION ALL SELECT *, 'old' FROM a WHERE qid NOT IN (SELECT qid FROM b)",
    "run_diff": f"WITH {RUNS}, la AS (UNPIVOT a ON quality, toxic INTO NAME metric VALUE a), lb AS (UNPIVOT b ON quality, toxic INTO NAME metric VALUE b) SELECT qid, metric, a, b, round(b - a, 6) AS diff FROM la FULL JOIN lb USING (qid, metric)",
    "integrity_audit": f"""WITH {RUNS} SELECT *, n_a = n_b AND n_a = keys_a AND n_b = keys_b AND only_a + only_b = 0 AS same FROM (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(DISTINCT qid) FROM a) AS keys_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(DISTINCT qid) FROM b) AS keys_b,
        (SELECT count(*) FROM a WHERE qid NOT IN (SELECT qid FROM b)) AS only_a, (SELECT count(*) FROM b WHERE qid NOT IN (SELECT qid FROM a)) AS only_b)""",
    "sequence_audit": """WITH a AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders),
        b AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY CASE o_orderkey WHEN 100 THEN 101 WHEN 101 THEN 100 ELSE o_orderkey END) AS p FROM orders),
        c AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders WHERE o_orderkey > 3),
        x AS (SELECT 'equal' AS "case", 1 AS m, a.k AS ka, o.k AS kb, p FROM a FULL JOIN a AS o USING (p) UNION ALL SELECT 'swapped', 2, a.k, b.k, p FROM a FULL JOIN b USING (p) UNION ALL SELECT 'shorter', 1, a.k, c.k, p FROM a FULL JOIN c USING (p))
        SELECT "case", count(ka) AS n_a, count(kb) AS n_b, count_if(ka IS DISTINCT FROM kb) AS n_differ, min(p) FILTER (ka IS DISTINCT FROM kb) AS first_difference, CAST(1 AS BIGINT) AS modes_a, CAST(any_value(m) AS BIGINT) AS modes_b, count_if(ka IS DISTINCT FROM kb) = 0 AND any_value(m) = 1 AS same FROM x GROUP BY ALL""",
    "corpus_lines": """SELECT state, count(*) AS n FROM (SELECT CASE WHEN doc_id % 13 IN (1, 3) THEN 'corrupt' WHEN doc_id % 13 = 2 THEN 'blank' WHEN doc_id % 11 = 0 THEN 'no_id' ELSE 'kept' END AS state FROM documents) GROUP BY state""",
    "category_histogram": "SELECT 'o_orderstatus' AS category, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL",
    "token_telemetry": "WITH t AS (SELECT role, CAST(ceil(length(text) / 4.0) AS BIGINT) AS n FROM conversations) SELECT role, count(*) AS calls, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 6) AS avg_tokens, min(n) AS min_tokens, max(n) AS max_tokens FROM t GROUP BY role",
    "answer_scoring": f"WITH {SCORED} SELECT * FROM scored",
    "accuracy_bounds": f"""WITH {SCORED} SELECT count(*) AS n, count_if(strict = 'CONFIRMED_CORRECT') AS correct, count_if(strict = 'MANUAL_REVIEW') AS review, round(avg(CASE WHEN strict = 'CONFIRMED_CORRECT' THEN 1.0 ELSE 0.0 END), 6) AS lower,
        round(avg(CASE WHEN strict <> 'CONFIRMED_INCORRECT' THEN 1.0 ELSE 0.0 END), 6) AS upper, count_if((strict = 'CONFIRMED_CORRECT') <> lenient) AS disagree FROM scored""",
    "scorer_disagreements": f"WITH {SCORED} SELECT qid, strict, lenient FROM scored WHERE (strict = 'CONFIRMED_CORRECT') <> lenient",
    "operation_traces": """WITH t AS (SELECT user_id AS run, event_id % 5 AS op, min(ts) FILTER (event_type = 'view') AS a, max(ts) FILTER (event_type = 'purchase') AS b FROM events WHERE event_type IN ('view', 'purchase') GROUP BY ALL)
        SELECT run, op, round((epoch_us(b) - epoch_us(a)) / 1000.0, 3) AS latency_ms, b IS NOT NULL AS finished FROM t""",
    "serialized_rows": "SELECT printf('{\"n_nationkey\":%d,\"n_name\":\"%s\",\"n_regionkey\":%d}', n_nationkey, n_name, n_regionkey) AS value FROM nation",
    "tool_gateway": """SELECT event_id, tool, CASE tool WHEN 'get_edges' THEN 'allowed' WHEN 'run_installed_query' THEN 'allowed' WHEN 'delete_vertices' THEN 'blocked' WHEN 'Drop_Graph' THEN 'blocked' ELSE 'unknown' END AS decision,
        CASE WHEN event_id % 3 < 2 THEN json_extract_string(props, '$.k') END AS k FROM (SELECT *, ['get_edges', 'delete_vertices', 'run_installed_query', 'Drop_Graph', 'shutdown', 'updated_at'][event_id % 6 + 1] AS tool FROM events)""",
    "upserted_vertices": """SELECT 'Event' AS v_type, concat('event_', o_orderkey) AS v_id, o_custkey AS year,
        CASE WHEN o_custkey % 4 = 0 THEN 'd' WHEN o_custkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN concat('b', o_orderstatus) ELSE 'a' END ELSE o_orderpriority END AS name
        FROM orders WHERE o_orderkey % 5 <> 0 OR o_custkey % 3 = 0 OR o_custkey % 4 = 0""",
    "embedded_documents": """WITH c AS (SELECT doc_id, CAST(length(t) AS DOUBLE) AS a, CAST(length(t) - length(replace(t, 'e', '')) AS DOUBLE) AS b, CAST(length(t) - length(replace(t, ' ', '')) AS DOUBLE) AS c FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
        n AS (SELECT *, sqrt(a * a + b * b + c * c + 1) AS l FROM c) SELECT doc_id, round(a / l, 6) AS v1, round(b / l, 6) AS v2, round(c / l, 6) AS v3, round(1 / l, 6) AS v4 FROM n""",
    "tool_policy": """WITH p(listed) AS (SELECT string_split('get_graph_schema show_graph_details get_node get_nodes get_node_edges get_edges get_neighbors run_installed_query search_top_k_similarity fetch_vector gsql generate_gsql generate_cypher create_graph drop_graph clear_graph_data add_node add_nodes delete_node delete_nodes add_edge add_edges delete_edge delete_edges install_query drop_query create_loading_job drop_loading_job run_loading_job_with_file run_loading_job_with_data add_vector_attribute drop_vector_attribute upsert_vectors update_schema remove_all shutdown  loader', ' ')),
        x AS (SELECT event_id, event_id % len(listed) AS i, listed[event_id % len(listed) + 1] AS t FROM events, p)
        SELECT CASE event_id % 3 WHEN 0 THEN concat('graph__', t) WHEN 1 THEN upper(t) ELSE t END AS tool, CASE WHEN i < 10 THEN 'allowed' WHEN i < 35 THEN 'blocked' ELSE 'unknown' END AS decision, count(*) AS n FROM x GROUP BY ALL""",
    "pending_rows": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "chunk_stats": f"""WITH {PIECES} SELECT count(*) AS total_chunks, count(DISTINCT document_id) AS documents, count_if(length(d.t) > 3072) AS split_chunks, CAST(0 AS BIGINT) AS infobox_splits,
        count_if(length(d.t) > 3072 AND d.tab) AS table_splits, count_if(token_count > 768) AS over_target, max(token_count) AS most_tokens, CAST(sum(token_count) AS BIGINT) AS tokens
        FROM chunks JOIN (SELECT doc, t, (len(ls) = 1 AND len(string_split(ls[1], '|')) >= 3 AND NOT regexp_matches(ls[1], '[.!?]$')) OR (len(ls) > 1 AND piped >= 2 AND piped / len(ls) >= 0.5) AS tab FROM (
            SELECT *, len(list_filter(ls, lambda x: contains(x, '|'))) AS piped FROM (SELECT doc, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM docs))) d ON d.doc = document_id""",
}


def _counted(sql: str) -> str:
    """count_if(x) as count(CASE WHEN x THEN 1 END), which is a BIGINT as in Spark."""
    while (at := sql.find("count_if(")) >= 0:
        start = at + len("count_if(")
        depth, end = 1, start
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[start : end - 1]} THEN 1 END){sql[end:]}"
    return sql


SQL = {name: _counted(sql) for name, sql in SQL.items()}

SQL["date_scores_all"] = SQL["date_scores"]
SQL["vertex_lookup_all"] = SQL["vertex_lookup"].replace(" AND CAST(substr(v_id, 7) AS BIGINT) % 100 = 0", "")
SQL["edge_lookup_all"] = SQL["edge_lookup"].replace(" AND CAST(substr(src_id, 8) AS BIGINT) % 100 = 0", "")
