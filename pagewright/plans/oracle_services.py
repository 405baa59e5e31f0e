"""SQL (DuckDB's dialect) of the named queries about reading, chunks, players, voices, geometry and the
detectors: sequential services as recursive queries, the rest as windows and joins."""

from __future__ import annotations

from ..constants import BULLETS, CAPTION, ENTRY_SIGNALS, FRONT_MATTER, LIST_PREFIX, SENTENCE_END, WS
from ..operators.state import TRANSITIONS
from ..operators.voices import CAPABILITIES, ERRORS, NOVELTY
from .oracles import APPLIED, BOXES, CHUNKS, GEOMETRY, LINES, OCR, QUEUE, REGIONS, _normal, _NUMBER, fnv, form, has, heading, lit, score, signature, spoken, sub, trim, trim_end, words_of

_AUTHORS = (
    rf"\([{WS}]*(e\.g\.,?[{WS}]*|see[{WS}]+|cf\.[{WS}]*)?[A-ZÀ-ÖØ-ÞĀ-Ɏ](\p{{L}}|['’-])+([{WS}]+(et[{WS}]+al\.?|and|&|,)[{WS}]*(\p{{L}}|['’.-])*)*,?[{WS}]*(19|20)[0-9]{{2}}[a-z]?"
    rf"([{WS}]*[;,][{WS}]*[^()]{{0,60}}?(19|20)[0-9]{{2}}[a-z]?)*[{WS}]*\)"
)
_SKIPPED = rf"(\[{_NUMBER}\]|\({_NUMBER}\)|[¹²³⁰⁴-⁹]+|{_AUTHORS})"
_BULLETED = rf"^[{WS}]*[{BULLETS}][{WS}]*"
_CLOSES = rf"^[{WS}.,;:!?)\]}}]"

SQL: dict[str, str] = {
    # text between what is skipped, cut at its end where white space or a mark follows the skipped
    "q_projection_full": f"""WITH {LINES}, plain AS (SELECT *, {has('text', _BULLETED)} AS bullet, {sub('text', _BULLETED, '')} AS t FROM lines),
gone AS (SELECT *, len(regexp_extract_all(t, {lit(_SKIPPED)})) AS n, string_split_regex(t, {lit(_SKIPPED)}) AS kept FROM plain)
SELECT document_id, line_no, array_to_string(list_transform(kept, lambda x, i: CASE WHEN i < len(kept) AND {has('kept[i + 1]', _CLOSES)} THEN {trim_end('x')} ELSE x END), '') AS speech_text,
CAST(n + CAST(bullet AS INTEGER) AS INTEGER) AS n_skipped, CAST(length(text) AS INTEGER) AS end_offset FROM gone""",
    "q_queue": f"""WITH {REGIONS}, {APPLIED}, said AS (SELECT document_id, id, type, reading_order, {spoken('text')} AS speech_text FROM applied WHERE included)
SELECT document_id, id || ':s0' AS id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY reading_order) - 1 AS INTEGER) AS queue_index, speech_text, type AS region_type FROM said WHERE {trim('speech_text')} <> ''""",
    "k_chunks": f"""WITH RECURSIVE {QUEUE}, q AS (SELECT document_id, text, row_number() OVER (PARTITION BY document_id ORDER BY queue_index) AS n FROM queue WHERE {trim('text')} <> ''),
cut AS (
  SELECT document_id, n, 0 AS part, '' AS said, FALSE AS inside, text AS rest, FALSE AS next_inside FROM q WHERE length(text) > 600
  UNION ALL
  SELECT document_id, n, part + 1, CASE WHEN length(rest) <= 600 THEN rest WHEN gap > 1 THEN rest[:gap - 1] ELSE rest[:600] END, next_inside,
    CASE WHEN length(rest) <= 600 THEN '' WHEN gap > 1 THEN rest[gap + 1:] ELSE rest[601:] END, length(rest) > 600 AND gap <= 1
  FROM (SELECT *, length(regexp_extract(rest[:601], '(?s)^.* ')) AS gap FROM cut WHERE rest <> '')
), parts AS (
  SELECT document_id, n, 0 AS part, text AS said, FALSE AS inside, FALSE AS alone FROM q WHERE length(text) <= 600
  UNION ALL SELECT document_id, n, part, said, inside, TRUE FROM cut WHERE part > 0 AND {trim('said')} <> ''
), lined AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n, part) AS k FROM parts),
pack AS (
  SELECT document_id, k, 0 AS chunk, length(said) AS used, alone FROM lined WHERE k = 1
  UNION ALL
  SELECT l.document_id, l.k, CASE WHEN l.alone OR p.alone OR p.used + 1 + length(l.said) > 600 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN l.alone OR p.alone OR p.used + 1 + length(l.said) > 600 THEN length(l.said) ELSE p.used + 1 + length(l.said) END, l.alone
  FROM pack p JOIN lined l ON l.document_id = p.document_id AND l.k = p.k + 1
)
SELECT document_id, CAST(chunk AS INTEGER) AS chunk_index, string_agg(said, ' ' ORDER BY k) AS text, CAST(count(*) AS INTEGER) AS n_sentences, bool_or(inside) AS continues_mid_word FROM pack JOIN lined USING (document_id, k) GROUP BY document_id, chunk""",
    "k_lru_ttl": """WITH RECURSIVE r AS (SELECT CAST(user_id AS VARCHAR) AS cache, event_id AS seq, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 AS t, 'k' || event_id % 7 AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (
  SELECT cache, seq, n, FALSE AS hit, 0 AS evicted, [{'k': key, 't': t}] AS held FROM r WHERE n = 1
  UNION ALL
  SELECT cache, seq, n, hit, greatest(len(held) - 3, 0), CASE WHEN len(held) > 3 THEN held[2:] ELSE held END FROM (
    SELECT r.cache, r.seq, r.n, coalesce(r.t - old.t <= 86400, FALSE) AS hit, list_append(list_filter(f.held, lambda x: x.k <> r.key), {'k': r.key, 't': CASE WHEN coalesce(r.t - old.t <= 86400, FALSE) THEN old.t ELSE r.t END}) AS held
    FROM (SELECT f.*, r.key AS k2, list_filter(f.held, lambda x: x.k = r.key)[1] AS old FROM f JOIN r ON r.cache = f.cache AND r.n = f.n + 1) f JOIN r ON r.cache = f.cache AND r.n = f.n + 1)
)
SELECT cache, seq, hit, CAST(evicted AS INTEGER) AS evicted, CAST(len(held) AS INTEGER) AS size FROM f""",
    "tm_sentence_at_time": f"""WITH {CHUNKS}, timed AS (SELECT document_id, page_number, total, total / 14.5::DOUBLE AS dur FROM tot), ratio AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (dur * (page_number % 4) / 4 + 0.001::DOUBLE) / dur)) AS share FROM timed)
SELECT document_id, page_number AS chunk_index, CASE WHEN total > 0 THEN coalesce(arg_min(id, queue_index) FILTER (share * total < at0 + length(text)), arg_max(id, queue_index)) END AS sentence_id FROM offs JOIN ratio USING (document_id, page_number) GROUP BY document_id, page_number, total""",
    "tm_mock_duration": f"""WITH {QUEUE}, n AS (SELECT *, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n FROM queue)
SELECT document_id, id, round(length(text) / (14.5::DOUBLE * 1.25::DOUBLE), 6) AS seconds, CAST(n AS INTEGER) AS n_words, CASE WHEN n > 0 THEN round(length(regexp_replace(text, ' +$', '')) / (14.5::DOUBLE * 1.25::DOUBLE), 6) END AS last_end FROM n""",
    "v_default_voice": f"""WITH v AS (
  SELECT user_id, event_id AS n, 'v' || event_id AS id, CASE WHEN event_id % 11 = 0 THEN 'zarvox' WHEN event_id % 5 = 0 THEN 'zoe (premium)' ELSE 'voice ' || event_id END AS name,
    ['en-gb', 'en-us', 'fr-fr', 'de-de'][1 + event_id % 4] AS tag, event_id % 9 = 0 AS standard, event_id % 2 = 0 AS local, CASE WHEN user_id % 2 = 0 THEN 'en-gb' ELSE 'fr' END AS wish FROM events
), pool AS (
  SELECT *, CASE WHEN bool_or(name NOT IN ({', '.join(map(lit, NOVELTY))})) OVER w THEN name NOT IN ({', '.join(map(lit, NOVELTY))}) ELSE TRUE END AS usable FROM v WINDOW w AS (PARTITION BY user_id)
), counted AS (
  SELECT *, count(*) FILTER (usable AND standard) OVER w AS marked, count(*) FILTER (usable) OVER w AS size FROM pool WINDOW w AS (PARTITION BY user_id)
), graded AS (
  SELECT *, CASE WHEN user_id % 5 = 0 AND id = 'v' || user_id THEN 0 WHEN user_id % 3 = 0 AND id = 'v7' THEN 1 WHEN usable THEN 2 END AS tier,
    CASE WHEN marked > 0 AND marked < size AND usable AND standard THEN 1000 ELSE 0 END + CASE WHEN contains(wish, '-') AND tag = wish THEN 200 WHEN starts_with(tag, wish[:2]) THEN 100 ELSE 0 END
      + CASE WHEN contains(name, '(premium)') THEN 10 ELSE 0 END + CASE WHEN local THEN 5 ELSE 0 END AS score FROM counted
)
SELECT CAST(user_id AS VARCHAR) AS session, id AS voice_id, CAST(tier AS INTEGER) AS tier FROM graded WHERE tier IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY tier, CASE WHEN tier = 2 THEN -score ELSE 0 END, n) = 1""",
    "v_http_errors": f"""WITH e AS (SELECT event_id, [200, 400, 401, 403, 404, 429, 429, 500, 503][1 + event_id % 9] AS answer, event_id % 2 = 0 AS quota FROM events),
c AS (SELECT *, CASE WHEN answer < 300 THEN NULL WHEN answer IN (401, 403) THEN 'not_configured' WHEN answer = 429 AND quota THEN 'quota_exhausted' WHEN answer = 429 THEN 'rate_limited' WHEN answer = 400 THEN 'invalid_request' WHEN answer >= 500 THEN 'provider_unavailable' ELSE 'internal_error' END AS code FROM e)
SELECT event_id, c.code, k.status AS answer_status, CAST(CASE WHEN answer = 429 THEN 10 END AS INTEGER) AS retry_after FROM c LEFT JOIN (VALUES {', '.join(f"({lit(c)}, {s})" for c, s, _ in ERRORS)}) k(code, status) ON k.code = c.code""",
    "v_guard": f"""WITH {QUEUE}, r AS (SELECT document_id, id, text, ['openai', 'azure', 'mock', 'other'][1 + queue_index % 4] AS provider, queue_index * 0.45::DOUBLE AS speed FROM queue)
SELECT document_id, id, CASE WHEN k.provider IS NULL THEN 'not_configured' WHEN length(text) > 1500 THEN 'text_too_long' WHEN {trim('text')} = '' THEN 'invalid_request' WHEN speed < slow OR speed > fast THEN 'unsupported_speed' WHEN length(text) > most THEN 'text_too_long' END AS error_code
FROM r LEFT JOIN (VALUES {', '.join(f"({lit(c[0])}, {c[5]}::DOUBLE, {c[6]}::DOUBLE, {c[7]})" for c in CAPABILITIES)}) k(provider, slow, fast, most) ON k.provider = r.provider""",
    "st_remap": f"""WITH {QUEUE}, f AS (SELECT document_id, CASE WHEN page_number % 2 = 0 THEN 'old:' || id ELSE id END AS id, page_number, queue_index, {trim(sub('text', f'[{WS}]+', ' '))} AS key, row_number() OVER (PARTITION BY document_id ORDER BY queue_index) - 1 AS position FROM queue WHERE region_type <> 'footnote'),
p AS (SELECT document_id, 'old:' || id AS id, page_number, queue_index, {trim(sub('text', f'[{WS}]+', ' '))} AS key FROM queue),
m AS (SELECT p.document_id, p.id AS sentence_id, min(position) FILTER (f.id = p.id) AS by_id, min(position) FILTER (f.page_number = p.page_number AND f.key = p.key) AS by_text, min(position) FILTER ((f.page_number, f.queue_index) >= (p.page_number, p.queue_index)) AS by_place, max(position) AS last
  FROM p JOIN f ON f.document_id = p.document_id GROUP BY p.document_id, p.id)
SELECT document_id, sentence_id, CAST(coalesce(by_id, by_text, by_place, last) AS INTEGER) AS "index", coalesce(by_id, by_text) IS NOT NULL AS exact FROM m""",
    "st_playback": f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, [{', '.join(map(lit, TRANSITIONS))}][1 + event_id * 7 % {len(TRANSITIONS)}] AS kind, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (
  SELECT DISTINCT session, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n, 'idle' AS state, CAST(NULL AS VARCHAR) AS sentence, CAST(NULL AS BIGINT) AS page, 1.0::DOUBLE AS speed FROM e
  UNION ALL
  SELECT e.session, e.seq, e.n, CASE
      WHEN kind = 'PREPARE' THEN 'preparing' WHEN kind = 'READY' AND state = 'preparing' THEN 'paused' WHEN kind = 'PLAY' AND state <> 'error' THEN 'playing'
      WHEN kind = 'PAUSE' AND state IN ('playing', 'buffering', 'seeking', 'preparing') THEN 'paused' WHEN kind IN ('STOP', 'END_OF_QUEUE') THEN 'stopped' WHEN kind IN ('BUFFER', 'SET_VOICE') AND state = 'playing' THEN 'buffering'
      WHEN kind IN ('SEEK_SENTENCE', 'SEEK_TIME') THEN 'seeking' WHEN kind = 'SEEK_COMMITTED' AND state = 'seeking' THEN 'playing' WHEN kind = 'TICK' AND state IN ('playing', 'buffering') THEN 'playing'
      WHEN kind = 'ERROR' THEN 'error' WHEN kind = 'CLEAR_ERROR' AND state = 'error' THEN 'paused' ELSE state END,
    CASE WHEN kind IN ('SEEK_SENTENCE', 'SENTENCE_ADVANCED') THEN 's' || e.seq ELSE sentence END, CASE WHEN kind IN ('SEEK_SENTENCE', 'SENTENCE_ADVANCED') THEN e.seq % 9 ELSE page END,
    CASE WHEN kind = 'SET_SPEED' THEN least(3.0::DOUBLE, greatest(0.5::DOUBLE, floor(value / 20 * 100 + 0.5::DOUBLE) / 100)) ELSE speed END
  FROM f JOIN e ON e.session = f.session AND e.n = f.n + 1
)
SELECT session, seq, state, sentence AS active_sentence_id, CAST(page AS INTEGER) AS active_page, round(speed, 6) AS speed FROM f WHERE n > 0""",
    "g_reading_order": f"""WITH {LINES}, {GEOMETRY}, a AS (SELECT document_id, page_number, baseline, x FROM geo WHERE across),
b AS (SELECT g.document_id, g.page_number, g.line_index, g.across, g.col, g.baseline, g.x, count(a.baseline) FILTER (a.baseline > g.baseline OR a.baseline = g.baseline AND (NOT g.across OR a.x <= g.x)) AS band FROM geo g LEFT JOIN a USING (document_id, page_number) GROUP BY ALL)
SELECT document_id, page_number, line_index, CAST(row_number() OVER (PARTITION BY document_id, page_number ORDER BY band, CAST(NOT across AS INTEGER), CASE WHEN across THEN -1 ELSE col END, baseline DESC, x, line_index) - 1 AS INTEGER) AS reading_index FROM b""",
    "g_assign_column": f"""WITH {BOXES} SELECT document_id, source_index, CAST(CASE WHEN x + 30 > 52 AND x < 178 AND x + 30 > 182 AND x < 328 THEN -1 WHEN x + 30 > 52 AND x < 178 THEN 0 WHEN x + 30 > 182 AND x < 328 THEN 1
  WHEN greatest(50 - (x + 15), x + 15 - 180, 0) <= greatest(180 - (x + 15), x + 15 - 330, 0) THEN 0 ELSE 1 END AS INTEGER) AS column_index FROM items""",
}

# --- items on pages of sixty words, five rows of twelve

_ITEMS = """words AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(range(len(w))) AS k, unnest(w) AS text FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)),
items AS (SELECT document_id, CAST(k // 60 + 1 AS INTEGER) AS page_number, k, k % 12 * 45.0::DOUBLE + 20 AS x, 700.0::DOUBLE - k % 60 // 12 * 25 AS y, text FROM words)"""
SQL |= {
    "g_dedupe_items": f"""WITH {_ITEMS}, twice AS (SELECT document_id, page_number, k, x, y, text FROM items UNION ALL SELECT document_id, page_number, k + 100000000, x + 0.5, y, text FROM items),
seen AS (SELECT t.document_id, t.page_number, t.k, bool_or(coalesce(o.k < t.k AND abs(o.x - t.x) <= 1 AND abs(o.y - t.y) <= 1, FALSE)) AS removed FROM twice t LEFT JOIN items o ON o.document_id = t.document_id AND o.page_number = t.page_number AND o.text = t.text AND {trim('t.text')} <> '' GROUP BY ALL)
SELECT document_id, page_number, count(*) FILTER (removed) AS removed, count(*) FILTER (NOT removed) AS kept FROM seen GROUP BY ALL""",
    "g_lines": f"""WITH {_ITEMS}, shown AS (SELECT document_id, page_number, k, x, y, {_normal('text')} AS part FROM items WHERE {trim('text')} <> ''),
spaced AS (SELECT *, lag(part) OVER (PARTITION BY document_id, page_number, y ORDER BY k) AS before FROM shown),
rows AS (SELECT document_id, page_number, y, string_agg(CASE WHEN before IS NULL OR {has('before', f'[{WS}]$')} OR {has('part', f'^[{WS}]')} THEN part ELSE ' ' || part END, '' ORDER BY k) AS text, min(x) AS x FROM spaced GROUP BY document_id, page_number, y)
SELECT document_id, page_number, CAST(row_number() OVER (PARTITION BY document_id, page_number ORDER BY y DESC) - 1 AS INTEGER) AS line_index, text, x, y AS baseline, 10.0::DOUBLE AS font_size FROM rows""",
}

SQL |= {
    "q_reader_paragraphs": f"""WITH {REGIONS}, {APPLIED}
SELECT document_id, id || ':para0' AS paragraph_id, type AS region_type, page_number, included, confidence >= 0.5 AND confidence < 0.8 AND type NOT IN ('paragraph', 'heading') AS uncertain, 1 AS n_sentences,
  included AND {trim(spoken('text'))} <> '' AS spoken, CASE WHEN included AND {trim(spoken('text'))} <> '' THEN CAST({has('text', _BULLETED)} AS INTEGER) + len(regexp_extract_all({sub('text', _BULLETED, '')}, {lit(_SKIPPED.replace('|' + _AUTHORS, ''))})) ELSE 0 END AS n_skipped FROM applied""",
    "q_segments": f"""WITH {LINES}, bulleted AS (SELECT document_id, line_no, text, regexp_extract(text, {lit(_BULLETED)}) AS b FROM lines),
cut AS (SELECT document_id, line_no, b, regexp_extract_all(text[length(b) + 1:], {lit(_SKIPPED)}) AS gone, string_split_regex(text[length(b) + 1:], {lit(_SKIPPED)}) AS kept FROM bulleted),
parts AS (SELECT document_id, line_no, 0 AS place, b AS text, TRUE AS skipped FROM cut UNION ALL SELECT document_id, line_no, unnest(range(1, 2 * len(kept), 2)), unnest(kept), FALSE FROM cut UNION ALL SELECT document_id, line_no, unnest(range(2, 2 * len(gone) + 1, 2)), unnest(gone), TRUE FROM cut)
SELECT document_id, line_no, CAST(row_number() OVER w - 1 AS INTEGER) AS segment, text, skipped, CAST(sum(length(text)) OVER w - length(text) AS INTEGER) AS start FROM parts WHERE text <> '' WINDOW w AS (PARTITION BY document_id, line_no ORDER BY place)""",
    "q_announcements": f"""WITH {QUEUE}, marks AS (SELECT document_id, paragraph_id, min(page_number) AS page, min(queue_index) AS first FROM queue GROUP BY ALL HAVING min(page_number) % 2 = 1),
every AS (SELECT document_id, id, queue_index AS o, 1 AS late, page_number, text AS speech_text, FALSE AS announcement FROM queue
  UNION ALL SELECT document_id, 'marker:' || paragraph_id, first, 0, page, CASE WHEN page % 4 = 1 THEN 'Figure on page ' || page || ', not described.' ELSE 'Drawn area on page ' || page || '. The text inside is read in page order.' END, TRUE FROM marks)
SELECT document_id, id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY o, late) - 1 AS INTEGER) AS queue_index, page_number, speech_text, announcement FROM every""",
}

# --- detectors: lines as blocks, four a page

_MARKED = f"""marked AS (
  SELECT *, CASE WHEN j = 0 THEN CASE WHEN n % 8 = 5 THEN 'Running head ' || page WHEN n % 4 = 0 THEN CAST(page AS VARCHAR) WHEN n % 4 = 1 THEN 'Page ' || page WHEN n % 4 = 3 THEN '- ' || page || ' -' WHEN page <= 2 THEN repeat('i', page) ELSE CAST(page AS VARCHAR) END
      ELSE coalesce(named, CASE WHEN n % 4 = 0 THEN text || ' (2019) pp. 12-34, vol.2' END, text) END AS t, named IS NOT NULL AS head, document_id || ':' || k AS id,
    CASE WHEN j = 0 AND n % 8 <> 0 THEN CASE WHEN n % 7 = 0 AND page % 2 = 0 THEN 330 ELSE 290 END WHEN j = 3 THEN 72 ELSE 54 END::DOUBLE AS x
  FROM (SELECT document_id, line_no AS k, CAST(line_no // 4 + 1 AS INTEGER) AS page, line_no % 4 AS j, CAST(document_id AS BIGINT) AS n, text,
      CASE WHEN line_no = 1 AND CAST(document_id AS BIGINT) % 3 = 0 THEN 'Preface' WHEN line_no = 2 AND CAST(document_id AS BIGINT) % 5 = 0 THEN 'References' WHEN line_no = 7 AND CAST(document_id AS BIGINT) % 10 = 0 THEN 'Appendix' END AS named FROM lines)
)"""
_NUMBERS = f"""form AS (SELECT *, {form('trim(t)')} AS form, x + 5.5::DOUBLE * length(t) / 2 AS centre FROM marked WHERE j = 0),
drift AS (SELECT *, count(*) OVER w AS many, abs(centre - avg(centre) OVER w) AS drift FROM form WHERE form IS NOT NULL WINDOW w AS (PARTITION BY document_id)),
numbers AS (SELECT document_id, id, CASE WHEN many < 2 THEN 0.75::DOUBLE - 0.05::DOUBLE WHEN drift <= 12 THEN 0.75::DOUBLE + 0.15::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM drift)"""
_SIGNALS = " + ".join(f"CAST({has('t', p)} AS INTEGER)" for _, p in ENTRY_SIGNALS)
_RUNS = f"""walled AS (SELECT m.*, c.id IS NOT NULL OR m.head AS wall FROM marked m LEFT JOIN claimed c ON c.id = m.id),
islands AS (SELECT *, sum(CAST(wall AS INTEGER)) OVER (PARTITION BY document_id ORDER BY k) AS island, {_SIGNALS} AS signs, {score('t')} AS score FROM walled),
dense AS (SELECT document_id, island, count(*) >= 3 AND count(DISTINCT x) = 2 AND max(x) - min(x) BETWEEN 6 AND 48 AS hanging FROM islands WHERE NOT wall GROUP BY document_id, island HAVING count(*) >= 3 AND avg(score) >= 0.6),
runs AS (SELECT i.document_id, i.id, CASE WHEN hanging THEN 0.72::DOUBLE ELSE 0.6::DOUBLE END AS confidence, 2 + CAST(hanging AS INTEGER) AS n_evidence FROM islands i JOIN dense USING (document_id, island) WHERE NOT wall)"""
_SECTIONS = f"""named AS (SELECT *, {heading('t')} AS named_type FROM marked),
opened AS (SELECT *, max(CASE WHEN named_type IS NOT NULL THEN k END) OVER (PARTITION BY document_id ORDER BY k) AS opener FROM named),
inside AS (SELECT *, CASE WHEN named_type IS NULL AND head THEN k END AS ender FROM opened WHERE opener IS NOT NULL),
kept AS (SELECT i.*, first_value(named_type) OVER (PARTITION BY document_id, opener ORDER BY k) AS type, min(ender) OVER (PARTITION BY document_id, opener) AS ends FROM inside i),
sections AS (SELECT document_id, id, type, CASE WHEN named_type IS NOT NULL THEN 0.92::DOUBLE ELSE least(0.95::DOUBLE, 0.82::DOUBLE + {score('t')} * 0.13::DOUBLE) END AS confidence, CASE WHEN named_type IS NULL AND {_SIGNALS} > 0 THEN 2 ELSE 1 END AS n_evidence FROM kept WHERE ends IS NULL OR k < ends),
claimed AS (SELECT id FROM sections)"""
_REFERENCES = f"""{_SECTIONS}, {_RUNS}, refs AS (SELECT document_id, id, type, confidence, n_evidence FROM sections UNION ALL SELECT document_id, id, 'reference', confidence, n_evidence FROM runs)"""
_FRONT = f"""numbered AS (SELECT document_id, page, trim(t) AS t FROM marked WHERE j = 0 AND {form('trim(t)')} IS NOT NULL),
roman AS (SELECT DISTINCT document_id, page FROM numbered WHERE {has('t', '(?i)^[ivxlcdm]{1,7}$')}),
arabic AS (SELECT document_id, min(page) AS first_arabic FROM numbered WHERE {has('t', '^[0-9]+$')} GROUP BY document_id),
why AS (SELECT m.document_id, m.id, m.page, list_filter([CASE WHEN r.page IS NOT NULL THEN 'page ' || m.page || ' is numbered with a roman numeral' END, CASE WHEN {has(trim('t'), FRONT_MATTER)} THEN 'the region is a conventional front-matter heading ("' || {trim('t')} || '")' END], lambda x: x IS NOT NULL) AS own,
  CASE WHEN m.page < first_arabic THEN ' and it precedes page ' || first_arabic || ', the first arabic-numbered page' ELSE '' END AS earlier
  FROM marked m LEFT JOIN roman r ON r.document_id = m.document_id AND r.page = m.page LEFT JOIN arabic a ON a.document_id = m.document_id),
front AS (SELECT document_id, id, CASE WHEN len(own) > 0 THEN 'front matter because ' || array_to_string(own, ' and ') || earlier ELSE 'on page ' || page || ', which was identified as front matter' END AS reason
  FROM (SELECT *, bool_or(len(own) > 0) OVER (PARTITION BY document_id, page) AS any_own FROM why) WHERE any_own)"""
_HEADS = f"""paged AS (SELECT document_id, count(DISTINCT page) AS n_pages FROM marked GROUP BY document_id),
heads AS (SELECT document_id, id, page, {signature(trim('t'))} AS signature FROM marked WHERE j = 0 AND {trim('t')} <> ''),
alike AS (SELECT document_id, signature, count(DISTINCT page) AS on_pages, n_pages FROM heads JOIN paged USING (document_id) GROUP BY ALL HAVING count(DISTINCT page) >= 2),
repeated AS (SELECT document_id, id, least(0.97::DOUBLE, 0.35::DOUBLE + CASE WHEN on_pages >= greatest(2, ceil(n_pages * 0.3::DOUBLE)) THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN on_pages / n_pages >= 0.6 THEN 0.15::DOUBLE ELSE 0 END + 0.2::DOUBLE) AS confidence,
  4 + CASE WHEN on_pages < greatest(2, ceil(n_pages * 0.3::DOUBLE)) THEN 1 ELSE 0 END AS n_evidence FROM heads JOIN alike USING (document_id, signature))"""
SQL |= {
    "c_page_numbers": f"WITH {LINES}, {_MARKED}, {_NUMBERS} SELECT document_id, id, round(confidence, 6) AS confidence FROM numbers",
    "c_density_runs": f"WITH {LINES}, {_MARKED}, claimed AS (SELECT '' AS id), {_RUNS} SELECT document_id, id, round(confidence, 6) AS confidence, n_evidence FROM runs",
    "c_references": f"WITH {LINES}, {_MARKED}, {_REFERENCES} SELECT document_id, id, type, round(confidence, 6) AS confidence FROM refs",
    "c_front_matter": f"WITH {LINES}, {_MARKED}, {_FRONT} SELECT document_id, id, reason FROM front",
    "c_watermarks": f"""WITH {LINES}, {_MARKED}, stamps AS (SELECT *, n % 3 = 0 AS turned FROM marked WHERE j = 2 AND (n % 2 = 0 OR page % 3 = 1) AND n % 3 < 2), paged AS (SELECT document_id, count(DISTINCT page) AS n_pages FROM marked GROUP BY document_id),
graded AS (SELECT document_id, n_pages, turned, least(0.95::DOUBLE, 0.4::DOUBLE + CASE WHEN turned THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN turned THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN n_pages > 1 THEN 0.15::DOUBLE ELSE 0 END) AS confidence FROM stamps JOIN paged USING (document_id)
  GROUP BY document_id, n_pages, turned HAVING CASE WHEN n_pages > 1 THEN count(DISTINCT page) / n_pages >= 0.5 ELSE turned END)
SELECT s.document_id, s.id, round(confidence, 6) AS confidence, CAST(1 + CAST(n_pages > 1 AS INTEGER) AS INTEGER) AS n_evidence FROM stamps s JOIN graded USING (document_id)""",
    "c_arbitrate": f"""WITH {LINES}, {_MARKED}, {_NUMBERS}, {_HEADS}, {_REFERENCES}, {_FRONT},
claims AS (
  SELECT document_id, id, 0 AS k, CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS type, CASE WHEN head THEN 0.65::DOUBLE ELSE 0.5::DOUBLE END AS confidence, 1 AS n_evidence FROM marked
  UNION ALL SELECT document_id, id, 1, 'header', confidence, n_evidence FROM repeated UNION ALL SELECT document_id, id, 2, 'page-number', confidence, 3 FROM numbers
  UNION ALL SELECT document_id, id, 3, type, confidence, n_evidence FROM refs UNION ALL SELECT document_id, id, 4, NULL, -1, 1 FROM front)
SELECT document_id, id, arg_min(type, rank) AS type, round(arg_min(confidence, rank), 6) AS confidence, CAST(sum(n_evidence) AS INTEGER) AS n_evidence
FROM (SELECT *, row_number() OVER (PARTITION BY document_id, id ORDER BY coalesce(type = 'page-number', FALSE) DESC, confidence DESC, k) AS rank FROM claims) GROUP BY document_id, id""",
}

# --- blocks: lines with gaps, indents, sizes, faces and cells

_BLOCKS = f"""geo AS (
  SELECT document_id, page_number, line_no % 40 AS k, text, CASE WHEN line_no % 40 % 6 = 1 THEN 74 ELSE 54 END::DOUBLE AS x, least(480.0::DOUBLE, 5.5::DOUBLE * length(text)) AS width, CASE WHEN line_no % 40 % 11 = 0 THEN 14 WHEN line_no % 40 > 35 THEN 8 ELSE 11 END::DOUBLE AS size,
    line_no % 40 % 13 = 0 AS bold, line_no % 40 BETWEEN 3 AND 6 AND CAST(document_id AS BIGINT) % 3 < 2 AS cells, line_no % 40 = 4 AND CAST(document_id AS BIGINT) % 5 = 0 AS askew,
    738.0::DOUBLE - 14 * (line_no % 40) - 12 * (line_no % 40 // 8) - CASE WHEN line_no % 40 >= 3 AND CAST(document_id AS BIGINT) % 3 = 0 THEN 30 ELSE 0 END - CASE WHEN line_no % 40 >= 7 AND CAST(document_id AS BIGINT) % 3 < 2 THEN 30 ELSE 0 END AS baseline FROM lines
), gaps AS (SELECT *, lag(baseline) OVER w - baseline AS gap, lag(size) OVER w AS before_size, lag(text) OVER w AS before_text FROM geo WINDOW w AS (PARTITION BY document_id, page_number ORDER BY k)),
usual AS (SELECT document_id, page_number, median(gap) AS usual, count(*) AS n_lines FROM gaps GROUP BY ALL),
walk AS (
  SELECT document_id, page_number, k, x AS edge, 0 AS block FROM gaps WHERE k = 0
  UNION ALL
  SELECT document_id, page_number, k, CASE WHEN apart THEN x ELSE least(edge, x) END, CASE WHEN apart THEN block + 1 ELSE block END FROM (
    SELECT g.*, w.edge, w.block, coalesce(u.usual > 0 AND g.gap > u.usual * 1.6::DOUBLE, FALSE) OR abs(g.before_size - g.size) / greatest(g.before_size, g.size) > 0.06 OR (g.x - w.edge > g.size * 0.6::DOUBLE AND {has('g.before_text', SENTENCE_END)}) AS apart
    FROM walk w JOIN gaps g ON g.document_id = w.document_id AND g.page_number = w.page_number AND g.k = w.k + 1 JOIN usual u ON u.document_id = g.document_id AND u.page_number = g.page_number)
), sized AS (SELECT document_id, page_number, size, sum(length(text)) AS w, min(k) AS at0 FROM geo GROUP BY ALL),
page_size AS (SELECT document_id, page_number, size FROM sized QUALIFY row_number() OVER (PARTITION BY document_id, page_number ORDER BY w DESC, at0) = 1),
doc_size AS (SELECT document_id, size FROM (SELECT document_id, size, sum(w) AS w, min((page_number, at0)) AS at0 FROM sized GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY w DESC, at0) = 1),
page_face AS (SELECT document_id, page_number, bold FROM (SELECT document_id, page_number, bold, sum(length(text)) AS w, min(k) AS at0 FROM geo GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY document_id, page_number ORDER BY w DESC, at0) = 1),
made AS (
  SELECT document_id, page_number, block, {trim("string_agg(text, ' ' ORDER BY k)")} AS t, median(size) AS size, min(baseline) AS low, max(width) AS width, count(*) AS n, arg_min(bold, k) AS first_bold, bool_or(bold) AS any_bold, arg_min(text, k) AS first_text,
    min(k) FILTER (cells) AS first_cells, max(k) FILTER (cells) AS last_cells, count(*) FILTER (cells) AS n_cells, arg_min(askew, k) FILTER (cells) AS first_askew, count(*) FILTER (cells AND NOT askew) AS straight, count(*) FILTER (cells AND askew) AS bent
  FROM walk JOIN geo USING (document_id, page_number, k) GROUP BY document_id, page_number, block
), body AS (SELECT m.*, CASE WHEN u.n_lines >= 4 THEN p.size ELSE d.size END AS body, m.first_bold <> f.bold AS other FROM made m JOIN usual u USING (document_id, page_number) JOIN page_size p USING (document_id, page_number) JOIN doc_size d USING (document_id) JOIN page_face f USING (document_id, page_number)),
sure AS (SELECT *, 0.4::DOUBLE + CASE WHEN size > body * 1.04::DOUBLE THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN any_bold THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN other THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN {has('t', SENTENCE_END)} THEN 0 ELSE 0.1::DOUBLE END + CASE WHEN width < 480 * 0.7::DOUBLE THEN 0.05::DOUBLE ELSE 0 END AS sure FROM body),
typed AS (
  SELECT *, CASE WHEN {has('t', CAPTION)} THEN 'caption' WHEN low < 792 * 0.22::DOUBLE AND size < body * 0.85::DOUBLE THEN 'footnote' WHEN n <= 3 AND length(t) <= 120 AND (size > body * 1.04::DOUBLE OR any_bold OR other) AND sure >= 0.6 THEN 'heading' WHEN {has('first_text', LIST_PREFIX)} THEN 'list' ELSE 'paragraph' END AS type,
    CASE WHEN first_askew THEN bent ELSE straight END AS aligned FROM sure
), split AS (SELECT *, type <> 'heading' AND n_cells >= 2 AND aligned >= 2 AND n_cells >= (last_cells + 1 - first_cells) * 0.6 AS has_table FROM typed)"""
SQL |= {
    "g_block_type": f"""WITH RECURSIVE {LINES}, {_BLOCKS}, parts AS (
  SELECT w.document_id, w.page_number, w.block, w.k, g.baseline, g.cells, s.type, s.sure, s.aligned, s.has_table, s.n, CASE WHEN NOT has_table THEN '' WHEN w.k < first_cells THEN 'pre' WHEN w.k > last_cells THEN 'post' ELSE 'table' END AS part
  FROM walk w JOIN geo g USING (document_id, page_number, k) JOIN split s USING (document_id, page_number, block)
)
SELECT document_id, page_number, CAST(row_number() OVER (PARTITION BY document_id, page_number ORDER BY min(k)) - 1 AS INTEGER) AS block_index, document_id || ':p' || page_number || ':r' || block || CASE WHEN part = '' OR count(*) = any_value(n) THEN '' ELSE ':' || part END AS id,
  CASE WHEN part = 'table' THEN 'table' ELSE any_value(type) END AS type,
  round(CASE WHEN part = 'table' THEN least(0.9::DOUBLE, 0.55::DOUBLE + any_value(aligned) * 0.08::DOUBLE) WHEN any_value(type) = 'caption' THEN 0.75::DOUBLE WHEN any_value(type) IN ('footnote', 'list') THEN 0.7::DOUBLE WHEN any_value(type) = 'heading' THEN least(0.9::DOUBLE, any_value(sure)) ELSE 0.5::DOUBLE END, 6) AS confidence,
  CAST(count(*) AS INTEGER) AS n_lines, CAST(CASE WHEN part = 'table' THEN count(*) FILTER (cells) ELSE 0 END AS INTEGER) AS n_rows, min(baseline) AS y, max(baseline) + 11 - min(baseline) AS height
FROM parts GROUP BY document_id, page_number, block, part""",
    "g_page_geometry": f"""WITH {_ITEMS}, shown AS (SELECT document_id, page_number, count(*) FILTER ({trim('text')} <> '') AS n, min(x) FILTER ({trim('text')} <> '') AS lo, max(x + 40) FILTER ({trim('text')} <> '') AS hi FROM items GROUP BY document_id, page_number)
SELECT document_id, page_number, 1 AS n_columns, coalesce(lo, 0.0::DOUBLE) AS start, coalesce(hi, 612.0::DOUBLE) AS "end", CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM shown""",
    "g_drawn": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id AS n, CAST(doc_id % 7 * 20 + 10 AS DOUBLE) AS s FROM documents),
figures AS (SELECT document_id, 50.0::DOUBLE AS x, CAST(n % 10 * 30 + 200 AS DOUBLE) AS y, s * 2 AS width, s AS height, s >= 612 * 0.08::DOUBLE AS big, s / 2 >= 612 * 0.08::DOUBLE AS second FROM d),
shapes AS (SELECT document_id, 300.0::DOUBLE AS x, 100.0::DOUBLE AS y, 2 * s + 20 AS width, s + 10 AS height, s FROM d UNION ALL SELECT document_id, 400 - 2 * s, 500.0::DOUBLE, 2 * s, s, s FROM d),
drawings AS (SELECT *, s >= 612 * 0.06::DOUBLE AND 2 * s * s BETWEEN 612 * 792 * 0.01::DOUBLE AND 612 * 792 * 0.7::DOUBLE AS big FROM shapes)
SELECT document_id, 1 AS page_number, 'figure' AS kind, 0 AS rect_index, x, y, CASE WHEN second THEN greatest(width, width * 0.25 + width) ELSE width END AS width, height FROM figures WHERE big
UNION ALL SELECT document_id, 1, 'drawing', CAST(row_number() OVER (PARTITION BY document_id ORDER BY y DESC) - 1 AS INTEGER), x, y, width, height FROM drawings WHERE big""",
}

# --- services around reading

_XML = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_VOICES = """v AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS n, CASE WHEN event_id % 11 = 0 THEN 'Zarvox' WHEN event_id % 5 = 0 THEN 'Zoe (Premium)' ELSE 'Voice ' || event_id END AS name, ['en-GB', 'en-US', 'fr-FR', 'de-DE'][1 + event_id % 4] AS tag FROM events)"""
_HALVES = """halves AS (
  SELECT document_id, id, s AS sentence_index, CASE WHEN s = 0 THEN 0 ELSE length(text) // 2 END AS start, CASE WHEN s = 0 THEN length(text) // 2 ELSE length(text) END AS stop, text FROM queue, (VALUES (0), (1)) k(s)
)"""
_PAPERS = """plain AS (SELECT document_id, queue_index, regexp_replace(text, '[^A-Za-z0-9 .,]+', '', 'g') AS t FROM queue),
runs AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY queue_index) AS INTEGER) AS page_number, queue_index, string_split(t, ' ')[:30] AS w FROM plain),
words AS (SELECT document_id, page_number, queue_index, unnest(range(len(w))) AS k, unnest(w) AS text FROM runs)"""
SQL |= {
    "n_ssml": f"""WITH {QUEUE}, r AS (SELECT *, round_even((1 + (queue_index % 5 - 2) * 0.125::DOUBLE - 1) * 100, 0) AS rate FROM queue)
SELECT document_id, id, '<speak version="1.0" xmlns="http://www.w3.org/2001/10/synthesis" xml:lang="en-US"><voice name="a &quot;&lt;b&gt;&amp;' || queue_index || '"><prosody rate="' || CASE WHEN rate < 0 THEN '' ELSE '+' END || CAST(rate AS INTEGER) || '%">' || {_XML.format('text')} || '</prosody></voice></speak>' AS ssml FROM r""",
    "n_uploads": """WITH e AS (SELECT *, CAST(trunc(value * 1048576) AS BIGINT) AS size FROM events)
SELECT event_id, CASE WHEN size > 40 * 1048576 THEN 'That file is ' || CAST(CAST(round_even(size / 1048576.0::DOUBLE, 0) AS BIGINT) AS VARCHAR) || ' MB, which is larger than the 40 MB limit for this deployment.' END AS refusal,
  event_type || '_e' || event_id || CASE WHEN event_id % 3 = 0 THEN '_.pdf' ELSE '.pdf' END AS file, CAST(event_id % 7 * 1048576 AS BIGINT) AS bytes, 'a|' || event_type || '|b' AS origins, event_id % 2 = 0 AND event_id % 4 <> 0 AS logs,
  ['Exact word timing from the speech provider', 'Exact word timing from your browser', 'Estimated word position (the provider did not supply word timings)', 'Sentence-level highlighting only'][1 + event_id % 4] AS timing FROM e""",
    "n_fingerprints": f"""WITH {QUEUE}, h AS (SELECT document_id, id, octet_length(encode(text)) AS size, {fnv('text')} AS whole FROM queue), f AS (SELECT document_id, id, {fnv("(length(CAST(size AS VARCHAR)) || ':' || size || '|' || length(id) || ':' || id || '|16:' || whole)")} AS fingerprint FROM h)
SELECT document_id, id, fingerprint, 'doc-' || fingerprint[:12] AS file_id FROM f""",
    "s_pdf_items": f"""WITH {QUEUE}, {_PAPERS} SELECT document_id, page_number, CAST(row_number() OVER (PARTITION BY document_id, page_number ORDER BY k) - 1 AS INTEGER) AS source_index, text, 54.0::DOUBLE + 90 * (k % 5) AS x, 700.0::DOUBLE - 14 * (k // 5) AS y, 10.0::DOUBLE + queue_index % 3 AS font_size, 'ltr' AS direction FROM words WHERE text <> ''""",
    "s_pdf_pages": f"""WITH {QUEUE}, {_PAPERS} SELECT document_id, page_number, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, 0 AS rotation, CAST(3 AS BIGINT) AS n_ops, 150.0::DOUBLE + queue_index AS "right" FROM runs""",
    "s_pdf_errors": f"""WITH {QUEUE} SELECT document_id, CAST(s AS INTEGER) AS state, s IN (0, 3) AS is_pdf, CASE s WHEN 1 THEN 'That file is empty.' WHEN 2 THEN 'That file is not a PDF.' WHEN 3 THEN 'That PDF looks incomplete or damaged.' END AS refusal FROM (SELECT DISTINCT document_id FROM queue), (VALUES (0), (1), (2), (3)) k(s)""",
    "t_marker_spans": f"""WITH {QUEUE}, {_HALVES}, spans AS (SELECT document_id, id, p - 2 AS a, p + 3 AS b FROM (SELECT document_id, id, unnest(range(0, CAST(length(text) + 1 AS BIGINT), 7)) AS p FROM queue) WHERE p % 4 = 1),
met AS (SELECT h.*, greatest(a, start) AS x, least(b, stop) AS y FROM halves h JOIN spans USING (document_id, id) WHERE b > start AND a < stop),
cut AS (SELECT document_id, id, sentence_index, text[x + 1:y] AS part, x - start AS s, y - start AS e FROM met),
ends AS (SELECT document_id, id, sentence_index, s + length(part) - length({sub('part', f'^[{WS}]+', '')}) AS a, e - length(part) + length({trim_end('part')}) AS b FROM cut)
SELECT document_id, id, CAST(sentence_index AS INTEGER) AS sentence_index, string_agg(a || '-' || b, ',' ORDER BY a, b) AS spans FROM ends WHERE b > a GROUP BY ALL""",
    "t_transformations": f"""WITH {QUEUE}, {_HALVES}, log AS (SELECT document_id, id, unnest(range(0, CAST(length(text) + 1 AS BIGINT), 5)) AS "offset" FROM queue)
SELECT document_id, id, CAST(sentence_index AS INTEGER) AS sentence_index, CAST("offset" AS INTEGER) AS "offset" FROM halves JOIN log USING (document_id, id) WHERE "offset" BETWEEN start AND stop""",
    "m_overrides": f"""WITH {REGIONS}, {APPLIED}, after AS (
  SELECT document_id, id, CASE WHEN type = 'footer' THEN 'include' ELSE 'exclude' END AS override FROM regions WHERE confidence = 0.9 AND reading_order % 3 = 2 UNION ALL SELECT document_id, id, 'include' FROM regions WHERE reading_order % 3 = 0)
SELECT document_id, id, override, 'changed' AS step FROM after
UNION ALL SELECT a.document_id, a.id, override, 'restored' FROM after a JOIN applied p USING (document_id, id) WHERE p.included
UNION ALL SELECT document_id, id, 'include', 'restored' FROM applied WHERE NOT included""",
    "m_review_tabs": f"""WITH {REGIONS}, {APPLIED} SELECT 'all' AS tab, document_id, id FROM applied UNION ALL SELECT CASE WHEN included THEN 'included' ELSE 'excluded' END, document_id, id FROM applied
UNION ALL SELECT 'uncertain', document_id, id FROM applied WHERE included AND confidence >= 0.5 AND confidence < 0.8 AND type NOT IN ('paragraph', 'heading')""",
    "o_corrections": f"WITH {OCR} SELECT document_id, word_index, text AS original, text || '+' AS corrected FROM graded WHERE confidence < 0.4 AND word_index % 3 = 2",
    "o_remaining": f"WITH {OCR} SELECT document_id, page_number, word_index FROM graded WHERE confidence < 0.75 AND NOT confidence < 0.4",
    "o_gate": """SELECT event_id, CASE WHEN why IS NOT NULL THEN 'invalid_request' END AS error_code, why AS error_cause FROM (
  SELECT event_id, CASE WHEN event_id % 4 <> 1 THEN 'consent' WHEN trunc(value) * (event_id % 3) = 0 THEN 'empty' WHEN trunc(value) * (event_id % 3) > 60 THEN 'too large' END AS why FROM events)""",
    "o_flatten": f"""WITH {QUEUE}, w AS (SELECT document_id, queue_index, unnest(range(len(s))) AS k, unnest(s) AS text FROM (SELECT document_id, queue_index, string_split(text, ' ') AS s FROM queue))
SELECT document_id, queue_index AS page_number, CAST(row_number() OVER (PARTITION BY document_id, queue_index ORDER BY k) - 1 AS INTEGER) AS word_index, text, k % 10 / 10.0::DOUBLE AS confidence, k * 10.0::DOUBLE AS x, 5.0::DOUBLE AS y, 8.0::DOUBLE AS width, 12.0::DOUBLE AS height, CASE WHEN queue_index % 2 = 0 THEN 'en' END AS language FROM w WHERE text <> ''""",
    "tm_word_timings": f"""WITH {CHUNKS}, runs AS (SELECT document_id, page_number, id, at0, unnest(range(len(r))) AS k, unnest(r) AS t FROM (SELECT *, regexp_extract_all(text, {lit(f'[{WS}]+|[^{WS}]+')}) AS r FROM offs)),
placed AS (SELECT *, sum(length(t)) OVER (PARTITION BY document_id, page_number, id ORDER BY k) AS e FROM runs),
words AS (SELECT document_id, page_number, id, at0, e - length(t) AS s, e FROM placed WHERE NOT {has('t', f'^[{WS}]')})
SELECT document_id, page_number AS chunk_index, id AS sentence_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", round((at0 + s) / 14.5::DOUBLE - min((at0 + s) / 14.5::DOUBLE) OVER w, 6) AS audio_start, round((at0 + e) / 14.5::DOUBLE - min((at0 + s) / 14.5::DOUBLE) OVER w, 6) AS audio_end FROM words WINDOW w AS (PARTITION BY document_id, page_number, id)""",
    "tm_alignment": f"""WITH {QUEUE}, r AS (SELECT *, queue_index % 5 <> 4 AS spelt FROM queue WHERE text <> '')
SELECT document_id, id, CAST(CASE WHEN spelt THEN {words_of('text')} ELSE 0 END AS INTEGER) AS n, CASE WHEN spelt AND {words_of('text')} > 0 THEN (length(text) - length({sub('text', f'^[{WS}]+', '')})) * 0.5::DOUBLE END AS first, CASE WHEN spelt AND {words_of('text')} > 0 THEN length({trim_end('text')}) * 0.5::DOUBLE END AS last FROM r""",
    "tm_predicates": f"""WITH {QUEUE} SELECT document_id, id, queue_index % 6 IN (1, 3, 4) AS busy, queue_index % 6 IN (2, 3) AS playing, queue_index % 3 < 2 AS estimated, CAST({words_of('text[:queue_index * 9]')} AS INTEGER) AS word FROM queue""",
    "v_report": f"""WITH {_VOICES}, m AS (SELECT *, list_filter([CASE WHEN n % 9 = 0 THEN 'default' END, CASE WHEN contains(name, '(Premium)') THEN 'premium/enhanced' END, CASE WHEN n % 2 <> 0 THEN 'over the network' END, CASE WHEN n = 7 THEN 'IN USE' END], lambda x: x IS NOT NULL) AS marks FROM v)
SELECT session, n AS list_index, '  ' || name || ' · ' || tag || CASE WHEN len(marks) > 0 THEN ' · ' || array_to_string(marks, ', ') ELSE '' END AS line FROM m""",
    "v_catalogue": f"""WITH {_VOICES}, own AS (SELECT session, 'v' || n AS id, 'browser' AS source, 1 AS k, n FROM v WHERE n % 50 = 0), every AS (SELECT * FROM own UNION ALL SELECT DISTINCT session, 's' || i, 'server', 0, i FROM own, (VALUES (0), (1)) x(i) WHERE CAST(session AS BIGINT) % 2 = 0)
SELECT session, id, source, CAST(row_number() OVER (PARTITION BY session ORDER BY k, n) - 1 AS INTEGER) AS list_index FROM every""",
    "v_envelopes": """SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'rate_limited' WHEN 3 THEN 'invalid_voice' ELSE 'internal_error' END AS code, CASE event_id % 4 WHEN 1 THEN 'm' || event_id WHEN 3 THEN 'v' ELSE 'The request failed.' END AS message,
  CASE WHEN event_id % 4 = 3 THEN 'Choose' END AS recovery, event_id % 4 = 1 AS retryable, CAST(CASE WHEN event_id % 4 = 1 THEN event_id % 9 END AS INTEGER) AS retry_after_seconds FROM events""",
    "v_speech_requests": """WITH r AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value / 20 ELSE 1.0::DOUBLE END AS speed, CASE event_id % 4 WHEN 0 THEN 'ogg' WHEN 1 THEN 'wav' ELSE 'mp3' END AS format FROM events)
SELECT event_id, speed, 'en-US' AS language, format, array_to_string(list_filter([CASE WHEN event_id % 3 = 0 THEN 'text' END, CASE WHEN event_id % 5 = 0 THEN 'voiceId' END, CASE WHEN speed < 0.25 OR speed > 4 THEN 'speed' END, CASE WHEN event_id % 7 = 0 THEN 'cacheKey' END, CASE WHEN format = 'ogg' THEN 'format' END], lambda x: x IS NOT NULL), ',') AS invalid FROM r""",
    "v_ocr_requests": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'image/gif' WHEN 1 THEN 'image/jpeg' ELSE 'image/png' END AS mime_type, event_id % 2 = 0 AS consent, 0 AS hints,
  array_to_string(list_filter([CASE WHEN event_id % 3 = 0 THEN 'image' END, CASE WHEN event_id % 4 = 0 THEN 'mimeType' END, CASE WHEN event_id % 5 = 0 THEN 'pageNumber' END, CASE WHEN event_id % 7 = 0 THEN 'documentId' END], lambda x: x IS NOT NULL), ',') AS invalid FROM events""",
    "v_responses": f"WITH {QUEUE} SELECT document_id, id, to_base64(encode(text)) AS audio, TRUE AS timed FROM queue",
    "v_capabilities": f"SELECT * FROM (VALUES {', '.join(f'({lit(c[0])}, {c[1]}, {c[2]}, {c[5]}::DOUBLE, {c[6]}::DOUBLE, {c[7]})' for c in CAPABILITIES)}) k(provider, streaming, word_timing, speed_min, speed_max, max_chars)",
    "v_diagnostics": f"""WITH {LINES}, pg AS (SELECT document_id, page_number, sum(length(text)) < 200 AS scanned, count(*) FILTER (length(text) > 20) AS pieces FROM lines GROUP BY ALL)
SELECT document_id, count(*) AS pages_read, count(*) FILTER (scanned) AS scanned, count(*) FILTER (page_number % 3 = 0) AS failed, CAST(sum(pieces) AS BIGINT) AS text_pieces FROM pg GROUP BY document_id""",
    "s_latest": """SELECT user_id || '|' || event_type AS key, arg_max(value, (event_id * 37 % 1009, event_id)) AS value, arg_max(event_id, (event_id * 37 % 1009, event_id)) AS event_id FROM events GROUP BY ALL""",
    "s_usage": f"""WITH {QUEUE}, o AS (SELECT document_id, max(length(text)) AS m FROM queue GROUP BY ALL ORDER BY m DESC, document_id LIMIT 10)
SELECT 'used' AS what, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n, count(*) AS entries FROM queue UNION ALL SELECT 'recent ' || document_id, CAST(m AS BIGINT), 1 FROM o""",
    "st_expired": "SELECT CAST(user_id AS VARCHAR) AS client, event_id AS seq FROM events WHERE 300000.0 - event_id * 60.0 > 86400.0",
    "g_sentence_boxes": f"""WITH {BOXES}, placed AS (SELECT document_id, source_index // 8 AS s, x, y + source_index % 3 * 0.1::DOUBLE AS y FROM items WHERE source_index < 40),
by_level AS (SELECT document_id, s, floor(y * 2 + 0.5) / 2 AS level, min(x) AS x, min(y) AS y, max(x + 30) AS r FROM placed GROUP BY ALL)
SELECT document_id, CAST(s AS INTEGER) AS sentence_index, CAST(row_number() OVER (PARTITION BY document_id, s ORDER BY level DESC) - 1 AS INTEGER) AS nth, round(x, 6) AS x, round(y, 6) AS y, round(r - x, 6) AS width, 10.0::DOUBLE AS height FROM by_level""",
}

_PLAYED = SQL["st_playback"].rsplit("\nSELECT ", 1)[0]
SQL |= {
    "st_held_queue": f"""{_PLAYED}, g AS (SELECT session, seq, state, CASE WHEN seq % 11 = 0 THEN seq END AS version FROM f WHERE n > 0),
calm AS (SELECT *, max(CASE WHEN state NOT IN ('playing', 'buffering') THEN seq END) OVER w AS calm, max(version) OVER w AS latest FROM g WINDOW w AS (PARTITION BY session ORDER BY seq)),
taken AS (SELECT c.session, c.seq, c.state, c.version, c.latest, max(g.version) AS active FROM calm c LEFT JOIN g ON g.session = c.session AND g.version <= c.calm GROUP BY ALL)
SELECT session, seq, state, version, active, CASE WHEN latest IS DISTINCT FROM active THEN latest END AS pending FROM taken""",
    "st_continue": f"""WITH r AS ({SQL["st_remap"]}), q AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, CASE WHEN (turn // 2 + 1) % 2 = 0 THEN 'old:' ELSE '' END || conv_id || ':' || turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE role IS DISTINCT FROM 'user')
SELECT r.document_id, sentence_id, q.id AS next_id FROM r LEFT JOIN q ON q.document_id = r.document_id AND q.place = r."index" + CAST(exact AS INTEGER)""",
    "k_attempts": """WITH n AS (SELECT user_id || '|' || event_type AS chunk, event_id AS seq, event_id % 4 = 0 AS ok, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS attempt FROM events),
won AS (SELECT chunk, min(attempt) FILTER (ok AND attempt <= 3) AS won FROM n GROUP BY chunk)
SELECT chunk, seq, ok, CAST(attempt AS INTEGER) AS attempt, attempt <= coalesce(won, 3) AS made, CASE WHEN attempt >= won THEN 'ready' WHEN attempt < 3 THEN 'failed' ELSE 'given-up' END AS status FROM n JOIN won USING (chunk)""",
    "k_prefetch": f"""WITH c AS ({SQL["k_chunks"]}) SELECT a.document_id, a.chunk_index AS at, b.chunk_index FROM c a JOIN c b ON a.document_id = b.document_id AND a.chunk_index % 2 = 0 AND b.chunk_index BETWEEN a.chunk_index AND a.chunk_index + 2""",
}
