"""SQL (DuckDB's dialect) that gives the rows of the named queries by other means: windows, joins and
recursive queries over the same tables."""

from __future__ import annotations

from ..constants import ABBREVIATIONS, BULLETS, CAPTION, CLOSERS, CONTROL, ENTRY_SIGNALS, EXOTIC_SPACE, FRONT_MATTER, INVISIBLE, LIGATURES, LIST_PREFIX, PAGE_NUMBERS, REFERENCE_HEADINGS, SENTENCE_END, TERMINATORS, WS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {lit(pattern)})"


def sub(column: str, pattern: str, to: str) -> str:
    return f"regexp_replace({column}, {lit(pattern)}, {lit(to)}, 'g')"


def trim(column: str) -> str:
    return sub(column, f"^[{WS}]+|[{WS}]+$", "")


def trim_end(column: str) -> str:
    return sub(column, f"[{WS}]+$", "")


def score(column: str) -> str:
    return f"least(1.0::DOUBLE, ({' + '.join(f'CAST({has(column, p)} AS INTEGER)' for _, p in ENTRY_SIGNALS)}) / 3.0::DOUBLE)"


def form(column: str) -> str:
    t = trim(column)
    return f"CASE WHEN {t} = '' THEN NULL {' '.join(f'WHEN {has(t, p)} THEN {lit(n)}' for n, p in PAGE_NUMBERS)} END"


def heading(column: str) -> str:
    t = trim(column)
    return f"CASE WHEN length({t}) > 40 THEN NULL {' '.join(f'WHEN {has(t, p)} THEN {lit(n)}' for n, _, p in REFERENCE_HEADINGS)} END"


def signature(column: str) -> str:
    return f"trim({sub(sub(f'lower({column})', '[0-9]+', '#'), '[^\\p{L}\\p{N}#]+', ' ')}, ' ')"


LINES = """lines AS (
  SELECT document_id, line_no, text, CAST(line_no // 40 + 1 AS INTEGER) AS page_number, 738.0::DOUBLE - 14 * (line_no % 40) AS baseline
  FROM (SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(unnest(range(len(s))) AS INTEGER) AS line_no, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
)"""
PIECES = f"""cur AS (
  SELECT document_id, line_no, {trim_end('text')} AS cur, lead(text) OVER (PARTITION BY document_id ORDER BY line_no) AS nxt FROM lines
), joints AS (
  SELECT *, coalesce({has('cur', '\\p{L}\\p{L}[-\\x{2010}\\x{2011}]$')} AND {has('nxt', f'^[{WS}]*\\p{{Ll}}')}, FALSE) AS hyphen FROM cur
), pieces AS (
  SELECT document_id, line_no, CASE WHEN hyphen THEN cur[:length(cur) - 1] WHEN nxt IS NOT NULL AND cur <> '' THEN cur || ' ' ELSE cur END AS piece,
    CASE WHEN hyphen THEN 'hyphen-join' WHEN nxt IS NOT NULL AND cur <> '' THEN 'line-wrap-join' END AS joint FROM joints
)"""
PARAGRAPHS = "paragraphs AS (SELECT document_id, string_agg(piece, '' ORDER BY line_no) AS text FROM pieces GROUP BY document_id)"
_TAIL = f"[{TERMINATORS}][{TERMINATORS}{CLOSERS}]*$"
_ABBR = ", ".join(lit(a) for a in ABBREVIATIONS)
SENTENCES = f"""toks AS (
  SELECT document_id, CAST(unnest(range(len(t))) AS INTEGER) AS k, unnest(t) AS tok FROM (SELECT document_id, regexp_extract_all(text, {lit(f'^[{WS}]+|[^{WS}]+[{WS}]*')}) AS t FROM paragraphs)
), bare AS (
  SELECT document_id, k, tok, {sub('tok', f'[{WS}]+', '')} AS b FROM toks
), parts AS (
  SELECT *, regexp_extract(b, {lit(_TAIL)}) AS tail, {sub('b', _TAIL, '')} AS head, lag(b) OVER w AS before, lead(tok) OVER w AS after FROM bare WINDOW w AS (PARTITION BY document_id ORDER BY k)
), words AS (
  SELECT *, {sub("lower(CASE WHEN head = '' THEN coalesce(before, '') ELSE head END)", '[^a-z.]', '')} AS word, {sub('lower(head)', '[^a-z.]', '')} AS own, length({sub('tail', '[^.]', '')}) AS stops FROM parts
), ends AS (
  SELECT *, coalesce(tail <> '' AND {has('after', '^[\\p{Lu}\\p{N}"' + "'" + '“‘(\\[]')} AND (
      {has('tail', '[!?…]')} OR stops >= 3 OR (stops = 2 AND own NOT IN ({_ABBR})) OR (stops = 1
        AND NOT (word IN ({_ABBR}) OR {sub('word', '[.]$', '')} IN ({_ABBR})) AND NOT {has('head', '(^|[(])[A-Za-z]$')}
        AND NOT {has(sub("lower(head || '.')", '[^a-z.]', ''), '^([a-z][.]){2,5}$')} AND NOT ({has('head', '[0-9]$')} AND {has('after', '^[0-9]')}))), FALSE) AS ends FROM words
), flags AS (
  SELECT document_id, k, tok, CASE WHEN k = 0 OR {has('tok', f'^[{BULLETS}][{WS}]+$')} OR lag(ends) OVER (PARTITION BY document_id ORDER BY k) THEN 1 ELSE 0 END AS starts FROM ends
), numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY document_id ORDER BY k) - 1 AS s FROM flags
), sents AS (
  SELECT document_id, CAST(s AS INTEGER) AS sentence_index, string_agg(tok, '' ORDER BY k) AS text FROM numbered GROUP BY document_id, s
)"""
REGIONS = """regions AS (
  SELECT document_id, document_id || ':r' || reading_order AS id, reading_order, CAST(reading_order // 10 + 1 AS INTEGER) AS page_number,
    CASE tag WHEN 'h1' THEN 'heading' WHEN 'p' THEN 'paragraph' WHEN 'a' THEN 'header' ELSE 'footer' END AS type,
    CASE tag WHEN 'h1' THEN 0.9 WHEN 'p' THEN 0.5 WHEN 'a' THEN 0.85 WHEN 'div' THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence, regexp_replace(m, '^<[^>]*>', '') AS text
  FROM (SELECT *, regexp_extract(m, '^<([a-z0-9]+)', 1) AS tag FROM (
    SELECT CAST(page_id AS VARCHAR) AS document_id, CAST(unnest(range(len(f))) AS INTEGER) AS reading_order, unnest(f) AS m
    FROM (SELECT page_id, regexp_extract_all(html, '<(?:h1|p|div class="ad"|a [^>]*|footer)>[^<]*') AS f FROM pages)))
)"""
QUEUE = """queue AS (
  SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(conv_id AS VARCHAR) || ':' || turn AS id, CAST(turn AS INTEGER) AS queue_index, CAST(turn // 2 + 1 AS INTEGER) AS page_number,
    CASE role WHEN 'user' THEN 'footnote' WHEN 'system' THEN 'heading' ELSE 'paragraph' END AS region_type, CAST(conv_id AS VARCHAR) || ':p' || turn // 3 AS paragraph_id, coalesce(text, '') AS text FROM conversations
)"""
OCR = """words AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, 1 AS page_number, CAST(unnest(range(len(w))) AS INTEGER) AS word_index, unnest(w) AS text, doc_id FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
), graded AS (
  SELECT *, (doc_id * 7 + word_index * 13) % 100 / 100.0::DOUBLE AS confidence FROM words
), fixes AS (
  SELECT document_id, word_index, text || '+' AS corrected FROM graded WHERE confidence < 0.4
)"""
BOXES = """rects AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, 1 AS page_number, CASE WHEN doc_id % 4 = 0 THEN 'figure' ELSE 'drawing' END AS kind, 0 AS rect_index, doc_id % 50 * 4.0::DOUBLE AS x, 300.0::DOUBLE AS y, 200.0::DOUBLE AS width, 200.0::DOUBLE AS height FROM documents
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, 'drawing', 1, 150.0::DOUBLE, doc_id % 20 * 15.0::DOUBLE, 250.0::DOUBLE, 180.0::DOUBLE FROM documents
), items AS (
  SELECT document_id, CAST(k AS INTEGER) AS source_index, CASE WHEN k % 5 = 0 THEN w || ' a b c' ELSE w END AS text, k * 37.0::DOUBLE + 20 AS x, 520.0::DOUBLE - k * 25 AS y FROM (
    SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(range(len(s))) AS k, unnest(s) AS w FROM (SELECT doc_id, string_split(text, ' ') AS s FROM documents))
)"""
_DECIDE = """CASE WHEN type NOT IN ('header', 'footer', 'page-number', 'watermark', 'reference', 'bibliography', 'index') THEN TRUE WHEN confidence >= 0.8 THEN FALSE ELSE TRUE END"""
APPLIED = f"applied AS (SELECT *, {_DECIDE} AS included FROM regions)"
OVERRIDDEN = "overridden AS (SELECT *, CASE WHEN confidence = 0.9 THEN CASE WHEN type = 'footer' THEN 'include' ELSE 'exclude' END END AS override, CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS pct FROM regions)"
BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: (instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1)"
_FNV = "lpad(lower(format('{:x}', list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform({B}, lambda x: x::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0')"


def fnv(column: str) -> str:
    return _FNV.replace("{B}", BYTES.replace("{0}", column))


def words_of(column: str) -> str:
    return f"len(regexp_extract_all({column}, {lit(f'[^{WS}]+')}))"


def _normal(column: str) -> str:
    for a, b in LIGATURES.items():
        column = f"replace({column}, {lit(a)}, {lit(b)})"
    return sub(sub(column, f"[\\x{{AD}}{INVISIBLE}{CONTROL}]", ""), f"[ \\t{EXOTIC_SPACE}]{{2,}}|[{EXOTIC_SPACE}]", " ")


_NUMBER = f"[{WS}]*[0-9]{{1,3}}([{WS}]*[,;-–][{WS}]*[0-9]{{1,3}})*[{WS}]*"
_MARK = f"(\\[{_NUMBER}\\]|\\({_NUMBER}\\)|[¹²³⁰⁴-⁹]+)"


def spoken(column: str) -> str:
    plain = sub(column, f"^[{WS}]*[{BULLETS}][{WS}]*", "")
    return sub(sub(plain, f"[{WS}]+{_MARK}([{WS}.,;:!?)\\]}}])", "\\4"), _MARK, "")


def _footnotes(key: str, extra: str = "") -> str:
    return f"""WITH {QUEUE}, keyed AS (SELECT *, {key} AS k FROM queue{extra}), firsts AS (SELECT *, min(queue_index) OVER (PARTITION BY document_id, k) AS f FROM keyed)
SELECT document_id, id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY f, CAST(region_type = 'footnote' AS INTEGER), queue_index) - 1 AS INTEGER) AS queue_index FROM firsts"""


_OVER = "{0}.x < {1}.x + {1}.width AND {0}.x + {0}.width > {1}.x AND {0}.y < {1}.y + {1}.height AND {0}.y + {0}.height > {1}.y"
CHUNKS = f"""{QUEUE}, offs AS (
  SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id, page_number ORDER BY queue_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at0 FROM queue
), tot AS (SELECT document_id, page_number, sum(length(text)) + count(*) - 1 AS total FROM queue GROUP BY ALL)"""
TOP_LINES = """top AS (SELECT document_id, line_no, text, CAST(document_id AS INTEGER) + 1 AS page, 738.0::DOUBLE - 14 * (line_no % 40) AS bottom FROM lines WHERE 738.0 - 14 * (line_no % 40) >= 792.0 * (1.0 - 0.1))"""
REPEATED = f"""{LINES}, {TOP_LINES}, cand AS (SELECT *, {signature(trim('text'))} AS signature, 792.0 - (bottom + 11) AS edge FROM top WHERE {trim('text')} <> ''),
np AS (SELECT count(DISTINCT document_id) AS n_pages FROM lines),
grp AS (SELECT signature, count(DISTINCT page) AS on_pages, count(*) AS n, stddev_pop(bottom) AS spread, avg(edge) AS mean_edge FROM cand GROUP BY signature HAVING count(DISTINCT page) >= 2),
graded AS (SELECT grp.*, least(0.97::DOUBLE, 0.35::DOUBLE + CASE WHEN on_pages >= greatest(2, ceil(n_pages * 0.3::DOUBLE)) THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN on_pages / n_pages >= 0.6 THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN spread <= 3 THEN 0.2::DOUBLE WHEN spread <= 8 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN mean_edge <= 40 THEN 0.1::DOUBLE ELSE 0 END) AS confidence FROM grp, np WHERE n_pages >= 2)"""
GEOMETRY = """geo AS (SELECT document_id, page_number, CAST(line_no % 40 AS INTEGER) AS line_index, text, line_no, CASE WHEN line_no % 2 = 0 THEN 54.0 ELSE 320.0 END::DOUBLE AS x, 738.0::DOUBLE - 14 * ((line_no % 40) // 2) AS baseline,
  CASE WHEN line_no % 7 = 0 THEN 14.0 ELSE 11.0 END::DOUBLE AS font_size, line_no % 10 = 0 AS across, line_no % 2 AS col, CASE WHEN line_no % 3 = 0 THEN 'f2' ELSE 'f1' END AS font FROM lines)"""

SQL: dict[str, str] = {
    "n_normalize": f"WITH {LINES} SELECT document_id, line_no, {_normal('text')} AS text FROM lines",
    "n_wrap_join": f"WITH {LINES}, {PIECES}, {PARAGRAPHS} SELECT * FROM paragraphs",
    "n_hyphen_joints": f"WITH {LINES}, {PIECES}, based AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM pieces) SELECT document_id, joint, count(*) AS n, CAST(max(base) AS BIGINT) AS last_base FROM based WHERE joint IS NOT NULL GROUP BY ALL",
    "n_signature": f"WITH {LINES} SELECT document_id, line_no, {signature('text')} AS signature FROM lines",
    "n_line_tests": f"WITH {LINES} SELECT document_id, line_no, {form('text')} AS page_form, {heading('text')} AS reference_type, round({score('text')}, 6) AS entry_score, {has(trim('text'), FRONT_MATTER)} AS front_matter, {has('text', CAPTION)} AS caption, {has('text', LIST_PREFIX)} AS list_item, {has('text', SENTENCE_END)} AS ends_sentence FROM lines",
    "n_words": f"""WITH {LINES}, runs AS (SELECT document_id, line_no, unnest(range(len(r))) AS k, unnest(r) AS text FROM (SELECT document_id, line_no, regexp_extract_all(text, {lit(f'[{WS}]+|[^{WS}]+')}) AS r FROM lines)),
placed AS (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY document_id, line_no ORDER BY k) AS INTEGER) AS e FROM runs)
SELECT document_id, line_no, CAST(row_number() OVER (PARTITION BY document_id, line_no ORDER BY k) - 1 AS INTEGER) AS word_no, text, CAST(e - length(text) AS INTEGER) AS start, e AS "end" FROM placed WHERE NOT {has('text', f'^[{WS}]')}""",
    "n_hash_keys": f"""WITH {LINES}, h AS (SELECT document_id, line_no, {fnv('text')} AS text_hash FROM lines)
SELECT document_id, line_no, text_hash, length(document_id) || ':' || document_id || '|' || length(CAST(line_no AS VARCHAR)) || ':' || line_no AS composite, {fnv("('4:mock|9:mock-en-1|4:1.25|5:en-US|16:' || text_hash)")} AS cache_key FROM h""",
    "n_titles": f"WITH {REGIONS} SELECT document_id, reading_order, CASE WHEN length(text) > 90 THEN text[:87] || '...' ELSE text END AS title, {trim(sub('text', f'[{WS}]+', ' '))} AS match_key, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM regions",
    "n_scalars": """SELECT event_id, CAST(floor(value) AS BIGINT) // 60 || ':' || lpad(CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock, round(least(3.0, greatest(0.5, floor(value / 20 * 100 + 0.5) / 100)), 6) AS speed,
CASE WHEN event_id % 2 = 0 THEN 'Figure on page ' || event_id || ' — not described' ELSE 'Drawn area on page ' || event_id || ' — a chart, table or box; the text inside is read in page order, which may not be the order it is meant to be read in' END AS label,
CASE WHEN event_id % 2 = 0 THEN 'Figure on page ' || event_id || ', not described.' ELSE 'Drawn area on page ' || event_id || '. The text inside is read in page order.' END AS speech, '[redacted] [redacted] end' AS redacted,
CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id WHEN event_id % 3 = 1 THEN 'peer' ELSE 'unknown' END AS client, round(value / (14.5::DOUBLE * 1.5::DOUBLE), 6) AS remaining, lower(event_type) AS provider FROM events""",
    "t_sentences": f"""WITH {LINES}, {PIECES}, {PARAGRAPHS}, {SENTENCES}, placed AS (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY document_id ORDER BY sentence_index) AS INTEGER) AS e FROM sents)
SELECT document_id, sentence_index, text, CAST(e - length(text) AS INTEGER) AS start, e AS "end" FROM placed""",
    "t_lossless": f"WITH {LINES}, {PIECES}, {PARAGRAPHS}, {SENTENCES} SELECT document_id, CAST(sum(length(text)) AS INTEGER) AS n, CAST(count(*) AS INTEGER) AS n_sentences FROM sents GROUP BY document_id",
    "t_paragraph_offsets": f"WITH {REGIONS} SELECT document_id, id, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY document_id ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS paragraph_offset FROM regions",
    "t_outline": f"WITH {REGIONS} SELECT document_id, id || ':outline' AS id, CASE WHEN length(text) > 90 THEN text[:87] || '...' ELSE text END AS title, page_number, 1 AS level, id AS region_id FROM regions WHERE type = 'heading' AND {trim('text')} <> ''",
    "t_inclusion": f"WITH {REGIONS}, {APPLIED} SELECT document_id, id || ':s0' AS id, CASE WHEN reading_order % 7 = 6 THEN 'included' WHEN NOT included THEN 'excluded' WHEN confidence >= 0.5 AND confidence < 0.8 THEN 'uncertain' ELSE 'included' END AS inclusion_status FROM applied",
    "t_document_index": f"WITH {REGIONS} SELECT document_id, id, reading_order AS document_index FROM regions",
    "c_repeated_groups": f"WITH {REPEATED} SELECT 'header' AS band, signature, on_pages, n, round(spread, 6) AS spread, round(mean_edge, 6) AS mean_edge, round(confidence, 6) AS confidence FROM graded",
    "c_repeated": f"WITH {REPEATED} SELECT document_id || ':' || line_no AS id, 'header' AS type, round(confidence, 6) AS confidence FROM cand JOIN graded USING (signature)",
    "m_clean": f"""WITH {REGIONS}, {OVERRIDDEN} SELECT document_id, id, CASE WHEN override = 'include' THEN TRUE WHEN override = 'exclude' THEN FALSE ELSE {_DECIDE} END AS included,
CASE WHEN override = 'include' THEN 'You chose to include this region.' WHEN override = 'exclude' THEN 'You chose to exclude this region.' WHEN type IN ('paragraph', 'heading') THEN 'Classified as ' || type || ', which Clean Mode always reads.'
WHEN confidence >= 0.8 THEN 'Detected as ' || type || ' with ' || pct || '% confidence, above the 80% threshold for automatic exclusion. You can restore it at any time.'
ELSE 'Possibly ' || type || ' (' || pct || '% confidence), which is below the automatic-exclusion threshold. It is still being read and has been flagged for your review.' END AS inclusion_reason,
CASE WHEN override IS NOT NULL THEN FALSE WHEN type IN ('paragraph', 'heading') THEN confidence < 0.5 ELSE confidence < 0.8 END AS uncertain FROM overridden""",
    "m_custom": f"""WITH {REGIONS}, {OVERRIDDEN} SELECT document_id, id, CASE WHEN override IS NOT NULL THEN override = 'include' ELSE type IN ('paragraph', 'heading') END AS included,
CASE WHEN override = 'include' THEN 'You chose to include this region.' WHEN override = 'exclude' THEN 'You chose to exclude this region.' WHEN type IN ('paragraph', 'heading') THEN 'Body content is always read in Custom Mode.' ELSE 'Custom Mode: the "' || type || 's" category is switched off.' END AS inclusion_reason, FALSE AS uncertain FROM overridden""",
    "m_strict": f"""WITH {REGIONS}, {OVERRIDDEN} SELECT document_id, id, coalesce(override <> 'exclude', TRUE) AS included,
CASE WHEN override = 'include' THEN 'You chose to include this region.' WHEN override = 'exclude' THEN 'You chose to exclude this region.' ELSE 'Strict Verbatim Mode reads all extractable text, including headers, footers and references.' END AS inclusion_reason, FALSE AS uncertain FROM overridden""",
    "m_exclusion_summary": f"WITH {REGIONS}, {APPLIED} SELECT document_id, count(*) FILTER (included) AS included_regions, count(*) FILTER (NOT included) AS excluded_regions, CAST(coalesce(sum({words_of('text')}) FILTER (included), 0) AS BIGINT) AS included_words, CAST(coalesce(sum({words_of('text')}) FILTER (NOT included), 0) AS BIGINT) AS excluded_words FROM applied GROUP BY document_id",
    "m_exclusions_by_type": f"WITH {REGIONS}, {APPLIED} SELECT document_id, type, count(*) AS regions, CAST(sum({words_of('text')}) AS BIGINT) AS words FROM applied WHERE NOT included GROUP BY ROLLUP (document_id, type)",
    "m_uncertain": f"WITH {REGIONS}, {OVERRIDDEN} SELECT document_id, id, type FROM overridden WHERE override IS NULL AND confidence >= 0.5 AND confidence < 0.8 AND type NOT IN ('paragraph', 'heading')",
    "q_projection_simple": f"WITH {LINES} SELECT document_id, line_no, {spoken('text')} AS speech_text FROM lines",
    "q_footnotes_skip": f"WITH {QUEUE} SELECT document_id, id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY queue_index) - 1 AS INTEGER) AS queue_index FROM queue WHERE region_type <> 'footnote'",
    "q_footnotes_after_page": _footnotes("page_number"),
    "q_footnotes_after_section": _footnotes("sum(CAST(region_type = 'heading' AS INTEGER)) OVER (PARTITION BY document_id ORDER BY queue_index)"),
    "q_search": f"WITH {QUEUE} SELECT document_id, id, queue_index AS document_index FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY queue_index) AS n FROM queue WHERE contains(lower(text), 'the')) WHERE n <= 3",
    "q_remaining_chars": f"WITH {QUEUE} SELECT document_id, id, CAST(sum(length(text)) OVER (PARTITION BY document_id ORDER BY queue_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS remaining_characters FROM queue",
    "q_section_asof": f"""WITH {REGIONS}, heads AS (SELECT *, CASE WHEN length(text) > 90 THEN text[:87] || '...' ELSE text END AS title FROM regions WHERE type = 'heading' AND {trim('text')} <> ''), pg AS (SELECT DISTINCT document_id, page_number FROM regions)
SELECT pg.document_id, pg.page_number, (SELECT arg_max(h.title, h.reading_order) FROM heads h WHERE h.document_id = pg.document_id AND h.page_number <= pg.page_number) AS section FROM pg""",
    "q_drawn_areas": f"""WITH {BOXES}, free AS (SELECT * FROM rects a WHERE kind = 'drawing' AND NOT EXISTS (SELECT 1 FROM rects f WHERE f.kind = 'figure' AND f.document_id = a.document_id AND {_OVER.format('a', 'f')})),
met AS (SELECT a.*, i.text FROM free a JOIN items i ON a.document_id = i.document_id AND i.x + 30 > a.x AND i.x < a.x + a.width AND i.y + 10 > a.y AND i.y < a.y + a.height)
SELECT document_id, page_number, rect_index, x, y, width, height FROM met GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER ({words_of('text')} <= 3) / count(*) >= 0.7""",
    "q_place_markers": f"""WITH {BOXES}, drawn AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number, rect_index) - 1 AS n FROM rects WHERE kind = 'drawing'), figs AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number, rect_index) - 1 AS n FROM rects WHERE kind = 'figure')
SELECT d.document_id, d.document_id || ':para' || min(i.source_index) AS paragraph_id, 'drawn-area' AS kind, 'marker-drawn-1-' || d.n AS id FROM drawn d JOIN items i USING (document_id) GROUP BY d.document_id, d.n
UNION ALL SELECT f.document_id, f.document_id || ':para' || coalesce(min(i.source_index) FILTER (i.y + 10 < f.y + f.height), max(i.source_index)), 'figure', 'marker-figure-1-' || f.n FROM figs f JOIN items i USING (document_id) GROUP BY f.document_id, f.n""",
    "k_lossless": f"WITH {QUEUE} SELECT document_id, TRUE AS ok FROM queue WHERE {trim('text')} <> '' GROUP BY document_id",
    "k_chunk_lookup": f"""WITH RECURSIVE {QUEUE}, q AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY queue_index) AS n FROM queue WHERE {trim('text')} <> ''),
pack AS (SELECT document_id, n, id, 0 AS chunk, length(text) AS used, 0 AS s FROM q WHERE n = 1
UNION ALL SELECT q.document_id, q.n, q.id, CASE WHEN p.used + 1 + length(q.text) > 2500 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.used + 1 + length(q.text) > 2500 THEN length(q.text) ELSE p.used + 1 + length(q.text) END, CASE WHEN p.used + 1 + length(q.text) > 2500 THEN 0 ELSE p.used + 1 END FROM pack p JOIN q ON q.document_id = p.document_id AND q.n = p.n + 1)
SELECT document_id, id AS sentence_id, CAST(chunk AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS start, CAST(s + length((SELECT text FROM q WHERE q.id = pack.id)) AS INTEGER) AS "end" FROM pack""",
    "k_cache_misses": f"WITH {QUEUE}, k AS (SELECT *, md5(text) AS cache_key FROM queue) SELECT document_id, id, cache_key FROM k WHERE region_type = 'footnote' AND cache_key NOT IN (SELECT cache_key FROM k WHERE region_type <> 'footnote')",
    "k_retained_audio": "SELECT CAST(user_id AS VARCHAR) AS session, event_id AS chunk_index, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 12 AS kept FROM events",
    "tm_sentence_estimate": f"WITH {CHUNKS} SELECT document_id, page_number AS chunk_index, id AS sentence_id, round(at0 / greatest(total, 1) * (total / 14.5::DOUBLE), 6) AS audio_start, round((at0 + length(text)) / greatest(total, 1) * (total / 14.5::DOUBLE), 6) AS audio_end FROM offs JOIN tot USING (document_id, page_number) WHERE total > 0",
    "tm_pauses": f"WITH {QUEUE} SELECT document_id, id, CAST(CASE WHEN lead(id) OVER w IS NULL THEN 0 WHEN lead(paragraph_id) OVER w = paragraph_id THEN floor(260 / 1.5 + 0.5) ELSE floor(540 / 1.5 + 0.5) END AS INTEGER) AS pause_ms FROM queue WINDOW w AS (PARTITION BY document_id ORDER BY queue_index)",
    "tm_word_progress": f"WITH {QUEUE}, n AS (SELECT *, {words_of('text')} AS n, length(text) / 14.5::DOUBLE AS dur FROM queue) SELECT document_id, id, CAST(CASE WHEN n = 0 THEN NULL WHEN dur <= 0 THEN 0 ELSE least(n - 1, floor(least(1.0, greatest(0.0, (dur * (queue_index % 5) / 5 + 0.001::DOUBLE) / dur)) * n)) END AS INTEGER) AS word_index FROM n",
    "o_low_confidence": f"WITH {OCR} SELECT document_id, page_number, CAST(count(*) FILTER (confidence < 0.75) AS INTEGER) AS n, coalesce(string_agg(CAST(word_index AS VARCHAR), ',' ORDER BY word_index) FILTER (confidence < 0.75), '') AS indexes FROM graded GROUP BY ALL",
    "o_effective_words": f"WITH {OCR} SELECT g.document_id, page_number, word_index, coalesce(corrected, text) AS text FROM graded g LEFT JOIN fixes USING (document_id, word_index)",
    "o_to_items": f"WITH {OCR} SELECT document_id, page_number, word_index AS source_index, text, 20.0::DOUBLE * word_index / 2 AS x, 732.0::DOUBLE AS y, 9.0::DOUBLE AS width, 10.0::DOUBLE AS height, 10.0::DOUBLE AS font_size FROM graded",
    "o_summary": f"WITH {OCR} SELECT g.document_id, page_number, count(*) AS words, count(*) FILTER (confidence < 0.75 AND corrected IS NULL) AS low_confidence, count(corrected) AS corrected, FALSE AS empty, round(avg(confidence) + 1e-9, 6) AS confidence FROM graded g LEFT JOIN fixes USING (document_id, word_index) GROUP BY ALL",
    "o_splice": f"""WITH {LINES}, {OCR}, read AS (SELECT document_id, 1 AS page_number, 0 AS document_index, 'recognised' AS origin, string_agg(text, ' ' ORDER BY word_index) AS text FROM graded WHERE doc_id % 2 = 0 GROUP BY document_id),
base AS (SELECT document_id, page_number, line_no AS document_index, 'layer' AS origin, text FROM lines WHERE NOT (page_number = 1 AND CAST(document_id AS BIGINT) % 2 = 0) UNION ALL SELECT * FROM read)
SELECT document_id, page_number, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number, document_index) - 1 AS INTEGER) AS document_index, origin, text FROM base""",
    "v_failure_report": "SELECT CAST(user_id AS VARCHAR) AS document_id, event_type AS reason, string_agg(CAST(event_id AS VARCHAR), ', ' ORDER BY event_id) AS pages, count(*) AS n FROM events GROUP BY ALL",
    "v_groups": "SELECT CAST(user_id AS VARCHAR) AS session, CASE WHEN event_id % 11 = 0 THEN 'Novelty and legacy voices' WHEN event_id % 4 IN (0, 1) THEN 'Voices for reading' ELSE 'Other languages' END AS \"group\", count(*) AS n FROM events GROUP BY ALL",
    "st_milestones": f"WITH {LINES}, pg AS (SELECT document_id, page_number, max(page_number) OVER (PARTITION BY document_id) AS n FROM (SELECT DISTINCT document_id, page_number FROM lines)) SELECT document_id, CAST(m AS INTEGER) AS pages_analyzed, page_number FROM pg JOIN (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]) AS m) ON m < n AND page_number <= m",
    "st_rate_limit": """WITH RECURSIVE r AS (SELECT CAST(user_id AS VARCHAR) AS client, event_type AS bucket, event_id AS seq, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 / 3600 AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
f AS (SELECT client, bucket, seq, n, TRUE AS allowed, 0 AS retry_after, 1 AS c, t AS s FROM r WHERE n = 1
UNION ALL SELECT r.client, r.bucket, r.seq, r.n, r.t - f.s >= 60 OR f.c < 2, CASE WHEN r.t - f.s >= 60 OR f.c < 2 THEN 0 ELSE greatest(1, CAST(trunc(60 - (r.t - f.s)) AS INTEGER)) END, CASE WHEN r.t - f.s >= 60 THEN 1 WHEN f.c < 2 THEN f.c + 1 ELSE f.c END, CASE WHEN r.t - f.s >= 60 THEN r.t ELSE f.s END
FROM f JOIN r ON r.client = f.client AND r.bucket = f.bucket AND r.n = f.n + 1)
SELECT client, bucket, seq, allowed, CAST(retry_after AS INTEGER) AS retry_after FROM f""",
    "g_body_font": f"""WITH {LINES}, {GEOMETRY}, s AS (SELECT document_id, page_number, floor(font_size * 2 + 0.5) / 2 AS b, sum(length(text)) AS w, min(line_index) AS at0 FROM geo GROUP BY ALL), f AS (SELECT document_id, page_number, font, sum(length(text)) AS w, min(line_index) AS at0 FROM geo GROUP BY ALL)
SELECT document_id, page_number, body_size, body_font FROM (SELECT document_id, page_number, b AS body_size FROM s QUALIFY row_number() OVER (PARTITION BY document_id, page_number ORDER BY w DESC, at0) = 1) JOIN (SELECT document_id, page_number, font AS body_font FROM f QUALIFY row_number() OVER (PARTITION BY document_id, page_number ORDER BY w DESC, at0) = 1) USING (document_id, page_number)""",
    "g_scanned_pages": f"WITH {LINES} SELECT document_id, page_number, CAST(sum(length({trim('text')})) AS BIGINT) AS text_layer_char_count, sum(length({trim('text')})) < 20 AS likely_scanned, bool_or(length(text) > 500) AS reading_order_uncertain FROM lines GROUP BY ALL",
    "corpus_report": f"WITH {LINES}, {PIECES}, {PARAGRAPHS}, {SENTENCES} SELECT document_id, count(*) AS sentences, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(length({spoken('text')})) AS BIGINT) AS spoken_characters, CAST(sum({words_of('text')}) AS BIGINT) AS words FROM sents GROUP BY document_id",
}
