"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, content_sort, html_text, language, lm_score, mixing, pieces, simhash, topk, toxicity
from .common import crc_remainder, documents, table


#: Each turn of conversation -7 holds the template's own control strings.
_HOSTILE = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", _HOSTILE), (-7, 1, "assistant", _HOSTILE)], "conv_id long, turn long, role string, text string")
    return chat.format_digests(rows.unionByName(more))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    18 + length(replace(replace(replace(replace(role, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>'), '### ', '\### '))
       + length(replace(replace(replace(replace(text, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>'), '### ', '\### ')) AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_components(documents(spark, sf_dir), shingle=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir), crc_remainder(F.col("doc_id"), 5) == 1)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(documents(spark, sf_dir))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


#: The rows for pages that declare an article, as all given ones do: its blocks, without what repeats on a host.
OP5_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS t FROM pages
), b AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(t, '<br[^>]*>', ' ', 'g'), '</?(p|h[1-6]|ul|ol|li|div)[^>]*>', chr(1), 'g'), '<[^>]*>', '', 'g') AS t FROM a
), c AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(replace(replace(t, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;?', '&', 'g') AS t FROM b
), d AS (
  SELECT page_id, url, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(regexp_replace(x, '[\s\x{A0}]+', ' ', 'g'), ' ')), lambda x: x <> '') AS blocks FROM c
)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10))) AS BIGINT) AS n_chars FROM d
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = crc_remainder(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.predict(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


OP7_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.rid <> c.rid
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = crc_remainder(F.col("doc_id"), 5) == 0
    learned = language.learn(docs, ~held)
    return language.predict(docs.withColumn("held_out", held), learned, ["doc_id", "held_out"])


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(documents(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip", "decoded_sha256")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


OP10_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, (ARRAY[5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source
), r AS (
  SELECT *, 3 * n * 10 / w AS reach, sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY 3 * n * 10 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY 3 * n * 10 / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM s
), l AS (
  SELECT CAST(rest AS BIGINT) AS rest, CAST(free AS BIGINT) AS free FROM r WHERE w * rest <= 3 * n * free ORDER BY reach, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, n, CASE WHEN w * l.rest > 3 * n * l.free THEN CAST(3 * n AS DOUBLE) ELSE CAST(w * l.rest AS DOUBLE) / l.free END AS target FROM s, l
), q AS (
  SELECT *, least(3 * n, CAST(floor(target + 0.5) AS BIGINT)) AS quota, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s, (n + 4095) // 4096 AS blocks FROM t
), p AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE quota // n * blocks + (quota % n + 4095) // 4096 END AS need,
    sum(quota) OVER (ORDER BY s) / greatest(1.0, CAST(sum(quota) OVER () AS DOUBLE)) AS bound FROM q
), g AS (
  SELECT t, (SELECT count(*) FROM p WHERE bound <= CAST((t % 2147483648) * 1327217885 % 2147483648 AS DOUBLE) / CAST(2147483648 AS DOUBLE) AND s < (SELECT max(s) FROM p)) AS s
  FROM (SELECT unnest(range(CAST((SELECT sum(need) FROM p) AS BIGINT))) AS t)
), h AS (
  SELECT t, s, row_number() OVER (PARTITION BY s ORDER BY t) - 1 AS rank FROM g
), u AS (
  SELECT t, s, rank FROM h JOIN p USING (s) WHERE rank < need
  UNION ALL
  SELECT (SELECT sum(need) FROM p) + k AS t, s, given + k AS rank
  FROM (SELECT s, given, unnest(range(CAST(need - given AS BIGINT))) AS k FROM (SELECT p.s, need, (SELECT count(*) FROM g WHERE g.s = p.s) AS given FROM p) WHERE need > given)
), f AS (
  SELECT t, u.s, rank % blocks AS block, least((rank % blocks + 1) * 4096, n, quota - rank // blocks * n) AS upto FROM u JOIN p USING (s)
), o AS MATERIALIZED (
  SELECT d.*, p.s, p.n, p.target, row_number() OVER () AS rid, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), c AS (
  SELECT rid, s, block, greatest(pos, block * 4096) AS lo, least(pos + size, (block + 1) * 4096) AS hi
  FROM (SELECT *, unnest(range(CAST(pos // 4096 AS BIGINT), CAST((pos + size - 1) // 4096 + 1 AS BIGINT))) AS block FROM o WHERE size > 0)
), m AS (
  SELECT rid, sum(least(hi, upto) - lo) AS taken, min(t) AS first_slot FROM c JOIN f USING (s, block) WHERE upto > lo GROUP BY rid
)
SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(first_slot AS BIGINT) AS first_slot
FROM o LEFT JOIN m USING (rid)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op5_html_text": OP5_SQL, "op7_topk_search": OP7_SQL, "op10_source_mix": OP10_SQL}
