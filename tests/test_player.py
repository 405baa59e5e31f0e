import os

import duckdb
import pytest

import __spark_entry__
from pagewright.functions import text
from pagewright.operators import chunking, state, voices

DATA = "/root/testdata/sf0.001"


def test_words_of_empty_null_and_long_texts(spark):
    rows = [(0, None), (1, ""), (2, " \n "), (3, " a  bé\tc "), (4, "w " * 50_000)]
    got = {r.k: r.w for r in spark.createDataFrame(rows, "k int, t string").select("k", text.words("t").alias("w")).collect()}
    assert [got[k] for k in (0, 1, 2)] == [[], [], []] and len(got[4]) == 50_000
    assert [tuple(w) for w in got[3]] == [("a", 1, 2), ("bé", 4, 6), ("c", 7, 8)]


def test_held_queues(spark):
    rows = [("s", 1, "idle", 1), ("s", 2, "playing", None), ("s", 3, "playing", 2), ("s", 4, "buffering", 3), ("s", 5, "paused", None), ("s", 6, "playing", 4), ("t", 1, None, None), ("t", 2, "playing", 9)]
    got = state.held_queues(spark.createDataFrame(rows, "session string, seq int, state string, version int")).orderBy("session", "seq").collect()
    assert [(r.active, r.pending) for r in got] == [(1, None), (1, None), (1, 2), (1, 3), (3, None), (3, 4), (None, None), (None, 9)]
    assert state.held_queues(spark.createDataFrame(rows[:0], "session string, seq int, state string, version int")).count() == 0


def test_continuation(spark):
    remapped = spark.createDataFrame([("d", "a", 0, True), ("d", "b", 1, False), ("d", "c", 1, True)], "document_id string, sentence_id string, index int, exact boolean")
    following = spark.createDataFrame([("d", "a", 0), ("d", "x", 1)], "document_id string, id string, position int")
    got = {r.sentence_id: r.next_id for r in state.continue_after(remapped, following).collect()}
    assert got == {"a": "x", "b": "x", "c": None}


def test_attempts_and_prefetch(spark):
    rows = [("c", 1, False), ("c", 2, True), ("c", 3, False), ("d", 1, False), ("d", 2, False), ("d", 3, False), ("d", 4, True)]
    got = chunking.attempts(spark.createDataFrame(rows, "chunk string, seq int, ok boolean")).orderBy("chunk", "seq").collect()
    assert [(r.made, r.status) for r in got] == [(True, "failed"), (True, "ready"), (False, "ready"), (True, "failed"), (True, "failed"), (True, "given-up"), (False, "given-up")]
    made = spark.createDataFrame([("d", k) for k in range(4)], "document_id string, chunk_index int")
    wanted = chunking.prefetch(spark.createDataFrame([("d", 2), ("e", 0)], "document_id string, at int"), made)
    assert sorted((r.at, r.chunk_index) for r in wanted.collect()) == [(2, 2), (2, 3)]


def test_audio_is_one_line(spark):
    got = voices.responses(spark.createDataFrame([(bytes(200),)], "audio binary")).first()
    assert "\n" not in got.audio and len(got.audio) == 268


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", ["c_arbitrate", "g_block_type", "k_chunks", "st_playback", "k_lru_ttl", "st_held_queue", "g_lines", "s_pdf_items"])
def test_queries_against_their_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, DATA)
    names = sorted(got.columns)
    sql = duckdb.connect()
    for table in ("documents", "pages", "conversations", "events"):
        sql.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = sql.execute(__spark_entry__.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(n) for n in names]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted(repr([plain(r[k]) for k in at]) for r in found.fetchall())
    assert want and sorted(repr([plain(r[n]) for n in names]) for r in got.collect()) == want
