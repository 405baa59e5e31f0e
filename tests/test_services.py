import base64
import json

import pytest
from pyspark.sql import functions as F

from pagewright.functions import hashing, speech, text
from pagewright.operators import chunking, inclusion, ocr, reading, state, timing, voices
from pagewright.sources import stores
from pagewright.streaming import sessions


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize("t,form", [("12", "arabic numeral"), ("iv", "roman numeral"), ("XVII", "roman numeral"), ("p. 7", '"Page N"'), ("12 / 300", '"N of M"'), ("- 12 -", "dashed numeral"), ("3-14", "chapter-page numeral"), ("Page 3 of 9", '"Page N of M"'), ("2019", "arabic numeral"), ("", None), ("12345", None), ("word", None)])
def test_page_number_forms(spark, t, form):
    assert one(spark, text.page_number_form(F.col("t")), t=t) == form


@pytest.mark.parametrize("t,kind", [("References", "reference"), ("7. Works Cited:", "reference"), ("Bibliography", "bibliography"), ("IV. Index", "index"), ("References to earlier work in this long heading", None), ("Refer", None)])
def test_reference_headings(spark, t, kind):
    got = one(spark, text.reference_heading(F.col("t")), t=t)
    assert (got and got.type) == kind


def test_normalize_and_its_log(spark):
    raw = "ﬁne­ly​  put\u0007 a b"
    assert one(spark, text.normalize(F.col("t")), t=raw) == "finely put a b"
    log = one(spark, text.normalization_log(F.col("t"), F.lit("i1")), t=raw)
    assert [x.kind for x in log] == ["ligature-expand", "soft-hyphen-removal", "control-char-removal", "whitespace-collapse"]


def test_names_and_hashes(spark):
    names = {"../../etc/passwd": "passwd", "": "document.pdf", "Ré sumé.pdf": "Re_sume.pdf", "...": "document.pdf", "a\\b\\c.pdf": "c.pdf"}
    assert {k: one(spark, text.safe_filename(F.col("t")), t=k) for k in names} == names
    assert one(spark, hashing.hash64(F.col("t")), t="") == "cbf29ce484222325" and one(spark, hashing.hash64(F.col("t")), t="a") == "af63dc4c8601ec8c"
    assert one(spark, text.composite_key(F.col("a"), F.col("b")), a="x|y", b="z") == "3:x|y|1:z"
    assert len(one(spark, hashing.fingerprint(F.col("c"), F.lit("f")), c=bytearray(b"x" * 300_000))) == 16


def test_projection(spark):
    got = one(spark, speech.projection(F.col("t")), t="Alpha [12] beta gamma.")
    assert got.text == "Alpha beta gamma." and got.skipped[0].text == "[12]"
    placed = spark.createDataFrame([("Alpha [12] beta gamma.",)], "t string").withColumn("p", speech.projection(F.col("t")))
    assert placed.select(speech.display_offset(F.col("p.anchors"), F.lit(6)).alias("v")).first().v == 11
    assert speech.project("It rose (Smith et al., 2019) fast.", [], {"skip_numeric": True, "skip_superscript": True, "read_parenthetical": False})["text"] == "It rose fast."
    assert one(spark, speech.projection(F.col("t"), strict=True), t="A [1].")["text"] == "A [1]."
    assert speech.project("• item²", [], dict(skip_numeric=True, skip_superscript=True, read_parenthetical=True))["text"] == "item"
    said = spark.createDataFrame([("a [1] b (2) c",)], "t string").withColumn("p", speech.projection(F.col("t")))
    parts = said.select(speech.segments(F.col("t"), F.col("p.skipped")).alias("v")).first().v
    assert "".join(p.text for p in parts) == "a [1] b (2) c" and [p.skipped for p in parts] == [False, True, False, True, False]


def test_chunk_packing():
    entries = [("a", "one two", 1), ("b", "three", 1), ("c", " ", 2), ("d", "x" * 25, 2), ("e", "tail end of it all", 3)]
    got = list(chunking.pack(iter(entries), 13))
    assert [c["text"] for c in got] == ["one two three", "x" * 13, "x" * 12, "tail end of", "it all"]
    assert [c["continues_mid_word"] for c in got] == [False, False, True, False, False]
    assert got[0]["sentence_offsets"][1] == {"sentence_id": "b", "start": 8, "end": 13}


def test_chunks_are_lossless(spark):
    rows = [("d", k, f"s{k}", "word " * (k % 7) + "y" * (40 * (k % 3)), 1) for k in range(30)]
    q = spark.createDataFrame(rows, "document_id string, queue_index int, id string, speech_text string, page_number int")
    made = chunking.chunks(q, most=50)
    assert all(r.ok for r in chunking.lossless(q, made).collect()) and made.where(F.length("text") > 50).count() == 0
    assert made.select(F.countDistinct("cache_key"), F.countDistinct("text")).first()[0] == made.select("text").distinct().count()


def test_lru_and_ttl():
    c = chunking.LruCache(2, 60)
    assert not c.get("a", 0) and c.put("a", 0) == 0 and c.get("a", 1) and not c.get("a", 61)
    for k in "xyz":
        c.put(k, 100)
    assert list(c.held) == ["y", "z"]
    c.get("y", 101)
    c.put("w", 102)
    assert list(c.held) == ["y", "w"] and c.purge(500) == 2


def test_limiter():
    s, out = None, []
    for t in (0, 30, 61):
        s, ok, wait = state.limiter_step(s, t, 1)
        out.append((ok, wait))
    assert out == [(True, 0), (False, 30), (True, 0)] and state.limiter_step(None, 5, 0) == (None, True, 0)


def test_playback():
    e = {k: None for k in ("voice_id", "provider", "sentence_id", "paragraph_id", "region_id", "page", "audio_timestamp", "word_index", "source", "chunk_id", "speed", "volume", "message")}
    s = dict(state.IDLE)
    for kind, more, want in [("PREPARE", {"voice_id": "v"}, "preparing"), ("READY", {}, "paused"), ("PLAY", {}, "playing"), ("BUFFER", {}, "buffering"), ("TICK", {"audio_timestamp": 2.0}, "playing"), ("SET_VOICE", {"voice_id": "w"}, "buffering"), ("ERROR", {"message": "m"}, "error"), ("PLAY", {}, "error"), ("CLEAR_ERROR", {}, "paused"), ("NOPE", {}, "paused"), ("STOP", {}, "stopped")]:
        s = state.reduce_event(s, {**e, "type": kind, **more})
        assert s["state"] == want
    assert state.reduce_event(s, {**e, "type": "SET_SPEED", "speed": 9.0})["speed"] == 3.0


def test_streams_agree_with_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(f"c{k % 2}", "tts", k, float(k * 9)) for k in range(30)]
    schema = "client string, bucket string, seq long, now_seconds double"
    for part in range(2):
        spark.createDataFrame(rows[part * 15 : part * 15 + 15], schema).coalesce(1).write.parquet(f"{tmp_path}/in/p={part}")
    stream = spark.readStream.schema(schema + ", p int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("p")
    q = sessions.rate_limit(stream, 3).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = {tuple(r) for r in state.rate_limit(spark.createDataFrame(rows, schema), 3).collect()}
    assert {tuple(r) for r in spark.table("limited").collect()} == want


def test_timing(spark):
    row = spark.createDataFrame([("d", 0, "ab cd", [("s1", 0, 2), ("s2", 3, 5)], 0.9, 1.0)], "document_id string, chunk_index int, text string, sentence_offsets array<struct<sentence_id:string,start:int,end:int>>, audio_time double, duration_seconds double")
    assert timing.sentence_at(row).first().sentence_id == "s2"
    assert timing.sentence_at(row.withColumn("duration_seconds", F.lit(0.0))).first().sentence_id is None
    got = one(spark, timing.align_words(F.col("t"), F.col("c"), F.col("s"), F.col("e")), t="a bc", c=["a", " ", "b", "c"], s=[0.0, 1.0, 2.0, 3.0], e=[1.0, 2.0, 3.0, 4.0])
    assert [(w.start, w.end, w.audio_start, w.audio_end) for w in got] == [(0, 1, 0.0, 1.0), (2, 4, 2.0, 4.0)]
    wav = one(spark, timing.silent_wav(F.col("s")), s=0.1)
    assert bytes(wav[:4]) == b"RIFF" and len(wav) == 44 + 2 * 2205
    assert one(spark, text.format_time(F.col("s")), s=125.7) == "2:05"


def test_recognised_pages(spark):
    words = spark.createDataFrame([("d", 1, 0, "helo", 0.5, 200.0, 100.0, 40.0, 20.0), ("d", 1, 1, "you", 0.9, 0.0, 0.0, 1.0, 1.0)], "document_id string, page_number int, word_index int, text string, confidence double, x double, y double, width double, height double")
    pages = spark.createDataFrame([("d", 1, "mock", 0.7, 2.0, 612.0, 792.0, True)], "document_id string, page_number int, provider string, confidence double, render_scale double, page_width double, page_height double, accepted boolean")
    fixes = spark.createDataFrame([("d", 1, 0, "helo", "x", 1), ("d", 1, 0, "helo", "hello", 2), ("d", 1, 9, "a", "b", 1)], "document_id string, page_number int, word_index int, original string, corrected string, corrected_at long")
    assert [r.text for r in ocr.effective_words(words, fixes).orderBy("word_index").collect()] == ["hello", "you"]
    got = ocr.to_items(words, pages).orderBy("source_index").first()
    assert (got.transform[4], got.transform[5], got.width, got.height) == (100.0, 732.0, 20.0, 10.0)
    summary = ocr.page_summary(words, fixes, pages).first()
    assert (summary.words, summary.low_confidence, summary.corrected, summary.empty) == (2, 0, 3, False)
    answer = {"pages": [{"property": {"detectedLanguages": [{"languageCode": "en"}]}, "blocks": [{"paragraphs": [{"words": [{"symbols": [{"text": "h"}, {"text": "i"}], "confidence": 0.9, "boundingBox": {"vertices": [{"x": 5}, {"x": 15, "y": 4}]}}, {"symbols": []}]}]}]}]}
    df = spark.createDataFrame([("d", 1, json.dumps(answer))], "document_id string, page_number int, annotation string")
    w = ocr.flatten_annotation(df).collect()
    assert [(r.text, r.x, r.y, r.width, r.height) for r in w] == [("hi", 5.0, 0.0, 10.0, 4.0)]
    assert ocr.dominant_language(df).first().language == "en"


def test_voices(spark):
    v = spark.createDataFrame([("s", "a", "Zarvox", "en-GB", "browser", False, True, True, 0), ("s", "b", "Zoe", "en-US", "browser", True, False, True, 1), ("s", "c", "Kate", "en-GB", "browser", False, False, False, 2), ("s", "d", "Srv", "en-US", "server", True, False, False, 3)], "session string, id string, name string, language string, source string, neural boolean, system_default boolean, on_device boolean, list_index int")

    def pick(saved=None, server=None, lang="en-GB"):
        w = spark.createDataFrame([("s", saved, server, server is not None, lang)], "session string, saved_voice_id string, server_default_voice_id string, server_configured boolean, preferred_language string")
        return voices.default_voice(v, w).first().voice_id

    assert (pick(), pick(lang="en-US"), pick(saved="a"), pick(server="d"), pick(saved="gone", server="gone")) == ("c", "b", "a", "d", "c")


def test_requests(spark):
    raw = spark.createDataFrame([(json.dumps({"text": "hi", "voiceId": "v", "chunkId": "c", "cacheKey": "k", "speed": 9}),), ("{}",)], "body string")
    assert [r.invalid_fields for r in voices.parse_speech_requests(raw).collect()] == [["speed"], ["text", "voiceId", "chunkId", "cacheKey"]]
    out = voices.responses(spark.createDataFrame([(bytearray(b"ab"),)], "audio binary")).first().audio
    assert base64.b64decode(out) == b"ab"
    reg = voices.Registry()
    reg.register("Mock", lambda it: it, "body string")
    assert reg.run("", raw) is None and reg.run(" mock ", raw).count() == 2
    with pytest.raises(ValueError):
        reg.run("other", raw)


def test_stores(spark, tmp_path):
    s = stores.Store(spark, f"{tmp_path}/positions", "fingerprint string, last_page int")
    row = lambda f, p: spark.createDataFrame([(f, p)], "fingerprint string, last_page int")
    assert s.load().count() == 0
    s.put(row("a", 1), 1)
    s.put(row("b", 2), 2)
    s.put(row("a", 5), 3)
    s.delete(row("b", 0), 4)
    assert [(r.fingerprint, r.last_page) for r in s.load().collect()] == [("a", 5)] and s.clear(5) == 1 and s.load().count() == 0
    merged = stores.merge_settings({"citations": {"footnotes": "skip"}, "region_overrides": {"r": "include"}})
    assert merged["citations"]["footnotes"] == "skip" and merged["citations"]["skip_numeric"] and merged["region_overrides"] == {"r": "include"}


def test_modes_and_overrides(spark):
    r = spark.createDataFrame([("d", "r1", "header", 0.95, "head line"), ("d", "r2", "header", 0.7999999999999999, "x"), ("d", "r3", "paragraph", 0.5, "one two"), ("d", "r4", "watermark", 0.4, "w")], "document_id string, id string, type string, confidence double, text string")
    got = {x.id: (x.included, x.uncertain) for x in inclusion.apply_mode(r, "clean").collect()}
    assert got == {"r1": (False, False), "r2": (True, True), "r3": (True, False), "r4": (True, False)}
    over = inclusion.restore_all(r.limit(0).select("document_id", "id", F.lit("x").alias("override")), inclusion.apply_mode(r, "clean"))
    assert all(x.included for x in inclusion.apply_mode(r, "clean", None, over).collect())
    assert {x.id: x.included for x in inclusion.apply_mode(r, "custom", {"headers": True}).collect()} == {"r1": True, "r2": True, "r3": True, "r4": True}


def test_markers_are_announced_once(spark):
    schema = "document_id string, id string, paragraph_id string, page_number int, document_index int, text string, speech_text string, skipped array<string>, anchors array<int>, region_type string"
    e = spark.createDataFrame([("d", f"s{k}", f"p{k // 2}", 1, k, "t", "t", [], [], "paragraph") for k in range(4)], schema)
    placed = spark.createDataFrame([("d", "p1", "figure", 1, 0, "m0")], "document_id string, paragraph_id string, kind string, page_number int, marker_index int, id string")
    got = [r.id for r in reading.announcements(e, placed).orderBy("queue_index").collect()]
    assert got == ["s0", "s1", "m0", "s2", "s3"]
