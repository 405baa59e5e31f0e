"""Named queries of services around reading: requests, corrections, voices, stores, files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import chunking, inclusion, layout, ocr, sentences, state, timing, voices
from ..sources import fixtures, pdf, stores
from . import adapters as A
from .queries import QUERIES, _chunks, _overrides, _r, _remapped, _voices, query

__all__ = ["QUERIES"]


# --- strings and files


@query
def n_ssml(spark, d):
    q = A.conv_queue(spark, d)
    made = text.ssml(F.col("text"), F.concat(F.lit('a "<b>&'), F.col("queue_index").cast("string")), F.lit("en-US"), 1 + (F.col("queue_index") % 5 - 2) * 0.125)
    return q.select("document_id", "id", made.alias("ssml"))


@query
def n_uploads(spark, d):
    e = A.table(spark, d, "events")
    n = F.col("event_id")
    size = (F.col("value") * 1048576).cast("long")
    name = F.concat(F.lit("..\\dir/."), "event_type", F.lit(" é"), n.cast("string"), F.when(n % 3 == 0, "?.pdf").otherwise(".pdf"))
    return e.select(
        "event_id", text.upload_error(size, F.lit(40 * 1048576)).alias("refusal"), text.safe_filename(name).alias("file"), text.upload_bytes(n % 7).alias("bytes"),
        F.array_join(text.origins(F.concat(F.lit(" a,, "), "event_type", F.lit(" ,b"))), "|").alias("origins"), text.logs_content(n % 2 == 0, F.when(n % 4 == 0, "Production").otherwise("dev")).alias("logs"),
        text.timing_label(F.element_at(F.array(*map(F.lit, ("provider-exact", "browser-boundary", "estimated", "none"))), (n % 4 + 1).cast("int"))).alias("timing"),
    )


@query
def n_fingerprints(spark, d):
    q = A.conv_queue(spark, d)
    mark = hashing.fingerprint(F.col("text").cast("binary"), F.col("id"))
    return q.select("document_id", "id", mark.alias("fingerprint")).withColumn("file_id", hashing.document_id(F.col("fingerprint")))


def _paper(texts: list[str], numbers: list[int]) -> bytes:
    """A file of a page for each text: its first thirty words in rows of five."""
    return fixtures.build([{"runs": [fixtures.run(54 + 90 * (k % 5), 700 - 14 * (k // 5), w, 10 + n % 3) for k, w in enumerate(t.split(" ")[:30]) if w], "rects": [(100.0, 100.0, 50.0 + n, 60.0)]} for t, n in zip(texts, numbers)])


def _papers(spark, d):
    """PDF files made from the plain characters of conversations, one a conversation, a page a turn."""
    q = A.conv_queue(spark, d).withColumn("plain", F.regexp_replace("text", "[^A-Za-z0-9 .,]+", ""))
    by = q.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("queue_index", "plain"))).alias("t")).select("document_id", F.col("t.plain").alias("texts"), F.col("t.queue_index").alias("numbers"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"document_id": f["document_id"], "content": [_paper(list(t), [int(x) for x in n]) for t, n in zip(f["texts"], f["numbers"])]})

    return by.mapInPandas(run, "document_id string, content binary")


def _read(spark, d):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [pdf.parse(bytes(c)) for c in f["content"]]
            yield pd.DataFrame({"document_id": f["document_id"], "error": [e for e, _ in got], "pages": [p for _, p in got]})

    return _papers(spark, d).mapInPandas(run, pdf.PARSED.replace("path string", "document_id string"))


@query
def s_pdf_items(spark, d):
    """Text items of PDF files, written and read back."""
    items = layout.raw_items(pdf.source_items(_read(spark, d)))
    return items.select("document_id", "page_number", "source_index", "text", _r("x"), _r("y"), _r("font_size"), "direction")


@query
def s_pdf_pages(spark, d):
    read = _read(spark, d)
    ops = pdf.draw_ops(read).groupBy("document_id", "page_number").agg(F.count("*").alias("n_ops"), F.max(F.col("args")[2]).alias("right"))
    return pdf.page_dims(read).join(ops, ["document_id", "page_number"], "left").select("document_id", "page_number", "width", "height", "rotation", "n_ops", "right")


@query
def s_pdf_errors(spark, d):
    """Files cut off, emptied or mistaken for others: what the signature says and what the reader says."""
    n = F.abs(F.hash("document_id")) % 1  # every file in each of four states
    states = _papers(spark, d).select("document_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("state"), "content", n.alias("zero"))
    c = F.col("content")
    broken = F.when(F.col("state") == 1, F.lit(b"")).when(F.col("state") == 2, F.lit(b"plain text, no file of this kind")).when(F.col("state") == 3, F.substring(c, 1, 40)).otherwise(c)
    files = states.select("document_id", "state", broken.alias("content"))
    return files.select("document_id", "state", pdf.is_pdf(F.col("content")).alias("is_pdf"), pdf.signature_error(F.col("content")).alias("refusal"))


# --- sentences


def _halves(spark, d):
    """Each turn as a paragraph of two sentences of half its length."""
    q = A.conv_queue(spark, d).select("document_id", "id", F.col("text").alias("whole"), F.length("text").alias("n"))
    each = q.withColumn("sentence_index", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    start, end = F.when(F.col("sentence_index") == 0, 0).otherwise(F.col("half")), F.when(F.col("sentence_index") == 0, F.col("half")).otherwise(F.col("n"))
    return each.withColumns({"start": start, "end": end}).withColumn("text", F.expr("substring(whole, start + 1, end - start)")).select("document_id", "id", "sentence_index", "text", "start", "end")


@query
def t_marker_spans(spark, d):
    sents = _halves(spark, d)
    at = A.conv_queue(spark, d).select("document_id", "id", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(7))).alias("p"))
    spans = at.select("document_id", "id", F.col("p").cast("string").alias("item_id"), (F.col("p") - 2).alias("span_start"), (F.col("p") + 3).alias("span_end"), (F.col("p") % 4 == 1).alias("raised"))
    keys = ["document_id", "id"]
    got = sentences.marker_spans(sentences.overlapping_items(sents, spans, keys), keys)
    said = F.array_join(F.transform("marker_spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return got.select(*keys, "sentence_index", said.alias("spans"))


@query
def t_transformations(spark, d):
    sents = _halves(spark, d)
    log = A.conv_queue(spark, d).select("document_id", "id", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(5))).alias("offset"), F.lit("k").alias("kind"))
    return sentences.sentence_transformations(sents, log, ["document_id", "id"]).select("document_id", "id", "sentence_index", "offset")


# --- overrides and review


@query
def m_overrides(spark, d):
    """Overrides after changes, and after everything that is left out is restored."""
    r = A.html_regions(spark, d)
    own = _overrides(r)
    changes = r.where("reading_order % 3 < 2").select("document_id", "id", F.when(F.col("reading_order") % 3 == 0, "include").alias("override"))
    after = inclusion.set_overrides(own, changes)
    restored = inclusion.restore_all(after, inclusion.apply_mode(r, "clean"))
    return after.withColumn("step", F.lit("changed")).unionByName(restored.withColumn("step", F.lit("restored")))


@query
def m_review_tabs(spark, d):
    applied = inclusion.apply_mode(A.html_regions(spark, d), "clean")
    parts = [inclusion.review_tab(applied, tab).select(F.lit(tab).alias("tab"), "document_id", "id") for tab in ("excluded", "uncertain", "included", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- recognition


@query
def o_corrections(spark, d):
    """Corrections that were made, taken back or left blank: the last one of each word counts."""
    w = A.ocr_words(spark, d).where("confidence < 0.4")
    k = F.col("word_index") % 3
    row = lambda at, said: F.struct(F.lit(at).cast("long").alias("corrected_at"), said.alias("corrected"))
    steps = F.when(k == 0, F.array(row(1, F.concat("text", F.lit("+"))), row(2, F.lit(" ")))).when(k == 1, F.array(row(1, F.concat("text", F.lit("+"))), row(3, F.col("text")))).otherwise(F.array(row(2, F.concat("text", F.lit("+"))), row(1, F.lit("x"))))
    each = w.withColumn("s", F.explode(steps)).select("document_id", "page_number", "word_index", F.col("text").alias("original"), "s.corrected", "s.corrected_at")
    return ocr.last_corrections(each).select("document_id", "word_index", "original", "corrected")


@query
def o_remaining(spark, d):
    w = A.ocr_words(spark, d)
    return ocr.remaining_low(w, A.ocr_corrections(w)).select("document_id", "page_number", "word_index")


@query
def o_gate(spark, d):
    e = A.table(spark, d, "events")
    asked = e.select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 4 == 1).alias("consent"), (F.col("value").cast("long") * (F.col("event_id") % 3)).alias("size"))
    return ocr.gate(asked, 60).select("event_id", "error_code", "error_cause")


@query
def o_flatten(spark, d):
    """Words of a recogniser's nested answers, built from the words of conversations."""
    q = A.conv_queue(spark, d)
    words = F.split("text", " ")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(y).alias("y"))
    word = F.transform(words, lambda w, k: F.struct((k % 10 / 10.0).alias("confidence"), F.array(F.struct(F.substring(w, 1, 1).alias("text")), F.struct(F.substring(w, 2, 1000).alias("text"))).alias("symbols"), F.struct(F.array(corner(k * 10, 5.0), corner(k * 10 + 8, 17.0)).alias("vertices")).alias("boundingBox")))
    tree = F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.when(F.col("queue_index") % 2 == 0, "en").otherwise("").alias("languageCode"))).alias("detectedLanguages")).alias("property"), F.array(F.struct(F.array(F.struct(word.alias("words"))).alias("paragraphs"))).alias("blocks"))).alias("pages"))
    answers = q.select("document_id", F.col("queue_index").alias("page_number"), F.to_json(tree).alias("annotation"))
    said = ocr.dominant_language(answers)
    return ocr.flatten_annotation(answers).join(said, ["document_id", "page_number"]).select("document_id", "page_number", "word_index", "text", "confidence", "x", "y", "width", "height", "language")


# --- timing


@query
def tm_word_timings(spark, d):
    """Times of the words of each sentence, counted from its first word."""
    chunks = _chunks(spark, d)
    each = chunks.select("document_id", "chunk_index", F.explode(text.words(F.col("text"))).alias("w")).select("document_id", "chunk_index", "w.start", "w.end", (F.col("w.start") / 14.5).alias("audio_start"), (F.col("w.end") / 14.5).alias("audio_end"))
    got = timing.word_timings_of(chunks, each)
    return got.select("document_id", "chunk_index", "sentence_id", "start", "end", _r("audio_start"), _r("audio_end"))


@query
def tm_alignment(spark, d):
    """Character times folded to words; every fifth alignment does not spell its text."""
    q = A.conv_queue(spark, d).withColumn("said", F.when(F.col("queue_index") % 5 == 4, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).where("text <> ''")
    at = F.sequence(F.lit(1), F.length("said"))
    found = timing.align_words(F.col("text"), F.transform(at, lambda i: F.substring("said", i, F.lit(1))), F.transform(at, lambda i: (i - 1) * F.lit(0.5)), F.transform(at, lambda i: i * F.lit(0.5)))
    return q.select("document_id", "id", found.alias("w")).select("document_id", "id", F.size("w").alias("n"), F.get("w", F.lit(0))["audio_start"].alias("first"), F.get("w", F.size("w") - 1)["audio_end"].alias("last"))


@query
def tm_predicates(spark, d):
    q = A.conv_queue(spark, d)
    states = F.array(*map(F.lit, ("idle", "preparing", "playing", "buffering", "seeking", "paused")))
    s = F.element_at(states, F.col("queue_index") % 6 + 1)
    source = F.element_at(F.array(*map(F.lit, ("estimated", "none", "provider-exact"))), F.col("queue_index") % 3 + 1)
    return q.select("document_id", "id", timing.is_busy(s).alias("busy"), timing.is_playing(s).alias("playing"), timing.is_estimated(source).alias("estimated"), timing.boundary_word(F.col("text"), F.col("queue_index") * 9).alias("word"))


# --- voices and requests


@query
def v_report(spark, d):
    return voices.voice_lines(_voices(spark, d), "v7")


@query
def v_catalogue(spark, d):
    """Server voices before those of the browser; a session without a server has just the latter."""
    own = _voices(spark, d).where("list_index % 50 = 0").withColumn("list_index", F.col("list_index").cast("long"))
    server = own.select("session").distinct().where("cast(session as long) % 2 = 0").select("session", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    server = server.select("session", F.concat(F.lit("s"), F.col("k").cast("string")).alias("id"), F.lit("Server").alias("name"), F.lit("en-US").alias("language"), F.lit("mock").alias("provider"), F.lit(True).alias("neural"), F.lit(False).alias("system_default"), F.lit(False).alias("on_device"), F.col("k").cast("long").alias("list_index"))
    return voices.catalogue(server, own).select("session", "id", "source", "list_index")


@query
def v_envelopes(spark, d):
    e = A.table(spark, d, "events")
    n = F.col("event_id")
    body = F.when(n % 4 == 0, "not json").when(n % 4 == 1, F.concat(F.lit('{"code":"rate_limited","message":"m'), n.cast("string"), F.lit('","retryable":true,"retryAfterSeconds":'), (n % 9).cast("string"), F.lit("}"))).when(n % 4 == 2, '{"code":"","message":"x"}').otherwise('{"code":"invalid_voice","message":"v","recovery":"Choose"}')
    return voices.error_envelopes(e.select("event_id", body.alias("body"))).select("event_id", "code", "message", "recovery", "retryable", "retry_after_seconds")


@query
def v_speech_requests(spark, d):
    e = A.table(spark, d, "events")
    n = F.col("event_id")
    body = F.to_json(F.struct(F.when(n % 3 > 0, "hello").alias("text"), F.when(n % 5 > 0, "v").otherwise("").alias("voiceId"), F.when(n % 2 == 0, F.col("value") / 20).alias("speed"), F.lit("c").alias("chunkId"), F.when(n % 7 > 0, "k").alias("cacheKey"), F.when(n % 4 == 0, "ogg").when(n % 4 == 1, "wav").alias("format")))
    got = voices.parse_speech_requests(e.select("event_id", body.alias("body")))
    return got.select("event_id", "speed", "language", "format", F.array_join("invalid_fields", ",").alias("invalid"))


@query
def v_ocr_requests(spark, d):
    e = A.table(spark, d, "events")
    n = F.col("event_id")
    body = F.to_json(F.struct(F.when(n % 3 > 0, "aGk=").alias("image"), F.when(n % 4 == 0, "image/gif").when(n % 4 == 1, "image/jpeg").alias("mimeType"), (n % 5).cast("int").alias("pageNumber"), F.when(n % 7 > 0, "doc").alias("documentId"), F.when(n % 2 == 0, True).alias("consent")))
    got = voices.parse_ocr_requests(e.select("event_id", body.alias("body")))
    return got.select("event_id", "mime_type", "consent", F.size("language_hints").alias("hints"), F.array_join("invalid_fields", ",").alias("invalid"))


@query
def v_responses(spark, d):
    q = A.conv_queue(spark, d)
    return voices.responses(q.select("document_id", "id", F.col("text").cast("binary").alias("audio"), F.lit(True).alias("timed")))


@query
def v_capabilities(spark, d):
    return voices.capabilities(spark).select("provider", "streaming", "word_timing", "speed_min", "speed_max", "max_chars")


@query
def v_diagnostics(spark, d):
    """Pages read, scanned and failed, and pieces of text, by document."""
    lines = A.doc_lines(spark, d)
    pages = lines.groupBy("document_id", "page_number").agg((F.sum(F.length("text")) < 200).alias("likely_scanned"))
    failed = pages.where("page_number % 3 = 0")
    return voices.diagnostics(pages, failed, lines.where("length(text) > 20"))


# --- players


@query
def st_held_queue(spark, d):
    """Queues that arrive while a player runs, and when each is taken up."""
    played = QUERIES["st_playback"](spark, d).select("session", "seq", "state")
    return state.held_queues(played.withColumn("version", F.when(F.col("seq") % 11 == 0, F.col("seq"))))


@query
def st_continue(spark, d):
    remapped, following = _remapped(spark, d)
    return state.continue_after(remapped, following).select("document_id", "sentence_id", "next_id")


@query
def k_attempts(spark, d):
    e = A.table(spark, d, "events")
    return chunking.attempts(e.select(F.concat(F.col("user_id").cast("string"), F.lit("|"), "event_type").alias("chunk"), F.col("event_id").alias("seq"), (F.col("event_id") % 4 == 0).alias("ok")))


@query
def k_prefetch(spark, d):
    made = chunking.chunks(A.conv_queue(spark, d), most=600)
    return chunking.prefetch(made.where("chunk_index % 2 = 0").select("document_id", F.col("chunk_index").alias("at")), made)


# --- stores


@query
def s_latest(spark, d):
    """The last event of each user and type, as an append-only store has it."""
    e = A.table(spark, d, "events")
    rows = e.select(F.concat(F.col("user_id").cast("string"), F.lit("|"), "event_type").alias("key"), "value", "event_id", (F.col("event_id") * 37 % 1009).alias("at"))
    got = stores.latest(rows.withColumn("at", F.struct("at", "event_id")), "key", "at")
    return got.select("key", "value", "event_id")


@query
def s_usage(spark, d):
    """Bytes and entries held, and the ten documents opened last."""
    q = A.conv_queue(spark, d)
    used = stores.usage(q, "text").select(F.lit("used").alias("what"), F.col("used_bytes").alias("n"), "entries")
    opened = q.groupBy(F.col("document_id").alias("fingerprint")).agg(F.max(F.length("text")).alias("last_opened_at"))
    last = stores.recent(opened).select(F.concat(F.lit("recent "), "fingerprint").alias("what"), F.col("last_opened_at").cast("long").alias("n"), F.lit(1).cast("long").alias("entries"))
    return used.unionByName(last)


@query
def st_expired(spark, d):
    r = A.requests(spark, d)
    return state.expired(r.withColumn("modified_seconds", F.col("seq") * 60.0), 300000.0, 86400.0).select("client", "seq")


@query
def g_sentence_boxes(spark, d):
    """Boxes of the first forty items of each document, taken as its sentences of eight."""
    _, items = A.boxes(spark, d)
    placed = items.where("source_index < 40").select("document_id", F.floor(F.col("source_index") / 8).cast("int").alias("sentence_index"), "x", (F.col("y") + F.col("source_index") % 3 * 0.1).alias("y"), "width", "height", "font_size")
    got = layout.sentence_boxes(placed, ["document_id", "sentence_index"])
    each = got.select("document_id", "sentence_index", F.posexplode("bounding_boxes").alias("nth", "b"))
    return each.select("document_id", "sentence_index", "nth", F.round("b.x", 6).alias("x"), F.round("b.y", 6).alias("y"), F.round("b.width", 6).alias("width"), F.round("b.height", 6).alias("height"))
