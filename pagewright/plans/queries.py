"""Named queries: each applies library operators to the given tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing, speech, text
from ..operators import chunking, classify, inclusion, layout, ocr, reading, sentences, state, timing, voices
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _r(c: str):
    return F.round(c, 6).alias(c)


# --- strings


@query
def n_normalize(spark, d):
    return A.doc_lines(spark, d).select("document_id", "line_no", text.normalize(F.col("text")).alias("text"))


@query
def n_wrap_join(spark, d):
    return sentences.region_texts(A.doc_lines(spark, d), ["document_id"], "line_no")


@query
def n_hyphen_joints(spark, d):
    parts = sentences.join_wrapped(A.doc_lines(spark, d), ["document_id"], "line_no")
    return parts.where("joint is not null").groupBy("document_id", "joint").agg(F.count("*").alias("n"), F.max("base").cast("long").alias("last_base"))


@query
def n_signature(spark, d):
    return A.doc_lines(spark, d).select("document_id", "line_no", text.repetition_signature(F.col("text")).alias("signature"))


@query
def n_line_tests(spark, d):
    t = F.col("text")
    return A.doc_lines(spark, d).select(
        "document_id", "line_no", text.page_number_form(t).alias("page_form"), text.reference_heading(t)["type"].alias("reference_type"), F.round(text.entry_score(t), 6).alias("entry_score"),
        text.is_front_matter_heading(t).alias("front_matter"), text.is_caption(t).alias("caption"), text.is_list_item(t).alias("list_item"), text.ends_sentence(t).alias("ends_sentence"),
    )


@query
def n_words(spark, d):
    each = A.doc_lines(spark, d).select("document_id", "line_no", F.posexplode(text.words(F.col("text"))).alias("word_no", "w"))
    return each.select("document_id", "line_no", "word_no", "w.text", "w.start", "w.end")


@query
def n_hash_keys(spark, d):
    t = F.col("text")
    key = hashing.cache_key(t, F.lit("mock"), F.lit("mock-en-1"), F.lit(1.25), F.lit("en-US"))
    return A.doc_lines(spark, d).select("document_id", "line_no", hashing.hash64(t).alias("text_hash"), text.composite_key(F.col("document_id"), F.col("line_no")).alias("composite"), key.alias("cache_key"))


@query
def n_scalars(spark, d):
    e = A.table(spark, d, "events")
    v = F.col("value")
    return e.select(
        "event_id", text.format_time(v).alias("clock"), F.round(text.clamp_speed(v / 20), 6).alias("speed"), text.marker_label(F.when(F.col("event_id") % 2 == 0, "figure").otherwise("drawn-area"), F.col("event_id")).alias("label"),
        text.marker_speech(F.when(F.col("event_id") % 2 == 0, "figure").otherwise("drawn-area"), F.col("event_id")).alias("speech"), text.redact(F.concat(F.lit("Api_Key: "), F.col("event_type"), F.lit(" sk-0123456789abcdefgh end"))).alias("redacted"),
        text.client_key(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(" , x"))), F.when(F.col("event_id") % 3 == 1, "peer")).alias("client"),
        F.round(timing.remaining_seconds(v, F.lit(1.5)), 6).alias("remaining"), text.provider_name(F.concat(F.lit(" "), F.upper("event_type"))).alias("provider"),
    )


@query
def n_titles(spark, d):
    r = A.html_regions(spark, d)
    return r.select("document_id", "reading_order", text.short_title(F.col("text")).alias("title"), text.match_key(F.col("text")).alias("match_key"), text.escape_xml(F.col("text")).alias("escaped"))


# --- sentences


def _doc_texts(spark, d):
    return sentences.region_texts(A.doc_lines(spark, d), ["document_id"], "line_no")


@query
def t_sentences(spark, d):
    return sentences.sentences(_doc_texts(spark, d), ["document_id"]).select("document_id", "sentence_index", "text", "start", "end")


@query
def t_lossless(spark, d):
    whole = sentences.assert_lossless(_doc_texts(spark, d))
    return whole.select("document_id", F.length("text").alias("n"), "n_sentences")


@query
def t_paragraph_offsets(spark, d):
    return sentences.document_offsets(A.html_regions(spark, d), "reading_order").select("document_id", "id", "paragraph_offset")


@query
def t_outline(spark, d):
    return sentences.outline(A.html_regions(spark, d)).select("document_id", "id", "title", "page_number", "level", "region_id")


@query
def t_inclusion(spark, d):
    r = A.html_regions(spark, d)
    applied = inclusion.apply_mode(r, "clean")
    sents = r.select("document_id", F.concat("id", F.lit(":s0")).alias("id"), F.when(F.col("reading_order") % 7 == 6, F.lit("none")).otherwise(F.col("id")).alias("region_id"))
    return sentences.apply_inclusion(sents, applied).select("document_id", "id", "inclusion_status")


@query
def t_document_index(spark, d):
    return sentences.document_index(A.html_regions(spark, d), ["page_number", "reading_order"]).select("document_id", "id", "document_index")


# --- classification


def _corpus_pages(blocks):
    return blocks.select("document_id", "page_number").distinct().groupBy("document_id").agg(F.count("*").alias("n_pages"))


@query
def c_repeated_groups(spark, d):
    blocks = A.line_blocks(spark, d)
    got = classify.repeated_groups(classify.repeated_candidates(blocks), _corpus_pages(blocks))
    return got.select("band", "signature", "on_pages", "n", _r("spread"), _r("mean_edge"), _r("confidence"))


@query
def c_repeated(spark, d):
    blocks = A.line_blocks(spark, d)
    return classify.repeated(blocks, _corpus_pages(blocks)).select("id", "type", _r("confidence"))


@query
def c_page_numbers(spark, d):
    return classify.page_numbers(A.marked_blocks(spark, d)).select("document_id", "id", _r("confidence"))


def _sizes(blocks):
    return blocks.select("document_id").distinct().withColumn("body_size", F.lit(11.0))


@query
def c_references(spark, d):
    blocks = A.marked_blocks(spark, d)
    return classify.references(blocks, _sizes(blocks)).select("document_id", "id", "type", _r("confidence"))


@query
def c_density_runs(spark, d):
    """Runs of entries where nothing is claimed beforehand."""
    blocks = A.marked_blocks(spark, d)
    return classify.density_runs(blocks, blocks.where("false")).select("document_id", "id", _r("confidence"), F.size("evidence").alias("n_evidence"))


@query
def c_watermarks(spark, d):
    blocks = A.watermark_blocks(spark, d)
    return classify.watermarks(blocks, _sizes(blocks), _corpus_pages(blocks)).select("document_id", "id", _r("confidence"), F.size("evidence").alias("n_evidence"))


@query
def c_front_matter(spark, d):
    return classify.front_matter(A.marked_blocks(spark, d)).select("document_id", "id", "reason")


@query
def c_arbitrate(spark, d):
    blocks = A.marked_blocks(spark, d)
    found = [classify.repeated(blocks, _corpus_pages(blocks)), classify.page_numbers(blocks), classify.references(blocks, _sizes(blocks))]
    won = classify.arbitrate(blocks, found, classify.front_matter(blocks))
    return won.select("document_id", "id", "type", _r("confidence"), F.size("classification_evidence").alias("n_evidence"))


# --- inclusion


def _overrides(regions):
    """Headings are left out, page footers kept."""
    return regions.where("confidence = 0.9").select("document_id", "id", F.when(F.col("type") == "footer", "include").otherwise("exclude").alias("override"))


def _mode(mode: str) -> Callable:
    def run(spark, d):
        r = A.html_regions(spark, d)
        return inclusion.apply_mode(r, mode, None, _overrides(r)).select("document_id", "id", "included", "inclusion_reason", "uncertain")

    run.__name__ = {"clean": "m_clean", "custom": "m_custom", "strict-verbatim": "m_strict"}[mode]
    return query(run)


for _m in ("clean", "custom", "strict-verbatim"):
    _mode(_m)


@query
def m_exclusion_summary(spark, d):
    return inclusion.exclusion_summary(inclusion.apply_mode(A.html_regions(spark, d), "clean"))


@query
def m_exclusions_by_type(spark, d):
    return inclusion.exclusion_rollup(inclusion.apply_mode(A.html_regions(spark, d), "clean"))


@query
def m_uncertain(spark, d):
    r = A.html_regions(spark, d)
    return inclusion.uncertain_regions(inclusion.apply_mode(r, "clean", None, _overrides(r))).select("document_id", "id", "type")


# --- reading


@query
def q_projection_simple(spark, d):
    return A.doc_lines(spark, d).select("document_id", "line_no", speech.simple_projection(F.col("text")).alias("speech_text"))


@query
def q_projection_full(spark, d):
    p = speech.projection(F.col("text"), None, {"read_parenthetical": False})
    out = A.doc_lines(spark, d).withColumn("p", p)
    return out.select("document_id", "line_no", F.col("p.text").alias("speech_text"), F.size("p.skipped").alias("n_skipped"), speech.display_offset(F.col("p.anchors"), F.length("p.text")).alias("end_offset"))


@query
def q_queue(spark, d):
    r = A.html_regions(spark, d)
    sents = r.select("document_id", F.concat("id", F.lit(":s0")).alias("id"), F.col("id").alias("region_id"), F.concat("id", F.lit(":para0")).alias("paragraph_id"), "page_number", "text", F.col("reading_order").alias("document_index"))
    q = reading.reading_queue(inclusion.apply_mode(r, "clean"), sents)
    return q.select("document_id", "id", "queue_index", "speech_text", "region_type")


@query
def q_reader_paragraphs(spark, d):
    r = A.html_regions(spark, d)
    sents = r.select("document_id", F.concat("id", F.lit(":s0")).alias("id"), F.col("id").alias("region_id"), F.concat("id", F.lit(":para0")).alias("paragraph_id"), "page_number", "text", F.col("reading_order").alias("document_index"))
    applied = inclusion.apply_mode(r, "clean")
    got = reading.reader_paragraphs(applied, sents, reading.reading_queue(applied, sents))
    first = F.get("sentences", F.lit(0))
    return got.select("document_id", "paragraph_id", "region_type", "page_number", "included", "uncertain", F.size("sentences").alias("n_sentences"), first["spoken"].alias("spoken"), F.size(first["skipped"]).alias("n_skipped"))


@query
def q_segments(spark, d):
    """Displayed text cut into what is spoken and what is struck out."""
    p = A.doc_lines(spark, d).withColumn("p", speech.projection(F.col("text"), None, {"read_parenthetical": False}))
    each = p.select("document_id", "line_no", F.posexplode(speech.segments(F.col("text"), F.col("p.skipped"))).alias("segment", "s"))
    return each.select("document_id", "line_no", "segment", "s.text", "s.skipped", "s.start")


@query
def q_announcements(spark, d):
    """A queue in which each figure of a page is announced before the first entry of its paragraph."""
    q = A.conv_queue(spark, d)
    none = F.array().cast("array<struct<start:int,end:int,text:string,reason:string>>")
    q = q.withColumns({"skipped": none, "anchors": F.array().cast("array<struct<spoken:int,display:int>>")}).drop("queue_index")
    at = q.groupBy("document_id", "paragraph_id").agg(F.min("page_number").alias("page_number")).where("page_number % 2 = 1")
    kind = F.when(F.col("page_number") % 4 == 1, "figure").otherwise("drawn-area")
    placed = at.select("document_id", "paragraph_id", kind.alias("kind"), "page_number", F.lit(0).alias("marker_index"), F.concat(F.lit("marker:"), "paragraph_id").alias("id"))
    return reading.announcements(q, placed).select("document_id", "id", "queue_index", "page_number", "speech_text", "announcement")


def _footnotes(mode: str) -> None:
    def run(spark, d):
        return reading.order_footnotes(A.conv_queue(spark, d), mode).select("document_id", "id", "queue_index")

    run.__name__ = f"q_footnotes_{mode.replace('-', '_')}"
    query(run)


for _m in ("skip", "after-page", "after-section"):
    _footnotes(_m)


@query
def q_search(spark, d):
    found = reading.search(A.conv_queue(spark, d), " The ", 3)
    return found.select("document_id", "id", "document_index")


@query
def q_remaining_chars(spark, d):
    return reading.remaining_characters(A.conv_queue(spark, d)).select("document_id", "id", "remaining_characters")


@query
def q_section_asof(spark, d):
    r = A.html_regions(spark, d)
    return reading.sections(sentences.outline(r), r.select("document_id", "page_number").distinct())


@query
def q_drawn_areas(spark, d):
    rects, items = A.boxes(spark, d)
    return reading.drawn_areas(rects, items)


@query
def q_place_markers(spark, d):
    rects, items = A.boxes(spark, d)
    paras = items.select("document_id", "page_number", F.concat("document_id", F.lit(":para"), F.col("source_index").cast("string")).alias("paragraph_id"), F.col("source_index").alias("order"), (F.col("y") + F.col("height")).alias("top"))
    placed = reading.place_markers(rects.where("kind = 'figure'"), rects.where("kind = 'drawing'"), paras)
    return placed.select("document_id", "paragraph_id", "kind", "id")


# --- chunks


@query
def k_chunks(spark, d):
    made = chunking.chunks(A.conv_queue(spark, d), most=600)
    return made.select("document_id", "chunk_index", "text", F.size("sentence_ids").alias("n_sentences"), "continues_mid_word")


@query
def k_lossless(spark, d):
    q = A.conv_queue(spark, d)
    return chunking.lossless(q, chunking.chunks(q, most=600))


@query
def k_chunk_lookup(spark, d):
    return chunking.chunk_of_sentence(chunking.chunks(A.conv_queue(spark, d), most=2500))


@query
def k_cache_misses(spark, d):
    q = A.conv_queue(spark, d).withColumn("cache_key", F.md5("speech_text"))
    return chunking.cache_misses(q.where("region_type = 'footnote'"), q.where("region_type <> 'footnote'").select("cache_key").distinct()).select("document_id", "id", "cache_key")


@query
def k_lru_ttl(spark, d):
    r = A.requests(spark, d).withColumnRenamed("client", "cache")
    return chunking.replay_cache(r, most=3, ttl=86400.0)


@query
def k_retained_audio(spark, d):
    r = A.requests(spark, d).select(F.col("client").alias("session"), F.col("now_seconds").alias("created"), F.col("seq").alias("chunk_index"))
    return chunking.retained(r).select("session", "chunk_index", "kept")


# --- timing


def _chunks(spark, d):
    """Each page of a conversation as a chunk: offsets by running lengths."""
    q = A.conv_queue(spark, d)
    w = Window.partitionBy("document_id", "page_number").orderBy("queue_index")
    at = F.coalesce(F.sum(F.length("speech_text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    s = F.struct("queue_index", F.struct(F.col("id").alias("sentence_id"), F.col("at").alias("start"), (F.col("at") + F.length("speech_text")).alias("end")).alias("s"), F.col("speech_text").alias("t"))
    by = q.withColumn("at", at).groupBy("document_id", F.col("page_number").alias("chunk_index")).agg(F.array_sort(F.collect_list(s)).alias("all"))
    out = by.select("document_id", "chunk_index", F.array_join(F.transform("all", lambda x: x["t"]), " ").alias("text"), F.transform("all", lambda x: x["s"]).alias("sentence_offsets"))
    return out.withColumn("duration_seconds", F.length("text") / 14.5)


@query
def tm_sentence_estimate(spark, d):
    got = timing.sentence_timings(_chunks(spark, d))
    return got.select("document_id", "chunk_index", "sentence_id", _r("audio_start"), _r("audio_end"))


@query
def tm_sentence_at_time(spark, d):
    at = _chunks(spark, d).withColumn("audio_time", F.col("duration_seconds") * (F.col("chunk_index") % 4) / 4 + 0.001)
    return timing.sentence_at(at).select("document_id", "chunk_index", "sentence_id")


@query
def tm_word_progress(spark, d):
    q = A.conv_queue(spark, d)
    length = F.length("text") / 14.5
    p = timing.word_progress(F.col("text"), length * (F.col("queue_index") % 5) / 5 + 0.001, length, F.lit("estimated"))
    return q.select("document_id", "id", p["word_index"].alias("word_index"))


@query
def tm_pauses(spark, d):
    return timing.pauses(A.conv_queue(spark, d), 1.5).select("document_id", "id", "pause_ms")


@query
def tm_mock_duration(spark, d):
    q = A.conv_queue(spark, d)
    times = timing.mock_timings(F.col("text"), F.lit(1.25))
    return q.select("document_id", "id", F.round(timing.mock_duration(F.col("text"), F.lit(1.25)), 6).alias("seconds"), F.size(times).alias("n_words"), F.round(F.element_at(times, -1)["audio_end"], 6).alias("last_end"))


# --- recognition


@query
def o_low_confidence(spark, d):
    got = ocr.low_confidence(A.ocr_words(spark, d))
    return got.select("document_id", "page_number", F.size("low_confidence_word_indexes").alias("n"), F.array_join(F.transform("low_confidence_word_indexes", lambda x: x.cast("string")), ",").alias("indexes"))


@query
def o_effective_words(spark, d):
    w = A.ocr_words(spark, d)
    return ocr.effective_words(w, A.ocr_corrections(w)).select("document_id", "page_number", "word_index", "text")


@query
def o_to_items(spark, d):
    w = A.ocr_words(spark, d)
    items = layout.raw_items(ocr.to_items(w, A.ocr_pages(w)))
    return items.select("document_id", "page_number", "source_index", "text", "x", "y", "width", "height", "font_size")


@query
def o_summary(spark, d):
    w = A.ocr_words(spark, d)
    return ocr.page_summary(w, A.ocr_corrections(w), A.ocr_pages(w)).select("document_id", "page_number", "words", "low_confidence", "corrected", "empty", F.round(F.col("confidence") + 1e-9, 6).alias("confidence"))


@query
def o_splice(spark, d):
    w = A.ocr_words(spark, d)
    done = ocr.accepted(A.ocr_pages(w), w)
    base = A.doc_lines(spark, d).select("document_id", "page_number", F.col("line_no").alias("document_index"), F.lit("layer").alias("origin"), "text")
    read = w.groupBy("document_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_index", "text"))), lambda x: x["text"]), " ").alias("text")).select("document_id", "page_number", F.lit(0).alias("document_index"), F.lit("recognised").alias("origin"), "text")
    return ocr.renumber(ocr.splice(base, read, done)).select("document_id", "page_number", "document_index", "origin", "text")


# --- voices


def _voices(spark, d):
    e = A.table(spark, d, "events")
    n = F.col("event_id")
    name = F.when(n % 11 == 0, "Zarvox").when(n % 5 == 0, "Zoe (Premium)").otherwise(F.concat(F.lit("Voice "), n.cast("string")))
    lang = F.when(n % 4 == 0, "en-GB").when(n % 4 == 1, "en-US").when(n % 4 == 2, "fr-FR").otherwise("de-DE")
    v = voices.browser_voices(e.select(F.col("user_id").cast("string").alias("session"), n.alias("list_index"), F.concat(F.lit("v"), n.cast("string")).alias("uri"), name.alias("name"), lang.alias("lang"), (n % 9 == 0).alias("is_default"), (n % 2 == 0).alias("local")))
    return v


@query
def v_default_voice(spark, d):
    v = _voices(spark, d)
    u = F.col("session").cast("long")
    wish = v.select("session").distinct().select("session", F.when(u % 5 == 0, F.concat(F.lit("v"), u.cast("string"))).alias("saved_voice_id"), F.lit("v7").alias("server_default_voice_id"), (u % 3 == 0).alias("server_configured"), F.when(u % 2 == 0, "en-GB").otherwise("fr").alias("preferred_language"))
    return voices.default_voice(v, wish)


@query
def v_groups(spark, d):
    return voices.voice_groups(_voices(spark, d), "en-US").groupBy("session", "group").agg(F.count("*").alias("n"))


@query
def v_failure_report(spark, d):
    e = A.table(spark, d, "events")
    failed = e.select(F.col("user_id").cast("string").alias("document_id"), F.col("event_id").cast("int").alias("page_number"), F.col("event_type").alias("reason"))
    return voices.failures_by_reason(failed).select("document_id", "reason", "pages", "n")


@query
def v_http_errors(spark, d):
    e = A.table(spark, d, "events")
    status = F.element_at(F.array(*map(F.lit, (200, 400, 401, 403, 404, 429, 429, 500, 503))), (F.col("event_id") % 9 + 1).cast("int"))
    body = F.when(F.col("event_id") % 2 == 0, "Quota used up").otherwise("slow down")
    known = voices.errors(spark)
    out = e.select("event_id", voices.http_error(status, body).alias("code"), voices.retry_after(status, F.lit("x")).alias("retry_after"))
    return out.join(F.broadcast(known), "code", "left").select("event_id", "code", F.col("status").alias("answer_status"), "retry_after")


@query
def v_guard(spark, d):
    q = A.conv_queue(spark, d)
    provider = F.element_at(F.array(*map(F.lit, ("openai", "azure", "mock", "other"))), (F.col("queue_index") % 4 + 1))
    return voices.guard(q.select("document_id", "id", "text", provider.alias("provider"), (F.col("queue_index") * 0.45).alias("speed")), 1500).select("document_id", "id", "error_code")


# --- state


@query
def st_rate_limit(spark, d):
    return state.rate_limit(A.requests(spark, d).withColumn("now_seconds", F.col("now_seconds") / 3600), 2)


@query
def st_milestones(spark, d):
    pages = A.doc_lines(spark, d).select("document_id", "page_number").distinct()
    return state.provisional_pages(pages)


def _remapped(spark, d):
    """Positions in a rebuilt queue, and that queue."""
    q = A.conv_queue(spark, d).withColumn("position", F.col("queue_index"))
    previous = q.select("document_id", F.concat(F.lit("old:"), "id").alias("id"), "page_number", "text", "document_index")
    following = q.where("region_type <> 'footnote'").withColumn("position", F.row_number().over(Window.partitionBy("document_id").orderBy("queue_index")) - 1)
    following = following.withColumn("id", F.when(F.col("page_number") % 2 == 0, F.concat(F.lit("old:"), "id")).otherwise(F.col("id")))
    return state.remap(previous.select("document_id", F.col("id").alias("sentence_id")), previous, following), following


@query
def st_remap(spark, d):
    return _remapped(spark, d)[0]


@query
def st_playback(spark, d):
    e = A.table(spark, d, "events")
    kinds = list(state.TRANSITIONS)
    null = lambda t: F.lit(None).cast(t)
    ev = e.select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") * 7 % len(kinds) + 1).cast("int")).alias("type"), F.lit("v1").alias("voice_id"),
        F.lit("mock").alias("provider"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("sentence_id"), F.lit("p").alias("paragraph_id"), F.lit("r").alias("region_id"), (F.col("event_id") % 9).cast("int").alias("page"),
        F.col("value").alias("audio_timestamp"), (F.col("event_id") % 5).cast("int").alias("word_index"), F.lit("estimated").alias("source"), F.lit("c").alias("chunk_id"), (F.col("value") / 20).alias("speed"), (F.col("value") / 100).alias("volume"), null("string").alias("message"),
    )
    return state.replay_playback(ev).select("session", "seq", "state", "active_sentence_id", "active_page", F.round("speed", 6).alias("speed"))


# --- geometry


def _geometry_lines(spark, d):
    rows = A.doc_lines(spark, d).withColumn("line_index", F.col("line_no") % 40)
    wide = F.col("line_no") % 10 == 0
    size = F.when(F.col("line_no") % 7 == 0, 14.0).otherwise(11.0)
    return rows.select("document_id", "page_number", "line_index", "text", F.when(F.col("line_no") % 2 == 0, 54.0).otherwise(320.0).alias("x"), (F.lit(738.0) - 14 * F.floor(F.col("line_index") / 2)).alias("baseline"), size.alias("font_size"), F.when(wide, -1).otherwise(F.col("line_no") % 2).alias("column_index"), wide.alias("spans_columns"), F.lit(2).alias("n_columns"), F.when(F.col("line_no") % 3 == 0, "f2").otherwise("f1").alias("font_name"))


@query
def g_body_font(spark, d):
    lines = _geometry_lines(spark, d)
    return layout.body_sizes(lines, ["document_id", "page_number"]).join(layout.body_fonts(lines), ["document_id", "page_number"], "left")


@query
def g_reading_order(spark, d):
    return layout.reading_order(_geometry_lines(spark, d)).select("document_id", "page_number", "line_index", "reading_index")


@query
def g_assign_column(spark, d):
    _, items = A.boxes(spark, d)
    band = lambda i, s, e: F.struct(F.lit(i).alias("index"), F.lit(s).alias("start"), F.lit(e).alias("end"))
    cols = items.select("document_id", "page_number").distinct().withColumn("columns", F.array(band(0, 50.0, 180.0), band(1, 180.0, 330.0)))
    return layout.column_of(items, cols).select("document_id", "source_index", "column_index")


@query
def g_scanned_pages(spark, d):
    rows = A.doc_lines(spark, d)
    pages = rows.select("document_id", "page_number").distinct().select("*", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(0).alias("rotation"))
    bands = pages.select("document_id", "page_number", F.array(F.struct(F.lit(0).alias("index"))).alias("columns"), F.lit(0.9).alias("confidence"))
    unsure = rows.where("length(text) > 500").select("document_id", "page_number", F.lit(True).alias("order_uncertain")).distinct()
    return layout.page_metrics(rows, pages, bands, unsure).select("document_id", "page_number", "text_layer_char_count", "likely_scanned", "reading_order_uncertain")


def _page_items(spark, d):
    """Words of each document as positioned items, sixty a page in five rows of twelve."""
    words = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", " ")).alias("source_index", "text"))
    k = F.col("source_index") % 60
    return words.select(
        "document_id", F.floor(F.col("source_index") / 60 + 1).cast("int").alias("page_number"), "source_index", "text", F.array(*map(F.lit, layout.IDENTITY)).alias("transform"), (k % 12 * 45.0 + 20).alias("x"),
        (F.lit(700.0) - F.floor(k / 12) * 25).alias("y"), F.lit(40.0).alias("width"), F.lit(10.0).alias("height"), F.lit("f1").alias("font_name"), F.lit(10.0).alias("font_size"), F.lit("ltr").alias("direction"),
        F.lit(False).alias("has_eol"), F.lit(False).alias("raised"),
    )


@query
def g_dedupe_items(spark, d):
    items = _page_items(spark, d)
    twice = items.unionByName(items.withColumns({"source_index": F.col("source_index") + 100000000, "x": F.col("x") + 0.5}))
    got = layout.remove_duplicates(twice)
    return got.groupBy("document_id", "page_number").agg(F.count_if("removed").alias("removed"), F.count_if(~F.col("removed")).alias("kept"))


@query
def g_lines(spark, d):
    items = _page_items(spark, d)
    pages = items.select("document_id", "page_number").distinct().select("*", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return layout.lines(items, pages, parts=False).select("document_id", "page_number", "line_index", "text", "x", "baseline", "font_size")


@query
def g_block_type(spark, d):
    """Blocks of each page, tables cut out."""
    lines = A.page_lines(spark, d)
    pages = lines.select("document_id", "page_number").distinct().select("*", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return layout.blocks(lines, pages).select("document_id", "page_number", "block_index", "id", "type", _r("confidence"), F.size("lines").alias("n_lines"), F.coalesce(F.size("table_rows"), F.lit(0)).alias("n_rows"), "y", "height")


@query
def g_page_geometry(spark, d):
    """Columns of words, page by page: the bands that items vote for."""
    items = _page_items(spark, d)
    pages = items.select("document_id", "page_number").distinct().select("*", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    got = layout.columns(items, pages)
    return got.select("document_id", "page_number", F.size("columns").alias("n_columns"), F.get("columns", F.lit(0))["start"].alias("start"), F.get("columns", F.lit(0))["end"].alias("end"), _r("confidence"))


@query
def g_drawn(spark, d):
    """Figures and drawn areas of synthetic drawing operators, one page a document."""
    n = F.col("doc_id")
    docs = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), n.alias("n"))
    op = lambda k, name, *args: F.struct(F.lit(k).alias("op_index"), F.lit(name).alias("op"), F.array(*(a.cast("double") for a in args)).cast("array<double>").alias("args"))
    lit, side = F.lit, (F.col("n") % 7 * 20 + 10).cast("double")
    ops = F.array(
        op(0, "save"), op(1, "transform", side * 2, lit(0), lit(0), side, lit(50), F.col("n") % 10 * 30 + 200), op(2, "paint_image"),
        op(3, "transform", lit(1), lit(0), lit(0), lit(0.5), lit(0.25), lit(0)), op(4, "paint_mask"), op(5, "restore"),
        op(6, "construct_path", lit(300), lit(100), lit(300) + side * 2, lit(100) + side), op(7, "construct_path", lit(320), lit(110), lit(320) + side * 2, lit(110) + side),
        op(8, "construct_path", lit(0), lit(0), lit(600), lit(700)), op(9, "transform", lit(0), lit(1), lit(-1), lit(0), lit(400), lit(500)), op(10, "construct_path", lit(0), lit(0), side, side * 2),
    )
    rows = docs.select("document_id", lit(1).alias("page_number"), F.explode(ops).alias("o")).select("document_id", "page_number", "o.*")
    pages = docs.select("document_id", lit(1).alias("page_number"), lit(612.0).alias("width"), lit(792.0).alias("height"))
    return layout.drawn(rows, pages).select("document_id", "page_number", "kind", "rect_index", _r("x"), _r("y"), _r("width"), _r("height"))


# --- flagship


@query
def corpus_report(spark, d):
    """One row a document: lines joined, cut into sentences, spoken form, words: the inspection report."""
    paras = _doc_texts(spark, d)
    sents = sentences.sentences(paras, ["document_id"])
    said = sents.withColumn("speech", speech.simple_projection(F.col("text")))
    return said.groupBy("document_id").agg(F.count("*").alias("sentences"), F.sum(F.length("text")).alias("characters"), F.sum(F.length("speech")).alias("spoken_characters"), F.sum(text.word_count(F.col("text"))).cast("long").alias("words"))
