"""Voices, providers, requests and their errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import matches, trim

VOICE = "id string, name string, language string, provider string, source string, gender string, neural boolean, system_default boolean, on_device boolean, list_index int"
# Joke and legacy voices that are never chosen unasked.
NOVELTY = (
    "albert|bad news|bahh|bells|boing|bubbles|cellos|deranged|fred|good news|hysterical|jester|junior|kathy|organ|pipe organ|princess|ralph|superstar|trinoids|whisper|wobble|zarvox"
).split("|")
# What each provider can do.
CAPABILITIES = [
    ("openai", False, False, False, False, 0.25, 4.0, 4096),
    ("elevenlabs", True, True, False, False, 0.5, 3.0, 2500),
    ("azure", False, False, False, True, 0.5, 2.0, 2500),
    ("mock", False, True, False, False, 0.5, 3.0, 2500),
]
CAPABILITY = "provider string, streaming boolean, word_timing boolean, sentence_timing boolean, pitch boolean, speed_min double, speed_max double, max_chars int"
# Error codes with their HTTP status and what a reader can do.
ERRORS = [
    ("provider_unavailable", 502, "Switch to your browser's built-in voice in the player, or try again shortly."),
    ("provider_timeout", 504, "Try again. If it keeps timing out, switch to your browser's built-in voice."),
    ("quota_exhausted", 429, "The speech quota for this deployment is used up. Switch to your browser's built-in voice."),
    ("rate_limited", 429, "Too many requests at once. Playback will continue automatically in a moment."),
    ("invalid_voice", 400, "Choose a different voice in the player."),
    ("invalid_request", 400, "Reload the page and try again."),
    ("unsupported_speed", 400, "Choose a speed within the range this voice supports."),
    ("text_too_long", 413, "This passage is too long for the speech provider. Reduce the chunk size in configuration."),
    ("not_configured", 503, "No server speech provider is configured. Use your browser's built-in voice."),
    ("internal_error", 500, "Something went wrong on our side. Your reading position has been kept."),
]


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPABILITIES, CAPABILITY)


def errors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERRORS, "code string, status int, recovery string")


def is_novelty(name: Column, source: Column) -> Column:
    return (F.coalesce(source, F.lit("")) != "server") & F.lower(trim(name)).isin(*NOVELTY)


def browser_voices(platform: DataFrame) -> DataFrame:
    """Voices from a platform's list (session, list_index, uri, name, lang, is_default, local)."""
    neural = matches(F.col("name"), r"(?i)\((premium|enhanced|neural)\)")
    return platform.select("session", F.col("uri").alias("id"), "name", F.col("lang").alias("language"), F.lit("browser").alias("provider"), F.lit("browser").alias("source"), neural.alias("neural"), F.col("is_default").alias("system_default"), F.col("local").alias("on_device"), "list_index")


def catalogue(server: DataFrame | None, browser: DataFrame) -> DataFrame:
    """Server voices before browser voices; without a server just the latter."""
    if server is None:
        return browser
    both = server.withColumns({"source": F.lit("server"), "_k": F.lit(0)}).unionByName(browser.withColumns({"source": F.lit("browser"), "_k": F.lit(1)}), allowMissingColumns=True)
    at = F.row_number().over(Window.partitionBy("session").orderBy("_k", "list_index")) - 1
    return both.withColumn("list_index", at).drop("_k")


def default_voice(voices: DataFrame, wishes: DataFrame) -> DataFrame:
    """session, voice_id, tier: the saved voice, else the server's default, else the best for the language.
    voices: session, list_index, ...; wishes: session, saved_voice_id, server_default_voice_id,
    server_configured, preferred_language."""
    v = voices.join(wishes, "session").withColumn("novelty", is_novelty(F.col("name"), F.col("source")))
    preferred = F.lower(F.coalesce("preferred_language", F.lit("en")))
    session = Window.partitionBy("session")
    browser, usable = F.col("source") == "browser", (F.col("source") == "browser") & ~F.col("novelty")
    v = v.withColumns({"any_usable": F.bool_or(usable).over(session), "any_browser": F.bool_or(browser).over(session)})
    v = v.withColumn("in_pool", F.when(F.col("any_usable"), usable).when(F.col("any_browser"), browser).otherwise(True))
    marked = F.col("in_pool") & F.coalesce("system_default", F.lit(False))
    v = v.withColumns({"n_default": F.count_if(marked).over(session), "n_pool": F.count_if("in_pool").over(session)})
    trusted = (F.col("n_default") > 0) & (F.col("n_default") < F.col("n_pool"))
    tag = F.lower("language")
    score = F.when(trusted & marked, 1000).otherwise(0)
    score = score + F.when(F.contains(preferred, F.lit("-")) & (tag == preferred), 200).when(F.startswith(tag, F.substring(preferred, 1, 2)), 100).otherwise(0)
    score = score + F.when(F.coalesce("neural", F.lit(False)), 10).otherwise(0) + F.when(F.coalesce("on_device", F.lit(False)), 5).otherwise(0)
    saved = F.coalesce(F.col("id") == F.nullif("saved_voice_id", F.lit("")), F.lit(False))
    server = F.coalesce(F.col("server_configured") & (F.col("id") == F.nullif("server_default_voice_id", F.lit(""))), F.lit(False))
    tier = F.when(saved, 0).when(server, 1).when(F.col("in_pool"), 2)
    best = F.row_number().over(session.orderBy("tier", F.when(F.col("tier") == 2, -F.col("score")).otherwise(0), "list_index"))
    return v.withColumns({"tier": tier, "score": score}).where("tier is not null").withColumn("n", best).where("n = 1").select("session", F.col("id").alias("voice_id"), "tier")


def voice_groups(voices: DataFrame, language: str = "en") -> DataFrame:
    """Browser voices with the label that they are offered under."""
    own = F.startswith(F.lower("language"), F.lit(language[:2].lower()))
    label = F.when(is_novelty(F.col("name"), F.col("source")), "Novelty and legacy voices").when(own, "Voices for reading").otherwise("Other languages")
    return voices.where("source = 'browser'").withColumn("group", label)


def voice_lines(voices: DataFrame, selected: str | None) -> DataFrame:
    """One line a voice for the report that a reader can send in."""
    marks = F.array_compact(F.array(F.when(F.col("system_default"), "default"), F.when(F.col("neural"), "premium/enhanced"), F.when(~F.col("on_device"), "over the network"), F.when(F.col("id") == selected, "IN USE")))
    line = F.concat(F.lit("  "), "name", F.lit(" · "), "language", F.when(F.size(marks) > 0, F.concat(F.lit(" · "), F.array_join(marks, ", "))).otherwise(""))
    return voices.select("session", "list_index", line.alias("line"))


def failures_by_reason(failed: DataFrame) -> DataFrame:
    """Failed pages (document_id, page_number, reason) grouped by reason, in order of first failure."""
    pages = F.array_join(F.transform(F.array_sort(F.collect_list("page_number")), lambda p: p.cast("string")), ", ")
    by = failed.groupBy("document_id", "reason").agg(pages.alias("pages"), F.min("page_number").alias("first_page"), F.count("*").alias("n"))
    return by.withColumn("line", F.concat(F.lit("  page "), "pages", F.lit(": "), "reason"))


def diagnostics(pages: DataFrame, failed: DataFrame, items: DataFrame) -> DataFrame:
    """Counts of the extraction report by document."""
    p = pages.groupBy("document_id").agg(F.count("*").alias("pages_read"), F.count_if("likely_scanned").alias("scanned"))
    f = failed.groupBy("document_id").agg(F.count("*").alias("failed"))
    i = items.groupBy("document_id").agg(F.count("*").alias("text_pieces"))
    out = p.join(f, "document_id", "full").join(i, "document_id", "full")
    return out.select("document_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("pages_read", "scanned", "failed", "text_pieces")))


def http_error(status: Column, body: Column) -> Column:
    """Error code of a speech provider's HTTP status, null for success."""
    quota = F.contains(F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 200)), F.lit("quota"))
    return (
        F.when(status.between(200, 299), F.lit(None).cast("string")).when(status.isin(401, 403), "not_configured")
        .when((status == 429) & quota, "quota_exhausted").when(status == 429, "rate_limited").when(status == 400, "invalid_request")
        .when(status >= 500, "provider_unavailable").otherwise("internal_error")
    )


def retry_after(status: Column, header: Column) -> Column:
    return F.when(status == 429, F.when(matches(F.coalesce(header, F.lit("")), "^[0-9]+$"), header.cast("int")).otherwise(10))


def error_envelopes(answers: DataFrame, col: str = "body") -> DataFrame:
    """Error answers parsed, with a general one where the body says nothing usable."""
    e = F.from_json(col, "struct<code:string,message:string,recovery:string,retryable:boolean,retryAfterSeconds:int>")
    empty = F.coalesce(e["code"], F.lit("")) == ""
    return answers.withColumns({
        "code": F.when(empty, "internal_error").otherwise(e["code"]), "message": F.when(empty, F.lit("The request failed.")).otherwise(e["message"]),
        "recovery": F.when(empty, F.lit(None)).otherwise(e["recovery"]), "retryable": F.coalesce(e["retryable"], F.lit(False)), "retry_after_seconds": e["retryAfterSeconds"],
    })


_TTS = "struct<text:string,voiceId:string,speed:double,language:string,chunkId:string,cacheKey:string,format:string>"


def parse_speech_requests(raw: DataFrame, col: str = "body") -> DataFrame:
    """Speech requests from JSON, defaults filled, with the names of the fields that are wrong."""
    q = F.from_json(col, _TTS)
    empty = lambda c: F.coalesce(F.length(q[c]), F.lit(0)) < 1
    speed, fmt = F.coalesce(q["speed"], F.lit(1.0)), F.coalesce(q["format"], F.lit("mp3"))
    bad = F.array_compact(F.array(*(F.when(empty(c), F.lit(c)) for c in ("text", "voiceId")), F.when(~speed.between(0.25, 4.0), F.lit("speed")), *(F.when(empty(c), F.lit(c)) for c in ("chunkId", "cacheKey")), F.when(~fmt.isin("mp3", "wav", "opus"), F.lit("format"))))
    return raw.withColumns({"text": q["text"], "voice_id": q["voiceId"], "speed": speed, "language": F.coalesce(q["language"], F.lit("en-US")), "chunk_id": q["chunkId"], "cache_key": q["cacheKey"], "format": fmt, "invalid_fields": bad})


def parse_ocr_requests(raw: DataFrame, col: str = "body") -> DataFrame:
    q = F.from_json(col, "struct<image:string,mimeType:string,pageNumber:int,documentId:string,languageHints:array<string>,consent:boolean>")
    mime = F.coalesce(q["mimeType"], F.lit("image/png"))
    bad = F.array_compact(F.array(F.when(F.coalesce(F.length(q["image"]), F.lit(0)) < 1, "image"), F.when(~mime.isin("image/png", "image/jpeg"), "mimeType"), F.when(F.coalesce(q["pageNumber"], F.lit(0)) < 1, "pageNumber"), F.when(F.coalesce(F.length(q["documentId"]), F.lit(0)) < 1, "documentId")))
    return raw.withColumns({"image": q["image"], "mime_type": mime, "page_number": q["pageNumber"], "document_id": q["documentId"], "language_hints": F.coalesce(q["languageHints"], F.array().cast("array<string>")), "consent": F.coalesce(q["consent"], F.lit(False)), "invalid_fields": bad})


def guard(requests: DataFrame, most_chars: int = 2500) -> DataFrame:
    """Requests (provider, text, speed) with the code that refuses them before any call, null if none."""
    own = capabilities(requests.sparkSession).select(F.col("provider").alias("_p"), "speed_min", "speed_max", "max_chars")
    met = requests.join(F.broadcast(own), requests["provider"] == own["_p"], "left")
    n = F.length("text")
    code = (
        F.when(F.col("_p").isNull(), "not_configured").when(n > most_chars, "text_too_long").when(trim(F.col("text")) == "", "invalid_request")
        .when(~F.col("speed").between(F.col("speed_min"), F.col("speed_max")), "unsupported_speed").when(n > F.col("max_chars"), "text_too_long")
    )
    return met.withColumn("error_code", code).drop("_p", "speed_min", "speed_max", "max_chars")


def responses(results: DataFrame) -> DataFrame:
    """Synthesis results as they are sent: audio as text without line ends, timing untouched."""
    return results.withColumn("audio", F.translate(F.base64("audio"), "\r\n", ""))


class Registry:
    """Plug-in point: provider names to Python callables over iterators of pandas frames."""

    def __init__(self) -> None:
        self.known: dict = {}

    def register(self, name: str, function, schema: str) -> None:
        self.known[name.strip().lower()] = (function, schema)

    def run(self, name: str, requests: DataFrame) -> DataFrame | None:
        """`requests` through the provider; None if no provider is named, an error if it is unknown."""
        name = (name or "").strip().lower()
        if not name:
            return None
        if name not in self.known:
            raise ValueError(f"not_configured: unknown provider; known: {', '.join(self.known)}")
        return requests.mapInPandas(*self.known[name])
