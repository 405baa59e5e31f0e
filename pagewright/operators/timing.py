"""From audio time to sentences and words."""

from __future__ import annotations

import io
import math
import wave

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import CHARS_PER_SECOND, WS
from ..functions.arrow import arrow_udf
from ..functions.text import round_half_up, words

_DOC = "document_id"


def usable(duration: Column) -> Column:
    return duration.isNotNull() & ~F.isnan(duration) & (duration != float("inf")) & (duration > 0)


def sentence_timings(chunks: DataFrame, duration: str = "duration_seconds") -> DataFrame:
    """Start and end of each sentence of each chunk by its share of characters."""
    total = F.greatest(F.length("text"), F.lit(1))
    each = chunks.where(usable(F.col(duration))).select(_DOC, "chunk_index", duration, total.alias("total"), F.posexplode("sentence_offsets").alias("position", "s"))
    at = lambda c: F.col(f"s.{c}") / F.col("total") * F.col(duration)
    return each.select(_DOC, "chunk_index", "position", F.col("s.sentence_id").alias("sentence_id"), at("start").alias("audio_start"), at("end").alias("audio_end"))


def sentence_at(chunks_at: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """Rows (document_id, chunk_index, text, sentence_offsets, audio_time, duration_seconds) with sentence_id:
    by exact intervals where `timings` has the chunk (after the last: the last), else by share of
    characters; null without offsets or a usable duration."""
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("audio_time") / F.col("duration_seconds")))
    offsets = F.col("sentence_offsets")
    guess = F.coalesce(F.get(F.filter(offsets, lambda s: ratio * F.length("text") < s["end"]), F.lit(0)), F.element_at(offsets, -1))["sentence_id"]
    out = chunks_at
    if timings is not None:
        own = timings.groupBy(F.col(_DOC).alias("_d"), F.col("chunk_index").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("position", "audio_start", "audio_end", F.col("sentence_id").alias("sid")))).alias("_t"))
        out = out.join(own, (out[_DOC] == own["_d"]) & (out["chunk_index"] == own["_c"]), "left").drop("_d", "_c")
        inside = F.filter("_t", lambda t: (F.col("audio_time") >= t["audio_start"]) & (F.col("audio_time") < t["audio_end"]))
        exact = F.coalesce(F.get(inside, F.lit(0)), F.element_at("_t", -1))["sid"]
        guess = F.when(F.col("_t").isNotNull(), exact).otherwise(guess)
    ok = usable(F.col("duration_seconds")) & (F.size("sentence_offsets") > 0)
    return out.withColumn("sentence_id", F.when(ok, guess)).drop("_t")


def word_progress(text: Column, elapsed: Column, duration: Column, source: Column, word_timings: Column | None = None, char_index: Column | None = None) -> Column:
    """struct(word_index, source, estimated): measured where the provider or browser tells, else by share of
    time; null for a text without words."""
    found = words(text)
    n = F.size(found)
    said = lambda i, s, e: F.struct(i.cast("int").alias("word_index"), F.lit(s).alias("source"), F.lit(e).alias("estimated"))
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), elapsed / duration))
    out = F.when(n == 0, F.lit(None).cast("struct<word_index:int,source:string,estimated:boolean>"))
    if word_timings is not None:
        # timings come in order, so those that have begun are a prefix
        begun = F.size(F.filter(word_timings, lambda t: t["audio_start"] <= elapsed))
        out = out.when((source == "provider-exact") & (F.size(word_timings) > 0), said(F.least(F.greatest(begun - 1, F.lit(0)), n - 1), "provider-exact", False))
    if char_index is not None:
        at = F.array_position(F.transform(found, lambda w: (char_index >= w["start"]) & (char_index < w["end"])), F.lit(True))
        out = out.when((source == "browser-boundary") & char_index.isNotNull(), said(F.when(at > 0, at - 1).otherwise(n - 1), "browser-boundary", False))
    return out.when(duration <= 0, said(F.lit(0), "estimated", True)).otherwise(said(F.least(n - 1, F.floor(ratio * n)), "estimated", True))


def word_timings_of(chunks: DataFrame, timings: DataFrame) -> DataFrame:
    """Word timings (document_id, chunk_index, start, end, audio_start, audio_end) within each sentence, both
    offsets and times counted from its first word."""
    each = chunks.select(F.col(_DOC).alias("_d"), F.col("chunk_index").alias("_c"), F.explode("sentence_offsets").alias("s"))
    met = timings.join(each, (timings[_DOC] == each["_d"]) & (timings["chunk_index"] == each["_c"]) & (timings["start"] >= each["s.start"]) & (timings["end"] <= each["s.end"]))
    base = F.first("audio_start").over(Window.partitionBy(_DOC, "chunk_index", "s.sentence_id").orderBy("start", "end"))
    return met.select(_DOC, "chunk_index", F.col("s.sentence_id").alias("sentence_id"), (F.col("start") - F.col("s.start")).alias("start"), (F.col("end") - F.col("s.start")).alias("end"), (F.col("audio_start") - base).alias("audio_start"), (F.col("audio_end") - base).alias("audio_end"))


def remaining_seconds(characters: Column, speed: Column) -> Column:
    return characters / (F.lit(CHARS_PER_SECOND) * F.greatest(F.lit(0.1), speed))


def pauses(queue: DataFrame, speed: float = 1.0) -> DataFrame:
    """Silence after each entry in ms: short within a paragraph, longer between, none at the end."""
    w = Window.partitionBy(_DOC).orderBy("queue_index")
    same = (F.lead("paragraph_id").over(w) == F.col("paragraph_id")) & (F.lead("region_id").over(w) == F.col("region_id"))
    rate = speed if math.isfinite(speed) and speed > 0 else 1.0
    base = F.when(same, 260).otherwise(540)
    last = F.lead("queue_index").over(w).isNull()
    return queue.withColumn("pause_ms", F.when(last, 0).otherwise(F.least(F.lit(900), round_half_up(base / F.lit(rate)))).cast("int"))


@arrow_udf("array<struct<start:int,end:int,audio_start:double,audio_end:double>>")
def align_words(texts: pd.Series, characters: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Character alignments folded to words; empty where they do not spell the text."""

    def one(text: str, chars: list, begin: list, end: list) -> list[dict]:
        if chars is None or begin is None or end is None or not len(chars) or not len(chars) == len(begin) == len(end) or "".join(chars) != text:
            return []
        out, at = [], None
        for k, c in enumerate([*chars, " "]):
            if c.isspace() and at is not None:
                out.append({"start": at, "end": k, "audio_start": float(begin[at]), "audio_end": float(end[k - 1])})
                at = None
            elif not c.isspace() and at is None:
                at = k
        return out

    return pd.Series([one(*r) for r in zip(texts, characters, starts, ends)])


def mock_timings(text: Column, speed: Column) -> Column:
    """Word times of the offline provider: every character takes as long."""
    rate = F.lit(CHARS_PER_SECOND) * speed
    pieces = F.split(text, " ", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,audio_start:double,audio_end:double>>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        end = (acc["at"] + F.length(w)).cast("int")
        word = F.struct(acc["at"].alias("start"), end.alias("end"), (acc["at"] / rate).alias("audio_start"), (end / rate).alias("audio_end"))
        return F.struct((end + 1).alias("at"), F.when(w == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(word))).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def mock_duration(text: Column, speed: Column) -> Column:
    return F.length(text) / (F.lit(CHARS_PER_SECOND) * speed)


@arrow_udf("binary")
def silent_wav(seconds: pd.Series) -> pd.Series:
    """Silence of the given length, 16 bit mono at 22 050 Hz."""

    def one(s: float) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(2)
            f.setframerate(22_050)
            f.writeframes(bytes(2 * max(1, int(22_050 * s))))
        return out.getvalue()

    return seconds.map(one)


def is_busy(state: Column) -> Column:
    return state.isin("preparing", "buffering", "seeking")


def is_playing(state: Column) -> Column:
    return state.isin("playing", "buffering")


def is_estimated(source: Column) -> Column:
    return source.isin("estimated", "none")


def boundary_word(text: Column, char_index: Column) -> Column:
    """Words before a character: the index of the word that a speech engine has reached."""
    return F.regexp_count(F.substring(text, F.lit(1), char_index), F.lit(f"[^{WS}]+"))
