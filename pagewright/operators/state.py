"""Order-dependent services over batches: limiter, player, queue remapping. `streaming` has them over
streams with the same step functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import match_key

WINDOW_SECONDS = 60.0


def limiter_step(state: tuple[int, float] | None, now: float, limit: int) -> tuple[tuple[int, float] | None, bool, int]:
    """New (count, window start), whether the request is allowed, seconds to wait if not. A window starts
    with its key's first request; refused ones do not count; a limit of 0 allows all."""
    if limit <= 0:
        return state, True, 0
    count, start = state if state and now - state[1] < WINDOW_SECONDS else (0, now)
    if count >= limit:
        return state, False, max(1, int(WINDOW_SECONDS - (now - start)))
    return (count + 1, start), True, 0


def _fold(keys: list[str], order: str, columns: list[str], schema: str, step: Callable, start: Callable) -> Callable:
    """A stream sorted by keys and order, folded key by key: state of one key at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    current, state = key, start()
                state, result = step(state, row)
                out.append((*key, getattr(row, order), *result))
            yield pd.DataFrame(out, columns=names)

    return run


def rate_limit(requests: DataFrame, limit: int) -> DataFrame:
    """Requests (client, bucket, seq, now_seconds) with allowed and retry_after."""

    def step(state, row):
        state, ok, wait = limiter_step(state, row.now_seconds, limit)
        return state, (ok, wait)

    schema = "client string, bucket string, seq long, allowed boolean, retry_after int"
    ready = requests.repartition("client", "bucket").sortWithinPartitions("client", "bucket", "seq").select("client", "bucket", "seq", "now_seconds")
    return ready.mapInPandas(_fold(["client", "bucket"], "seq", ["now_seconds"], schema, step, lambda: None), schema)


IDLE = {
    "state": "idle", "active_sentence_id": None, "active_paragraph_id": None, "active_region_id": None, "active_page": None, "active_chunk_id": None, "active_word_index": None,
    "word_timing_source": "none", "audio_timestamp": 0.0, "speed": 1.0, "volume": 1.0, "voice_id": None, "provider_name": None, "error": None,
}
SNAPSHOT = (
    "state string, active_sentence_id string, active_paragraph_id string, active_region_id string, active_page int, active_chunk_id string, active_word_index int, "
    "word_timing_source string, audio_timestamp double, speed double, volume double, voice_id string, provider_name string, error string"
)
EVENT = "session string, seq long, type string, voice_id string, provider string, sentence_id string, paragraph_id string, region_id string, page int, audio_timestamp double, word_index int, source string, chunk_id string, speed double, volume double, message string"


def clamp_speed(x: float | None) -> float:
    return 1.0 if x is None or not math.isfinite(x) else min(3.0, max(0.5, math.floor(x * 100 + 0.5) / 100))


def _place(e: dict) -> dict:
    return {"active_sentence_id": e["sentence_id"], "active_paragraph_id": e["paragraph_id"], "active_region_id": e["region_id"], "active_page": e["page"], "active_word_index": None}


#: For each event, what changes given the snapshot and the event; None: nothing does.
TRANSITIONS: dict[str, Callable[[dict, dict], dict | None]] = {
    "PREPARE": lambda s, e: {"state": "preparing", "voice_id": e["voice_id"], "provider_name": e["provider"], "error": None},
    "READY": lambda s, e: {"state": "paused"} if s["state"] == "preparing" else None,
    "PLAY": lambda s, e: None if s["state"] == "error" else {"state": "playing", "error": None},
    "PAUSE": lambda s, e: {"state": "paused"} if s["state"] in ("playing", "buffering", "seeking", "preparing") else None,
    "STOP": lambda s, e: {"state": "stopped", "audio_timestamp": 0.0, "active_word_index": None, "active_chunk_id": None},
    "BUFFER": lambda s, e: {"state": "buffering"} if s["state"] == "playing" else None,
    "SEEK_SENTENCE": lambda s, e: {"state": "seeking", **_place(e), "audio_timestamp": 0.0, "error": None},
    "SEEK_TIME": lambda s, e: {"state": "seeking", "audio_timestamp": max(0.0, e["audio_timestamp"])},
    "SEEK_COMMITTED": lambda s, e: {"state": "playing"} if s["state"] == "seeking" else None,
    "TICK": lambda s, e: {"state": "playing", "audio_timestamp": e["audio_timestamp"]} if s["state"] in ("playing", "buffering") else None,
    "SENTENCE_ADVANCED": lambda s, e: _place(e),
    "WORD_BOUNDARY": lambda s, e: {"active_word_index": e["word_index"], "word_timing_source": e["source"]},
    "CHUNK_ACTIVE": lambda s, e: {"active_chunk_id": e["chunk_id"]},
    "SET_SPEED": lambda s, e: {"speed": clamp_speed(e["speed"])},
    "SET_VOLUME": lambda s, e: {"volume": min(1.0, max(0.0, e["volume"]))},
    "SET_VOICE": lambda s, e: {"voice_id": e["voice_id"], "provider_name": e["provider"], **({"state": "buffering"} if s["state"] == "playing" else {})},
    "END_OF_QUEUE": lambda s, e: {"state": "stopped", "active_word_index": None},
    "ERROR": lambda s, e: {"state": "error", "error": e["message"]},
    "CLEAR_ERROR": lambda s, e: {"error": None, **({"state": "paused"} if s["state"] == "error" else {})},
}


def reduce_event(snapshot: dict, event: dict) -> dict:
    change = TRANSITIONS.get(event["type"], lambda s, e: None)(snapshot, event)
    return {**snapshot, **change} if change else snapshot


def _clean(row) -> dict:
    return {k: None if v is None or (isinstance(v, float) and math.isnan(v)) else v for k, v in row._asdict().items()}


def replay_playback(events: DataFrame) -> DataFrame:
    """Each event (EVENT) with the snapshot that it leaves."""

    def step(state, row):
        state = reduce_event(state, _clean(row))
        return state, tuple(state.values())

    schema = f"session string, seq long, {SNAPSHOT}"
    names = [c.split()[0] for c in EVENT.split(", ")]
    ready = events.repartition("session").sortWithinPartitions("session", "seq").select(*names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _fold(["session"], "seq", [], schema, step, lambda: dict(IDLE))(frames):
            for c in ("active_page", "active_word_index"):
                out[c] = out[c].astype("Int32")
            yield out

    return ready.mapInPandas(run, schema)


def remap(positions: DataFrame, previous: DataFrame, following: DataFrame) -> DataFrame:
    """Where each reading position (document_id, sentence_id) stands in a rebuilt queue: the same id, else
    the same page and text, else the first sentence at or after it, else the last. Three equi-joins and an
    as-of window; sentences: document_id, id, page_number, text, document_index, position (0-based)."""
    d = "document_id"
    old = previous.select(F.col(d).alias("_d"), F.col("id").alias("_i"), F.col("page_number").alias("old_page"), match_key(F.col("text")).alias("old_key"), F.col("document_index").alias("old_index"))
    p = positions.where("sentence_id is not null")
    p = p.join(old, (p[d] == old["_d"]) & (p["sentence_id"] == old["_i"]), "left").drop("_d", "_i")
    ids = following.groupBy(F.col(d).alias("_d"), F.col("id").alias("_i")).agg(F.min("position").alias("by_id"))
    keys = following.groupBy(F.col(d).alias("_kd"), F.col("page_number").alias("_kp"), match_key(F.col("text")).alias("_kk")).agg(F.min("position").alias("by_text"))
    last = following.groupBy(F.col(d).alias("_ld")).agg(F.max("position").alias("last"))
    p = p.join(ids, (p[d] == ids["_d"]) & (p["sentence_id"] == ids["_i"]), "left").drop("_d", "_i")
    p = p.join(keys, (p[d] == keys["_kd"]) & (p["old_page"] == keys["_kp"]) & (p["old_key"] == keys["_kk"]), "left").drop("_kd", "_kp", "_kk")
    p = p.join(last, p[d] == last["_ld"]).drop("_ld")
    # first at or after: the least position over all that do not come before (page, index)
    marks = p.where("old_page is not null").select(d, "old_page", "old_index").distinct()
    rows = following.select(d, F.col("page_number").alias("g"), F.col("document_index").alias("x"), "position", F.lit(1).alias("k"))
    rows = rows.unionByName(marks.select(d, F.col("old_page").alias("g"), F.col("old_index").alias("x"), F.lit(None).cast("int").alias("position"), F.lit(0).alias("k")))
    ahead = Window.partitionBy(d).orderBy("g", "x", "k").rowsBetween(0, Window.unboundedFollowing)
    after = rows.withColumn("by_place", F.min("position").over(ahead)).where("k = 0").select(F.col(d).alias("_d"), F.col("g").alias("_g"), F.col("x").alias("_x"), "by_place")
    p = p.join(after, (p[d] == after["_d"]) & (p["old_page"] == after["_g"]) & (p["old_index"] == after["_x"]), "left")
    exact = F.coalesce("by_id", "by_text")
    found = F.col("by_id").isNotNull() | F.col("old_page").isNotNull()
    index = F.when(found, F.coalesce("by_id", "by_text", "by_place", "last"))
    return p.where(found).select(d, "sentence_id", index.alias("index"), exact.isNotNull().alias("exact"))


def held_queues(events: DataFrame) -> DataFrame:
    """Events (session, seq, state, version: the queue that arrives with the event, else null) with `active`
    and `pending` queue versions. A queue that arrives during playback is held, the latest only, and taken up
    at the next event that leaves the player neither playing nor buffering. Two running last values."""
    upto = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    busy = F.coalesce(F.col("state").isin("playing", "buffering"), F.lit(False))
    latest = events.withColumn("_latest", F.last("version", ignorenulls=True).over(upto))
    taken = latest.withColumn("active", F.last(F.when(~busy, F.col("_latest")), ignorenulls=True).over(upto))
    return taken.withColumn("pending", F.when(~F.col("_latest").eqNullSafe(F.col("active")), F.col("_latest"))).drop("_latest")


def continue_after(remapped: DataFrame, following: DataFrame) -> DataFrame:
    """Where reading goes on in a rebuilt queue (`remap`): after the sentence itself, or at the one that stands
    in for it; null at the end."""
    at = following.select(F.col("document_id").alias("_d"), F.col("position").alias("_p"), F.col("id").alias("next_id"))
    r = remapped.withColumn("_target", F.when(F.col("exact"), F.col("index") + 1).otherwise(F.col("index")))
    return r.join(at, (F.col("document_id") == F.col("_d")) & (F.col("_target") == F.col("_p")), "left").drop("_d", "_p", "_target")


def milestones(n_pages: Column) -> Column:
    """Page counts at which a provisional pass is made: 1, 2, 4, ... below the number of pages."""
    top = F.ceil(F.log2(F.greatest(n_pages, F.lit(1)))).cast("int")
    return F.when(n_pages > 1, F.transform(F.sequence(F.lit(0), top - 1), lambda k: F.pow(F.lit(2), k).cast("int"))).otherwise(F.array().cast("array<int>"))


def provisional_pages(pages: DataFrame) -> DataFrame:
    """Pages of each provisional pass: document_id, pages_analyzed, page_number."""
    n = pages.groupBy("document_id").agg(F.count("*").alias("n"))
    at = n.select("document_id", F.explode(milestones(F.col("n"))).alias("pages_analyzed"))
    ranked = pages.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy("page_number")))
    return ranked.join(at, "document_id").where("rank <= pages_analyzed").select("document_id", "pages_analyzed", "page_number")


def expired(files: DataFrame, now: float, retention_seconds: float, age: str = "modified_seconds") -> DataFrame:
    return files.where(F.lit(now) - F.col(age) > retention_seconds)
