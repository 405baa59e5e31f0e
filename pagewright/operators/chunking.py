"""Speech chunks, their keys and the cache of their audio."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import WS, WS_CHARS
from ..functions.hashing import cache_key, hash64

_DOC = "document_id"
_CHUNK = "document_id string, chunk_index int, text string, sentence_offsets array<struct<sentence_id:string,start:int,end:int>>, page_numbers array<int>, continues_mid_word boolean"


def split_long(text: str, most: int) -> list[tuple[str, bool]]:
    """Parts of `text` of at most `most` characters, cut at spaces; True for one that goes on within a word."""
    parts, inside, at = [], False, 0
    while len(text) - at > most:
        cut = text.rfind(" ", at, at + most + 1)
        end, skip = (cut, 1) if cut > at else (at + most, 0)
        parts.append((text[at:end], inside))
        at, inside = end + skip, not skip
    return parts + ([(text[at:], inside)] if at < len(text) else [])


def pack(entries: Iterator[tuple[str, str, int]], most: int) -> Iterator[dict]:
    """Chunks from (sentence id, speech text, page): as many whole sentences as fit, in order."""
    text, offsets, pages = "", [], set()

    def done(mid: bool = False) -> list[dict]:
        nonlocal text, offsets, pages
        out = [{"text": text, "sentence_offsets": offsets, "page_numbers": sorted(pages), "continues_mid_word": mid}] if text.strip(WS_CHARS) else []
        text, offsets, pages = "", [], set()
        return out

    for sentence, spoken, page in entries:
        if not spoken.strip(WS_CHARS):
            continue
        if len(spoken) > most:
            yield from done()
            for part, inside in split_long(spoken, most):
                text, offsets, pages = part, [{"sentence_id": sentence, "start": 0, "end": len(part)}], {page}
                yield from done(inside)
            continue
        if len(text) + bool(text) + len(spoken) > most:
            yield from done()
        start = len(text) + bool(text)
        text = f"{text} {spoken}" if text else spoken
        offsets.append({"sentence_id": sentence, "start": start, "end": len(text)})
        pages.add(page)
    yield from done()


def chunks(queue: DataFrame, most: int = 2500, voice: str = "browser", speed: float = 1.0, language: str = "en-US", provider: str = "browser") -> DataFrame:
    """Chunks of each document's queue (document_id, queue_index, id, speech_text, page_number). Packing
    depends on order, so each document is one sorted stream: no document is held in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4))))
        row = next(rows, None)

        def own(document: str) -> Iterator[tuple[str, str, int]]:
            nonlocal row
            while row is not None and row[0] == document:
                yield row[1], row[2], row[3]
                row = next(rows, None)

        schema = pa.schema([("document_id", pa.string()), ("chunk_index", pa.int32()), ("text", pa.string()), ("sentence_offsets", pa.list_(pa.struct([("sentence_id", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))), ("page_numbers", pa.list_(pa.int32())), ("continues_mid_word", pa.bool_())])
        held: list[dict] = []
        while row is not None:
            document = row[0]
            for k, c in enumerate(pack(own(document), most)):
                held.append({"document_id": document, "chunk_index": k, **c})
                if len(held) >= 500:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    ready = queue.repartition(_DOC).sortWithinPartitions(_DOC, "queue_index").select(_DOC, "id", "speech_text", F.col("page_number").cast("int"))
    made = ready.mapInArrow(run, _CHUNK)
    return made.withColumns(
        {
            "id": F.concat(_DOC, F.lit(":chunk"), F.col("chunk_index").cast("string")),
            "sentence_ids": F.transform("sentence_offsets", lambda s: s["sentence_id"]),
            "text_hash": hash64(F.col("text")),
            "cache_key": cache_key(F.col("text"), F.lit(provider), F.lit(voice), F.lit(float(speed)), F.lit(language)),
        }
    )


def lossless(queue: DataFrame, made: DataFrame) -> DataFrame:
    """document_id, ok: whether the chunks say what the queue says, white space aside."""
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c, f"[{WS}]+", " "), "^ | $", "")
    ordered = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x["v"]), "")
    said = queue.where(tidy(F.col("speech_text")) != "").groupBy(_DOC).agg(tidy(ordered("queue_index", F.concat(F.lit(" "), F.col("speech_text")))).alias("want"))
    part = F.when(F.col("continues_mid_word"), F.col("text")).otherwise(F.concat(F.lit(" "), F.col("text")))
    got = made.groupBy(_DOC).agg(tidy(ordered("chunk_index", part)).alias("got"))
    return said.join(got, _DOC, "full").select(_DOC, F.coalesce(F.col("want").eqNullSafe(F.col("got")), F.lit(False)).alias("ok"))


def chunk_of_sentence(made: DataFrame) -> DataFrame:
    """The first chunk of each sentence and where it stands there."""
    each = made.select(_DOC, "chunk_index", F.explode("sentence_offsets").alias("s"))
    return each.groupBy(_DOC, F.col("s.sentence_id").alias("sentence_id")).agg(F.min_by(F.struct("chunk_index", F.col("s.start").alias("start"), F.col("s.end").alias("end")), F.struct("chunk_index", "s.start")).alias("m")).select(_DOC, "sentence_id", "m.*")


def retained(urls: DataFrame, most: int = 12) -> DataFrame:
    """Client audio with `kept`: the newest `most` of each session stay, the rest are queued again."""
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("created"), F.desc("chunk_index")))
    return urls.withColumn("kept", rank <= most)


def attempts(results: DataFrame, most: int = 3) -> DataFrame:
    """Answers of a speech provider (chunk, seq, ok) with attempt (from 1), made (none follow a success or the
    last of `most`) and the chunk's status after it: ready, failed (to be tried again) or given-up."""
    order = Window.partitionBy("chunk").orderBy("seq")
    before = F.coalesce(F.max(F.when(F.col("attempt") <= most, F.col("ok").cast("int"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    out = results.withColumn("attempt", F.row_number().over(order)).withColumn("_before", before)
    made = ~F.col("_before") & (F.col("attempt") <= most)
    status = F.when(F.col("_before") | (made & F.col("ok")), "ready").when(F.col("attempt") < most, "failed").otherwise("given-up")
    return out.withColumns({"made": made, "status": status}).drop("_before")


def prefetch(positions: DataFrame, made: DataFrame, ahead: int = 2) -> DataFrame:
    """Chunks to synthesise at each position (document_id, at): that one and `ahead` more, as far as there are."""
    wanted = positions.select(_DOC, "at", F.explode(F.sequence(F.col("at"), F.col("at") + ahead)).alias("chunk_index"))
    return wanted.join(made.select(_DOC, "chunk_index"), [_DOC, "chunk_index"])


def with_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their cached audio, null for misses, and `cached`."""
    c = cache.select(F.col("cache_key").alias("_k"), "audio")
    return requests.join(c, requests["cache_key"] == c["_k"], "left").withColumn("cached", F.col("_k").isNotNull()).drop("_k")


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache, "cache_key", "left_anti")


class LruCache:
    """Least recently used first out, entries also by age. Keeps keys and times only."""

    def __init__(self, most: int, ttl: float):
        self.most, self.ttl, self.held = most, ttl, {}

    def get(self, key: str, now: float) -> bool:
        stored = self.held.pop(key, None)
        if stored is None or now - stored > self.ttl:
            return False
        self.held[key] = stored  # dicts keep order: the end is the newest
        return True

    def put(self, key: str, now: float) -> int:
        self.held.pop(key, None)
        self.held[key] = now
        gone = 0
        while len(self.held) > self.most:
            del self.held[next(iter(self.held))]
            gone += 1
        return gone

    def purge(self, now: float) -> int:
        old = [k for k, t in self.held.items() if now - t > self.ttl]
        for k in old:
            del self.held[k]
        return len(old)


def replay_cache(requests: DataFrame, most: int = 512, ttl: float = 3600.0) -> DataFrame:
    """Each request (cache, seq, now_seconds, cache_key) with `hit`; a miss stores the key. One sorted
    stream a cache, whose state is bounded by `most`."""
    schema = "cache string, seq long, hit boolean, evicted int, size int"

    def run(pdf_iter: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, own = object(), LruCache(most, ttl)
        for pdf in pdf_iter:
            out = []
            for cache, seq, now, key in zip(pdf["cache"], pdf["seq"], pdf["now_seconds"], pdf["cache_key"]):
                if cache != name:
                    name, own = cache, LruCache(most, ttl)
                hit = own.get(key, now)
                gone = 0 if hit else own.put(key, now)
                out.append((cache, seq, hit, gone, len(own.held)))
            yield pd.DataFrame(out, columns=["cache", "seq", "hit", "evicted", "size"])

    ready = requests.repartition("cache").sortWithinPartitions("cache", "seq").select("cache", "seq", "now_seconds", "cache_key")
    return ready.mapInPandas(run, schema)
