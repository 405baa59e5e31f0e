"""The services of `operators.state` over streams: same steps, state kept by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.chunking import LruCache
from ..operators.state import IDLE, SNAPSHOT, _clean, limiter_step, reduce_event


def _ordered(frames: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    got = list(frames)
    return pd.concat(got).sort_values(by, kind="stable") if got else pd.DataFrame()


class _Limiter(StatefulProcessor):
    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "count int, start double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.window.get() if self.window.exists() else None
        state, out = (state[0], state[1]) if state else None, []
        for r in _ordered(rows, "seq").itertuples(index=False):
            state, ok, wait = limiter_step(state, float(r.now_seconds), self.limit)
            out.append((*key, r.seq, ok, wait))
        if state:
            self.window.update((int(state[0]), float(state[1])))
        yield pd.DataFrame(out, columns=["client", "bucket", "seq", "allowed", "retry_after"])

    def close(self) -> None:
        pass


def rate_limit(requests: DataFrame, limit: int) -> DataFrame:
    """A stream of requests (client, bucket, seq, now_seconds) with allowed and retry_after. A limit that
    changes makes another query, with state of its own."""
    schema = "client string, bucket string, seq long, allowed boolean, retry_after int"
    return requests.groupBy("client", "bucket").transformWithStateInPandas(_Limiter(limit), schema, "Append", "None")


class _Player(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.snapshot = handle.getValueState("snapshot", SNAPSHOT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = self.snapshot.get() if self.snapshot.exists() else None
        state, out = dict(zip(IDLE, got)) if got else dict(IDLE), []
        for r in _ordered(rows, "seq").itertuples(index=False):
            state = reduce_event(state, _clean(r))
            out.append((key[0], r.seq, *state.values()))
        plain = {k: (int(v) if k in ("active_page", "active_word_index") and v is not None else v) for k, v in state.items()}
        self.snapshot.update(tuple(plain.values()))
        pdf = pd.DataFrame(out, columns=["session", "seq", *IDLE])
        for c in ("active_page", "active_word_index"):
            pdf[c] = pdf[c].astype("Int32")
        yield pdf

    def close(self) -> None:
        pass


def playback(events: DataFrame) -> DataFrame:
    """A stream of player events with the snapshot that each leaves."""
    return events.groupBy("session").transformWithStateInPandas(_Player(), f"session string, seq long, {SNAPSHOT}", "Append", "None")


class _Cache(StatefulProcessor):
    def __init__(self, most: int, ttl: float):
        self.most, self.ttl = most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "key string, stored double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own, out = LruCache(self.most, self.ttl), []
        if self.held.exists():
            own.held = {k: t for k, t in self.held.get()}
        for r in _ordered(rows, "seq").itertuples(index=False):
            hit = own.get(r.cache_key, float(r.now_seconds))
            gone = 0 if hit else own.put(r.cache_key, float(r.now_seconds))
            out.append((key[0], r.seq, hit, gone, len(own.held)))
        self.held.put([(k, float(t)) for k, t in own.held.items()])
        yield pd.DataFrame(out, columns=["cache", "seq", "hit", "evicted", "size"])

    def close(self) -> None:
        pass


def audio_cache(requests: DataFrame, most: int = 512, ttl: float = 3600.0) -> DataFrame:
    """A stream of cache requests (cache, seq, now_seconds, cache_key) with hit, evicted and size."""
    return requests.groupBy("cache").transformWithStateInPandas(_Cache(most, ttl), "cache string, seq long, hit boolean, evicted int, size int", "Append", "None")


def provisional(pages: DataFrame, analyse: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Results over the pages that have arrived so far, replaced as a whole with each batch of new ones:
    `sink` has the pages under pages/ and the last result under result/."""

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/pages/batch={epoch}")
        analyse(df.sparkSession.read.schema(df.schema).parquet(f"{sink}/pages")).write.mode("overwrite").parquet(f"{sink}/result")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def upserts(rows: DataFrame, store: Callable[[DataFrame], None], checkpoint: str):
    """Key-value changes into a store, batch by batch."""
    return rows.writeStream.foreachBatch(lambda df, epoch: store(df)).option("checkpointLocation", checkpoint)
