"""Exact top-k search by inner product over multi-resolution segment statistics (operator 7).

Components become floor(1024 * x). A vector is cut into segments; each has a mean and a deviation.
With a = sqrt(length) * mean and b = sqrt(sum of squared deviations), the squared distance of two
vectors is at least sum((a - a')**2 + (b - b')**2), so their inner product is at most a.a' + b.b'.
Bounds are taken coarse to fine; what stays above the k-th best score found so far goes to the next
resolution, and what survives the finest is scored exactly in integers.

Each query first gets a floor: its k-th best score among FLOOR vectors, drawn by a digest. Vectors are
dealt by row into groups, which grow with the table from GROUP to LARGEST; the queries go to every group
in batches and stream past its index, which is all that a task holds. A group gives only what reaches a
query's floor, k rows at most.

Cases: rows with a null id, a null vector, or a null or non-finite component take no part; shorter
vectors count as padded with zeros; rows that repeat an id are candidates, and queries, of their own, so
that only the query's own row is left out; ties go to the smaller id; fewer than k others give fewer rows;
an empty table gives none; further columns are ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import sliced, small_batches, stored

SCALE = 1024
GROUP, LARGEST = 4096, 65536
#: Groups that a table has at most before they grow.
SPREAD = 64
#: Vectors that give each query a first floor.
FLOOR = 2048
BATCH = 64
#: Pairs whose vectors are brought together at once.
PAIRS = 1 << 15
SEGMENTS = (1, 4, 16)
_OUT = "row long, query_id long, vec_id long, score long"
_LOWEST = np.iinfo(np.int64).min


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows [a..., b...] of the bound above."""
    n, d = x.shape
    size = -(-d // segments)
    padded = np.zeros((n, size * segments))
    padded[:, :d] = x
    parts = padded.reshape(n, segments, size)
    mean = parts.mean(2)
    spread = np.sqrt(((parts - mean[:, :, None]) ** 2).sum(2))
    return np.concatenate([mean * np.sqrt(size), spread], 1)


def _padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x and y, pair by pair."""
    return np.einsum("ij,ij->i", x, y)


def _pairs(x: np.ndarray, at: np.ndarray, y: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Inner products of x[at] and y[cand], a bounded number of rows in memory at a time."""
    parts = [_exact(x[at[lo : lo + PAIRS]], y[cand[lo : lo + PAIRS]]) for lo in range(0, len(at), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, x.dtype)


class Segments:
    """Index over the vectors of one group: rows, their ids and components."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort((rows, ids))
        self.rows, self.ids, self.x = rows[order], ids[order], x[order]
        self.stats = [statistics(self.x, min(s, max(1, x.shape[1]))) for s in SEGMENTS]
        self.norm = np.sqrt((self.x.astype(float) ** 2).sum(1))

    def search(self, rows: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query position, place and score of the k best at each query's floor or above, its own row left out."""
        n, m = len(self.ids), len(rows)
        stats = [statistics(q, min(s, max(1, q.shape[1]))) for s in SEGMENTS]
        slack = 1e-9 * np.sqrt((q.astype(float) ** 2).sum(1))[:, None] * self.norm[None] + 0.5
        bound = stats[0] @ self.stats[0].T + slack
        bound[(rows[:, None] == self.rows[None]) | (bound < floor[:, None])] = -np.inf

        def cut() -> None:
            """Drops what is below the k-th of the k most promising, scored exactly."""
            if n > k:
                some = np.argpartition(-bound, k - 1, 1)[:, :k]
                at = np.repeat(np.arange(m), k)
                got = np.where(np.isinf(bound[at, some.ravel()]), _LOWEST, _exact(q[at], self.x[some.ravel()])).reshape(m, k)
                bound[bound < got.min(1)[:, None]] = -np.inf

        for fine, ours in zip(stats[1:], self.stats[1:]):
            cut()
            at, cand = np.nonzero(bound > -np.inf)
            finer = _pairs(fine, at, ours, cand) + slack[at, cand]
            bound[at, cand] = np.minimum(bound[at, cand], finer)
            bound[bound < floor[:, None]] = -np.inf
        cut()
        at, cand = np.nonzero(bound > -np.inf)
        score = _pairs(q, at, self.x, cand)
        enough = score >= floor[at]
        at, cand, score = at[enough], cand[enough], score[enough]
        order = np.lexsort((self.rows[cand], self.ids[cand], -score, at))
        at, cand, score = at[order], cand[order], score[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        top = rank < k
        return at[top], cand[top], score[top]


def _lists(column: pa.Array) -> list[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[i:j] for i, j in zip(ends, ends[1:])]


def _floors(k: int, rows: np.ndarray, sample: list[np.ndarray]) -> Callable:
    """The queries with the k-th best score among the sample (the lowest number if that has fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for b in sliced(batches, BATCH):
            own = _lists(b.column("v"))
            width = max((len(v) for v in (*own, *sample)), default=0)
            if index is None or index.x.shape[1] < width:
                index = Segments(rows, rows, _padded(sample, width))
            at, _, score = index.search(b.column("row").to_numpy(), _padded(own, index.x.shape[1]), k, np.full(len(own), _LOWEST))
            floor = np.full(len(own), _LOWEST)
            full = np.bincount(at, minlength=len(own)) >= k
            least = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(least, at, score)
            floor[full] = least[full]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floor)], names=[*b.schema.names, "floor"])

    return run


def _search(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, vecs, asked, index = None, [], [], None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal index
            if not asked or not vecs:
                asked.clear()
                return
            width = max(max(len(v) for *_, v in asked), index.x.shape[1] if index else max(len(v) for *_, v in vecs))
            if index is None or index.x.shape[1] < width:
                index = Segments(np.array([r for r, _, _ in vecs]), np.array([i for _, i, _ in vecs]), _padded([v for *_, v in vecs], width))
            rows, ids, floor = (np.array([a[c] for a in asked], np.int64) for c in range(3))
            at, cand, score = index.search(rows, _padded([v for *_, v in asked], width), k, floor)
            yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(ids[at]), pa.array(index.ids[cand]), pa.array(score)], names=["row", "query_id", "vec_id", "score"])
            asked.clear()

        for b in batches:
            plain = [b.column(c).to_pylist() for c in ("g", "kind", "row", "vec_id", "floor")]
            for g, kind, row, i, floor, v in zip(*plain, _lists(b.column("v"))):
                if g != group:
                    yield from flush()
                    group, index = g, None
                    vecs.clear()
                if kind:
                    asked.append((row, i, floor, v.copy()))
                    if len(asked) >= BATCH:
                        yield from flush()
                else:
                    vecs.append((row, i, v.copy()))
        yield from flush()

    return run


def search(df: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", group: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best others for each row where `is_query` (SQL over the id
    column, named vec_id) holds."""
    small_batches(df.sparkSession)
    x = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = "vec_id is not null and x is not null and forall(x, e -> e is not null and not isnan(e) and abs(e) < double('infinity'))"
    # numbered and written once: a row keeps its number
    vectors = stored(x.where(fine).selectExpr("monotonically_increasing_id() as row", "vec_id", f"transform(x, e -> cast(floor({SCALE} * e) as long)) as v"), "vectors")
    n = vectors.count()
    groups = max(1, -(-n // (group or min(LARGEST, max(GROUP, n // SPREAD)))))
    drawn = vectors.select("row", "v").orderBy(F.xxhash64("row"), "row").limit(FLOOR).collect()
    floors = _floors(k, np.array([r.row for r in drawn], np.int64), [np.array(r.v, np.int64) for r in drawn])
    asks = vectors.where(is_query).select("row", "vec_id", "v")
    asks = stored(asks.repartition(max(1, n // GROUP)).mapInArrow(floors, "row long, vec_id long, v array<long>, floor long"), "queries")
    # one copy of each query for each group: the stated queries meet all rows, block by block
    asked = asks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "row", "vec_id", "floor", "v")
    rows = vectors.select(F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "row", "vec_id", F.lit(0).cast("long").alias("floor"), "v")
    parts = rows.unionByName(asked).repartition("g").sortWithinPartitions("g", "kind")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return parts.mapInArrow(_search(k), _OUT).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
