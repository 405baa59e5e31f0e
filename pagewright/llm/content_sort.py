"""Exact dedup by a content sort (operator 4).

Normalised texts are range-partitioned by sampled splitters, sorted by their bytes, on disk where they do
not fit in memory, and compared with their neighbour in full. A splitter is a bounded prefix of the
content; texts that share it are told apart by digest and id, so splitters stay short however long the
texts are, and a text that holds a third of all rows is cut into several ranges by its ids. Such a text
is the least or the greatest of its range in that order, so two groups a range are put together again.

Cases: a null text counts as empty; all empty texts are equal; null ids sort last, so a group has a
null keep_id only if all its ids are null; rows that repeat id and text count in group_size, and one
of them stays; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WS, map_in_arrow, small_batches, stored

#: Characters of content in a splitter.
PREFIX = 32
_LOCAL = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, edge_text string"
_NULL = np.iinfo(np.int64).max


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def _rows(ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, sha: pa.Array) -> pa.RecordBatch:
    """Output rows of whole runs: `lengths` per run."""
    starts = np.cumsum(lengths) - lengths
    kept = np.zeros(len(ids), bool)
    kept[starts] = True
    first = np.repeat(starts, lengths)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, mask=null), pa.array(ids[first], mask=null[first]), pa.array(np.repeat(lengths, lengths)), pa.array(kept), sha.cast(pa.string()), pa.nulls(len(ids), pa.string())],
        names=["doc_id", "keep_id", "group_size", "kept", "text_sha256", "edge_text"],
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in one sorted range, and a row with edge_text for those that may go on in
    another one: the least and the greatest by splitter. Of the open run only ids are held."""
    ids, null, text, sha = [], [], None, None
    edges: list[tuple | None] = [None, None]

    def note(text: str, sha: str, keep: int, gone: bool, size: int) -> None:
        key = (text[:PREFIX], sha)
        if edges[0] is None or key < edges[0][0]:
            edges[0] = key, text, keep, gone, size
        if edges[1] is None or key > edges[1][0]:
            edges[1] = key, text, keep, gone, size

    def close() -> pa.RecordBatch:
        own, gone = np.concatenate(ids), np.concatenate(null)
        note(text, sha, int(own[0]), bool(gone[0]), len(own))
        return _rows(own, gone, np.array([len(own)]), pa.array([sha] * len(own)))

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        norm, digest = b.column("norm"), b.column("sha")
        num, gone = pc.fill_null(b.column("doc_id"), _NULL).to_numpy(zero_copy_only=False), pc.is_null(b.column("doc_id")).to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = ~pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = text is None or norm[0].as_py() != text
        starts = np.flatnonzero(new)
        if not len(starts):
            ids.append(num)
            null.append(gone)
            continue
        if text is not None:
            ids.append(num[: starts[0]])
            null.append(gone[: starts[0]])
            yield close()
        lo, last = int(starts[0]), int(starts[-1])
        if len(starts) > 1:
            sizes = np.diff(starts)
            # only the least and the greatest of these can be an edge
            prefix = pc.utf8_slice_codeunits(norm.take(pa.array(starts[:-1])), 0, PREFIX).to_pylist()
            keys = list(zip(prefix, digest.take(pa.array(starts[:-1])).to_pylist()))
            for k in {min(range(len(keys)), key=keys.__getitem__), max(range(len(keys)), key=keys.__getitem__)}:
                at = int(starts[k])
                note(norm[at].as_py(), keys[k][1], int(num[at]), bool(gone[at]), int(sizes[k]))
            yield _rows(num[lo:last], gone[lo:last], sizes, digest.slice(lo, last - lo))
        ids, null, text, sha = [num[last:]], [gone[last:]], norm[last].as_py(), digest[last].as_py()
    if text is not None:
        yield close()
        own = [e for k, e in enumerate(edges) if not k or e[0] != edges[0][0]]
        keep = pa.array([e[2] for e in own], pa.int64(), mask=np.array([e[3] for e in own]))
        columns = [pa.nulls(len(own), pa.int64()), keep, pa.array([e[4] for e in own], pa.int64()), pa.array([False] * len(own)), pa.array([e[0][1] for e in own]), pa.array([e[1] for e in own])]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "keep_id", "group_size", "kept", "text_sha256", "edge_text"])


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id, keep_id, group_size, kept, text_sha256."""
    small_batches(df.sparkSession)
    norm = normalised(F.col(text_col))
    keyed = df.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm")).select("doc_id", "norm", F.sha2("norm", 256).alias("sha"), F.substring("norm", 1, PREFIX).alias("prefix"))
    by_id = F.col("doc_id").asc_nulls_last()
    ranged = keyed.repartitionByRange("prefix", "sha", by_id).sortWithinPartitions("norm", by_id).select("doc_id", "norm", "sha")
    local = stored(map_in_arrow(ranged, _neighbours, _LOCAL), "content-sort")
    edges = local.where("edge_text is not null").groupBy("edge_text").agg(F.min("keep_id").alias("edge_keep"), F.sum("group_size").alias("edge_size"), F.first("text_sha256").alias("edge_sha"))
    edges = edges.select("edge_sha", "edge_keep", "edge_size")
    # at most two rows for each range of the sort, whatever its size
    out = local.where("edge_text is null").join(F.broadcast(edges), F.col("text_sha256") == F.col("edge_sha"), "left")
    keep = F.when(F.col("edge_sha").isNull(), F.col("keep_id")).otherwise(F.col("edge_keep"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("edge_size", "group_size").alias("group_size"), (F.col("kept") & F.col("doc_id").eqNullSafe(keep)).alias("kept"), "text_sha256")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with one row of each group of equal texts: the one with the smallest id."""
    key = {"_sha": F.sha2(normalised(F.col(text_col)), 256), "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "_null": F.col(id_col).isNull()}
    kept = exact_groups(df, id_col, text_col).where("kept").select(F.coalesce("doc_id", F.lit(0)).alias("_k_id"), F.col("doc_id").isNull().alias("_k_null"), F.col("text_sha256").alias("_k_sha"))
    keyed = df.withColumns(key)
    joined = keyed.join(kept, (F.col("_sha") == F.col("_k_sha")) & (F.col("_id") == F.col("_k_id")) & (F.col("_null") == F.col("_k_null")), "left_semi")
    # rows that repeat id and text: where the join left them
    one = Window.partitionBy("_sha", "_id", "_null").orderBy("_id")
    return joined.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop(*key, "_n")
