"""What the pipeline operators share: word class, shared storage, bounded batches."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: space, tab, line feed, vertical tab, form feed, carriage return.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_own_folder: list[str] = []
_made: ContextVar[list[str]] = ContextVar("made", default=[])


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, _UPPER, _UPPER.lower())


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent on a single machine, as in tests, a temporary folder stands in and goes
    when the process ends; on a cluster its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="pagewright-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: lineage ends here, and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def last_path() -> str:
    """Where the latest table was stored."""
    return _made.get()[-1]


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths that are stored meanwhile (in this thread), in order; whoever collects around it has them too."""
    made: list[str] = []
    before = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(before)
        _made.get().extend(made)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the table that `may_hold` looks ids up in: 64 a row, so at most 2**18 rows whatever it holds.
LOOKUP_BITS = 1 << 24


def may_hold(df: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """`df` with a column _may: false only where `key` is none of `ids` (a column x). A bounded table of bits
    is broadcast, so rows that an exact join would drop anyway need not be shuffled for it."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(LOOKUP_BITS))
    bits = ids.select(place(F.col("x").cast("long")).alias("p")).groupBy(F.expr("p div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("_bits"))
    met = df.withColumn("_place", place(key.cast("long"))).join(F.broadcast(bits), F.expr("_place div 64") == F.col("_word"), "left")
    return met.withColumn("_may", F.expr("coalesce(shiftright(_bits, cast(_place % 64 as int)) & 1, 0) = 1")).drop("_place", "_word", "_bits")


def sliced(batches: Iterator[pa.RecordBatch], rows: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, at most `rows` at a time; with `most` also at most that many bytes of the
    column text, or one row."""
    for b in batches:
        if most is None:
            yield from (b.slice(lo, rows) for lo in range(0, b.num_rows, rows))
            continue
        ends, lo = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while lo < b.num_rows:
            fit = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")) - lo
            n = min(rows, max(1, fit), b.num_rows - lo)
            yield b.slice(lo, n)
            lo += n


def give_back() -> None:
    """Freed memory goes back to the system. A Python worker takes task after task, stage after stage, and the
    allocators would keep what the largest of them needed, beside a JVM whose heap does not shrink either."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # no glibc
        pass


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow`, each task of which gives its memory back when it ends."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes that one Arrow batch carries to Python, whatever the length of the texts. The same
    value for all operators, since frames read it only when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer splits than there are cores is dealt out, so that all cores work on it."""
    out, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return out.repartition(cores) if out.rdd.getNumPartitions() < cores else out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def crc_remainder(c: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)
