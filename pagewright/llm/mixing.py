"""Mixing sources to target weights by a low-discrepancy schedule (operator 10).

Sizes are words. Each source's documents are shuffled by a keyed digest and laid end to end; the line
is cut into blocks of equal tokens (the last one may be short). Points of the golden-ratio sequence,
mapped through the cumulative target shares, deal slots to sources; the r-th slot of a source is
joined with its r-th block, starting over when its blocks are used up. A source uses slots until its
target is met: the last block is taken in part. Where the sequence has given a source a slot or two
too few, these follow at the end. The mix in slot order is near the targets from its start on: what any
prefix of the slots holds of a source differs from its share by a few blocks.

No source is handled as one group: offsets come from sums of digest buckets of about BUCKET documents,
slot ranks from counts of CHUNK slots. The digest is of id and text, so that null or repeated ids spread;
rows with the same id, source and text are counted, placed once, and laid out one after the other. Only
one row a source reaches the driver; over MOST_SOURCES sources are refused.

Cases: null text has size 0; documents of size 0 are taken 0 times; the null source is a source of
its own, ranked last; rows that repeat an id are documents of their own; no documents, no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, map_in_arrow, stored

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 4096
BUCKET = 1000
CHUNK = 1 << 16
MOST_SOURCES = 1_000_000
#: 2**31 divided by the golden ratio, to the next odd number: all points of a period differ.
GOLDEN, PERIOD = 1327217885, 1 << 31


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by code point, null last. A source whose share is above its cap keeps
    the cap; what is over is shared again by weight among the others."""
    rows = sorted(sizes, key=lambda r: (r[0] is None, r[0] or ""))
    weight = [weights[k % len(weights)] for k in range(len(rows))]
    left, free, full = sum(s for _, s in rows), set(range(len(rows))), set()
    while free:
        total = sum(weight[k] for k in free)
        over = {k for k in free if weight[k] * left > most * rows[k][1] * total}
        if not over:
            break
        free, full, left = free - over, full | over, left - sum(most * rows[k][1] for k in over)
    return [(s, n, float(most * n) if k in full else weight[k] * left / total if left else 0.0) for k, (s, n) in enumerate(rows)]


def _deal(bounds: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(0).to_numpy()
            u = (t % PERIOD) * GOLDEN % PERIOD / PERIOD
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.searchsorted(bounds, u, "right").astype(np.int32))], names=["t", "s"])

    return run


def schedule(df: DataFrame, plan: list[tuple[int, int, int]], block: int) -> DataFrame:
    """t, s, rank: what slot t takes; plan: (s, slots needed, quota) for each source."""
    spark = df.sparkSession
    quota = np.array([q for _, _, q in plan], float)
    bounds = np.cumsum(quota)[:-1] / max(1.0, quota.sum())
    slots = sum(n for _, n, _ in plan)
    dealt = map_in_arrow(spark.range(slots).select(F.col("id").alias("t")), _deal(bounds), "t long, s int").withColumn("chunk", F.floor(F.col("t") / CHUNK))
    earlier = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("s", "chunk").agg(F.count("*").alias("n")).select("s", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("t")) - 1
    ranked = dealt.withColumn("own", own).join(base, ["s", "chunk"]).select("t", "s", (F.col("base") + F.col("own")).alias("rank"))
    need = spark.createDataFrame([(s, n) for s, n, _ in plan], "s int, need long")
    used = ranked.join(need, "s").where("rank < need").select("t", "s", "rank")
    given = dealt.groupBy("s").agg(F.count("*").alias("given"))
    short = need.join(given, "s", "left").where("need > coalesce(given, 0)")
    more = short.select("s", F.coalesce("given", F.lit(0)).alias("given"), F.explode(F.expr("sequence(coalesce(given, 0), need - 1)")).alias("rank"))
    more = more.select((F.lit(slots) + F.col("rank") - F.col("given")).alias("t"), "s", "rank")
    return used.unionByName(more)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK_WORDS, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot (the first slot that takes words of it,
    null if none does) and uses (all slots that take its first word, in order) for every row of `df`."""
    spark = df.sparkSession
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), key.alias("digest"))
    base = stored(base.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("m")), "mix-sizes")
    sums = base.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("size"), F.sum("m").alias("n")).take(MOST_SOURCES + 1)
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    docs = {r.source: r.n for r in sums}
    goals = targets([(r.source, r["size"]) for r in sums])
    quota = [min(MOST_REPEATS * n, int(t + 0.5)) for _, n, t in goals]
    digits = [max(0, int(np.ceil(np.log(docs[s] / BUCKET) / np.log(16)))) for s, _, _ in goals]
    # one row a source, MOST_SOURCES at most
    sources = F.broadcast(spark.createDataFrame([(k, s, n, t, q, d) for k, ((s, n, t), q, d) in enumerate(zip(goals, quota, digits))], "s int, name string, source_size long, target double, quota long, digits int"))
    placed = base.join(sources, base["source"].eqNullSafe(sources["name"])).withColumn("bucket", F.expr("substring(digest, 1, digits)"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("s", "bucket").agg(F.sum(F.col("size") * F.col("m")).alias("w")).select("s", "bucket", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("s", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = ["doc_id", "source", "size", "source_size", "target", "s"]
    line = placed.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("m")).over(inside), F.lit(0))).join(starts, ["s", "bucket"])
    line = line.withColumn("nth", F.explode(F.expr("sequence(0, m - 1)"))).select(*cut, (F.col("start") + F.col("inside") + F.col("nth") * F.col("size")).alias("at"))
    line = stored(line, "mix-line")
    plan = []
    for k, ((_, n, _), q) in enumerate(zip(goals, quota)):
        blocks = -(-n // block)
        plan.append((k, q // n * blocks + -(-(q % n) // block) if n else 0, q))
    some = line.where("size > 0")
    spans = some.select(*cut, "at", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    lo, hi = F.greatest("at", F.col("block") * block), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    pieces = spans.withColumns({"lo": lo, "hi": hi})
    slots = schedule(df, plan, block).join(sources.select("s", "source_size", "quota"), "s")
    slots = slots.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    # words of the source's line that this slot takes: up to the block's end, the line's end or the quota
    slots = slots.withColumns({"block": F.expr("rank % blocks"), "upto": F.expr(f"least((rank % blocks + 1) * {block}, source_size, quota - rank div blocks * source_size)")})
    # a block has MOST_REPEATS slots at most, and one more in part
    uses = slots.groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct("t", "upto"))).alias("slots"))
    met = pieces.join(uses, ["s", "block"], "left").withColumn("slots", F.filter("slots", lambda x: x["upto"] > F.col("lo")))
    words_here = F.aggregate(F.coalesce("slots", F.array().cast("array<struct<t:bigint,upto:bigint>>")), F.lit(0).cast("long"), lambda n, x: n + F.least("hi", x["upto"]) - F.col("lo"))
    first = F.col("block") == F.expr(f"at div {block}")
    taken = met.groupBy(*cut, "at").agg(
        F.sum(words_here).alias("taken"), F.min(F.get("slots", F.lit(0))["t"]).alias("first_slot"), F.max(F.when(first, F.transform("slots", lambda x: x["t"]))).alias("uses")
    )
    out = ["doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "uses"]
    none = {"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long"), "uses": F.lit(None).cast("array<bigint>")}
    return taken.select(*out).unionByName(line.where("size = 0").withColumns(none).select(*out))


def mixed(df: DataFrame, **options) -> DataFrame:
    """`df` as the mix has it, in the order of its slots: each row as many times as its words are taken, to
    the nearest whole document (a source takes part of one document at most), each time where the slot
    that takes its first word stands. Rows of one id, source and size share what is taken of them evenly."""
    got = mix(df, **options)
    copies = got.where("taken > 0").groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("_taken"), F.min_by("uses", "first_slot").alias("_uses"))
    rows = got.where("size > 0").groupBy("doc_id", "source", "size").agg(F.count("*").alias("_rows"))
    same = [copies[c].eqNullSafe(rows[c]) for c in ("doc_id", "source", "size")]
    copies = copies.join(rows, same[0] & same[1] & same[2]).select(copies["doc_id"].alias("_i"), copies["source"].alias("_s"), copies["size"].alias("_w"), F.floor(F.col("_taken") / F.col("_rows") / copies["size"] + 0.5).cast("int").alias("_copies"), "_uses")
    keyed = df.withColumn("_words", words(F.col(options.get("text_col", "text"))))
    same = keyed[options.get("id_col", "doc_id")].cast("long").eqNullSafe(F.col("_i")) & keyed[options.get("source_col", "source")].eqNullSafe(F.col("_s")) & (F.col("_words") == F.col("_w"))
    met = keyed.join(copies.where("_copies > 0"), same).withColumn("_slot", F.explode(F.expr("slice(_uses, 1, _copies)")))
    return met.repartitionByRange("_slot").sortWithinPartitions("_slot", "_i").select(*df.columns)
