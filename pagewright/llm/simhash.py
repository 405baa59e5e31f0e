"""SimHash near-dedup over a Gray-order hierarchical index (operator 2).

Fingerprints: XXH64 (seed 42) of every shingle, a bit set where over half the hashes have it.

Links at up to `radius` differing bits: by the pigeonhole principle two such fingerprints agree
on one of radius+1 bit blocks, so each fingerprint goes to radius+1 (block, value) groups. Inside a
task each group is sorted by Gray rank; runs of neighbours become nodes that hold the bits all their
members share, child nodes hold only what the parents do not, and a search drops a node with all
below it as soon as the differences summed on the way down exceed the radius. A task sends on a
spanning forest of the links it found, never all pairs.

A group may be large when very many different fingerprints share a block. All differences inside it
lie in the bits outside that block, so a group over GROUP rows is divided again, by radius+1 shares
of those bits, and so on; a group that leaves b bits free has at most 2**b members, which ends it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import collecting, drop_paths, map_in_arrow, may_hold, sliced, small_batches, stored
from .graph import components

#: Most rows of a group that one index holds.
GROUP = 1024
FANOUT = 8
#: Hashes counted at a time, so that a long text needs no more memory than a short one.
BLOCK = 1 << 14


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit fingerprint. Null, empty and blank texts give 0; fewer words than a shingle
    count as one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        bits = h(b" ".join(words), 42)
        return bits - (1 << 64) if bits >> 63 else bits
    ones, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        grams = zip(*(words[lo + k : hi + k] for k in range(shingle)))
        own = np.array([h(b" ".join(g), 42) for g in grams], "<u8")
        ones += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2000):
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    small_batches(df.sparkSession)
    return map_in_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _fingerprints(shingle), "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each word in the reflected Gray sequence: prefix xor from the top bit."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _gray_keys(words: np.ndarray) -> list[np.ndarray]:
    """Sort keys, the first last, of fingerprints of several words, the first word highest."""
    odd, out = np.zeros(len(words), bool), []
    for w in words.T:
        rank = gray_rank(w)
        out.append(np.where(odd, ~rank, rank))
        odd ^= (np.bitwise_count(w) & 1).astype(bool)
    return out[::-1]


class GrayIndex:
    """Hierarchies over groups of fingerprints; each group has a root of its own.

    `group` (n) and `words` (n, words a fingerprint) are parallel; each (group, fingerprint) once.
    """

    def __init__(self, group: np.ndarray, words: np.ndarray, fanout: int = FANOUT):
        order = np.lexsort((*_gray_keys(words), group))
        self.order, self.words = order, words[order]
        _, self.of = np.unique(group[order], return_inverse=True)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.masks, self.patterns, self.spans = [np.full(words.shape, full)], [self.words], []
        of = self.of
        while len(of) > (of[-1] + 1 if len(of) else 0):
            start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            rank = np.arange(len(of)) - np.repeat(start, np.diff(np.r_[start, len(of)]))
            first = np.flatnonzero(rank % fanout == 0)
            end = np.r_[first[1:], len(of)]
            mask, pattern = self.masks[-1], self.patterns[-1]
            lead = np.repeat(pattern[first], end - first, 0)
            same = np.bitwise_and.reduceat(mask & ~(pattern ^ lead), first, 0)
            self.spans.append((first, end))
            self.masks.append(same)
            self.patterns.append(pattern[first] & same)
            of = of[first]

    def links(self, radius: int, pairs: int = 1 << 18, ask: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of positions (in the arrays given at the start) within `radius` bits, and their
        distances, in blocks whose size does not depend on that of the groups; with `ask` (a flag a
        position) only pairs with a flag at one end or both."""
        asks = np.ones(len(self.of), bool) if ask is None else ask[self.order]
        queries = np.flatnonzero(asks)
        # as many queries at a time as meet `pairs` members of their groups
        met = np.cumsum(np.bincount(self.of)[self.of][queries]) if len(self.of) else np.zeros(0, int)
        cuts = np.flatnonzero(np.diff(met // pairs)) + 1
        for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(met)].tolist()):
            q = queries[lo:hi]
            word, node = self.words[q], self.of[q]
            top = len(self.masks) - 1
            near = np.bitwise_count((word ^ self.patterns[top][node]) & self.masks[top][node]).sum(1, dtype=np.int16)
            at = np.arange(len(q))
            for level in range(top - 1, -1, -1):
                first, end = self.spans[level]
                width = (end - first)[node]
                child = np.repeat(first[node] - (np.cumsum(width) - width), width) + np.arange(width.sum())
                at, above, near = np.repeat(at, width), np.repeat(node, width), np.repeat(near, width)
                rest = self.masks[level][child] & ~self.masks[level + 1][above]
                near = near + np.bitwise_count((word[at] ^ self.patterns[level][child]) & rest).sum(1, dtype=np.int16)
                ok = near <= radius
                at, node, near = at[ok], child[ok], near[ok]
            ok = (q[at] < node) | ~asks[node]
            yield self.order[q[at[ok]]], self.order[node[ok]], near[ok]


def forest(n: int, links: Iterator[tuple[np.ndarray, ...]], label: np.ndarray | None = None) -> np.ndarray:
    """Label of each of n nodes: the least node reachable over the links seen (and those that made `label`)."""
    label = np.arange(n) if label is None else label.copy()
    for a, b, _ in links:
        while len(a):
            x, y = label[a], label[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            if len(a):
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label != label[label]).any():
                    label = label[label]
    return label


def _search(radius: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
        if not got:
            return
        mask, key, fp = (np.concatenate(x) for x in zip(*got))
        pairs = np.unique(np.rec.fromarrays([mask, key, fp]))
        _, group, size = np.unique(np.rec.fromarrays([pairs.f0, pairs.f1]), return_inverse=True, return_counts=True)
        several = size[group] > 1
        group, own = group[several], pairs.f2[several]
        words = own.view(np.uint64).reshape(-1, 1)
        label = forest(len(own), GrayIndex(group, words).links(radius)) if len(own) else np.zeros(0, int)
        out = label != np.arange(len(own))
        yield pa.RecordBatch.from_arrays([pa.array(own[out]), pa.array(own[label[out]])], names=["a", "b"])

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def finer(mask: int, parts: int) -> list[int]:
    """`mask` with each of `parts` even shares of the bits that it leaves free (signed words)."""
    mask &= (1 << 64) - 1
    free = [k for k in range(63, -1, -1) if not mask >> k & 1]
    cut = [len(free) * k // parts for k in range(parts + 1)]
    return [_signed(mask | sum(1 << k for k in free[lo:hi])) for lo, hi in zip(cut, cut[1:])]


def near_links(fps: DataFrame, radius: int, group: int = GROUP) -> DataFrame:
    """a, b: fingerprints whose components are those of all links at up to `radius` bits.

    `fps` has each fingerprint (fp long) once.
    """
    spark, parts = fps.sparkSession, radius + 1
    masks, found = finer(0, parts), None
    keyed = fps.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).withColumn("key", F.expr("fp & mask"))
    while True:
        large = stored(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > group).select("mask", "key"), "large-groups")
        none = large.isEmpty()
        small = keyed if none else keyed.join(large, ["mask", "key"], "left_anti")
        links = map_in_arrow(small.repartition("mask", "key").select("mask", "key", "fp"), _search(radius), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if none:
            return found
        # (radius + 1) ** level masks at most, whatever the number of rows
        masks = [r.mask for r in large.select("mask").distinct().collect()]
        below = spark.createDataFrame([(m, finer(m, parts)) for m in masks], "mask long, finer array<long>")
        rest = stored(keyed.join(large, ["mask", "key"], "left_semi"), "large-rows")
        keyed = rest.join(F.broadcast(below), "mask").select("fp", F.explode("finer").alias("mask")).withColumn("key", F.expr("fp & mask"))
        masks = sorted({x for m in masks for x in finer(m, parts)})


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp long, component_id for every row: the least doc_id among documents reachable over
    links at `radius` or fewer differing bits.

    Rows with equal fingerprints are linked, fingerprint zero (no words) like any other; null ids
    take part but are never a component_id unless all ids of a component are null; repeated rows
    give repeated result rows; an empty table gives an empty result.
    """
    marks = stored(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    reps = marks.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = stored(components(near_links(reps.select("fp"), radius)), "roots")
    of = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    of = stored(of, "classes")
    least = of.groupBy("root").agg(F.min("rep").alias("component_id")).withColumnRenamed("root", "r")
    named = of.join(least, of["root"] == least["r"]).select(F.col("fp").alias("f"), "component_id")
    return marks.join(named, marks["fp"] == named["f"]).select("doc_id", "fp", "component_id")


# --- similarity joins: links by Jaccard similarity of word shingles

#: Words of a wide fingerprint (64 bits each).
WIDE = 4
#: Fingerprints that an average bucket holds, at most: each doubling compares more and saves a sixth of the tables.
BUCKET = 256
#: Texts of up to so many shingles meet over shingles they share: few hashes make fingerprints differ more.
FEW = 24
#: Share by which sets of more than FEW shingles differ in more bits at most than sets without end (1.03).
SPREAD = 1.04
#: Bits that such a text and a copy never differ in, in practice (48 expected at most, deviation 6).
FAR = 96
#: Deviations from the expected distance that a search allows.
DEVIATIONS = 4
#: Common shingles of short texts that are looked at last.
COMMON = 10_000
WORDS = [f"w{k}" for k in range(WIDE)]
#: One in so many tables is searched first, so that a family of copies is one class when all are searched.
FIRST = 4
#: Rows of a large bucket, the nearest to its majority of bits, that meet all others in that first search.
HUBS = 8
#: Rows whose cells are searched together.
CHUNK = 1 << 16
#: Pairs whose shingles are compared at a time.
PAIRS = 1 << 13
#: Share of the pairs at exactly the similarity asked for that no bucket may bring together.
MISSED = 0.01


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Words whose every bit depends on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a text (ASCII lower case); of one with fewer words than
    a shingle, the one hash of all its words. Words are hashed once each (`known`), shingles are sums over
    their words, so that no shingle is ever a string."""
    known = {} if known is None else known
    words = []
    for w in (text or "").encode().lower().split():
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        words.append(h)
    own = np.array(words, np.uint64)
    size = min(shingle, max(1, len(own)))
    n = len(own) - size + 1
    out = np.full(max(1, n), size, np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * _MIX[0] + own[k : k + n]
    return np.unique(_mixed(out))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE words over the hashes of distinct shingles; their expected share of differing bits is the angle
    between the shingle sets."""
    ones = np.zeros(64 * WIDE, np.int64)
    for lo in range(0, len(hashes), BLOCK):
        own = hashes[lo : lo + BLOCK, None] + np.arange(1, WIDE + 1, dtype=np.uint64) * _MIX[0]
        ones += np.unpackbits(_mixed(own).view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view("<i8")


def _total(hashes: np.ndarray) -> int:
    """A sum that tells sets apart."""
    return int(hashes.sum(dtype=np.uint64).view(np.int64))


def differing(similarity: float) -> float:
    """Expected share of differing bits of two sets of equal size with this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def missed(share: float, size: int, tables: int, radius: int) -> float:
    """Share of the pairs whose bits differ with probability `share` that are beyond the radius or in no
    common bucket of `tables` tables of `size` bits, over the distribution of their distance."""
    far, bits = np.arange(64 * WIDE + 1), 64 * WIDE
    ways = np.array([lgamma(bits + 1) - lgamma(d + 1) - lgamma(bits - d + 1) for d in far])
    chance = np.exp(ways + far * np.log(share) + (bits - far) * np.log(1 - share))
    k = np.arange(size)
    meet = np.prod(np.maximum(bits - far[:, None] - k, 0) / (bits - k), 1)
    return float((chance * np.where(far <= radius, (1 - meet) ** tables, 1)).sum())


def tables_needed(share: float, size: int, radius: int) -> int:
    """Least number of tables that misses MISSED of the pairs at most."""
    high = 1
    while missed(share, size, high, radius) > MISSED:
        high *= 2
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if missed(share, size, mid, radius) <= MISSED else (mid, high)
    return high


def _wide(shingle: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1000):
            known: dict[bytes, int] = {}
            sets = [shingle_hashes(t.as_py(), shingle, known) for t in b.column(1)]
            words = np.array([wide_fingerprint(x) for x in sets]).reshape(-1, WIDE)
            few = [x.view(np.int64) if len(x) <= most else None for x in sets]
            columns = [pa.array([_total(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array(few, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in words.T), *columns], names=["doc_id", *WORDS, "total", "n", "few"])

    return run


def _bucket_keys(bits: np.ndarray) -> Callable:
    """Rows by bucket: for each table its number and a key of the fingerprint's bits at the table's places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = np.stack([b.column(w).to_numpy() for w in WORDS], 1)
            for t, places in enumerate(bits):
                own = np.full(len(words), t + 1, np.uint64)
                for p in places:
                    own = own * np.uint64(0xD6E8FEB86659FD93) + ((words[:, p // 64] >> (p % 64)) & 1).view(np.uint64)
                own ^= own >> np.uint64(29)
                table = pa.array(np.full(len(words), t, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), table, *b.columns], names=["key", "t", *b.schema.names])

    return run


def _few_keys(similarity: float, common: dict[int, int]) -> Callable:
    """Rows of short texts by shingle: of the shingles, rare ones first, as many as two similar sets cannot
    both do without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1000):
            key, row = [], []
            for k, few in enumerate(b.column("s").to_pylist()):
                own = sorted(few, key=lambda x: (common.get(x, 0), x))[: len(few) - int(np.ceil(similarity * len(few) - 1e-9)) + 1]
                key += own
                row += [k] * len(own)
            kept = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.full(len(key), -1, np.int32)), *kept.columns], names=["key", "t", *kept.schema.names])

    return run


CELL = ["key", "i", "j"]


def _cells(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by cell (the first columns) put together to whole cells, some `rows` rows at a time."""
    held: list[pa.RecordBatch] = []
    count = 0

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count >= rows:
            all_ = whole()
            cells = [all_.column(c).to_numpy() for c in CELL]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cells])) + 1
            if len(new):
                yield all_.slice(0, new[-1])
                all_ = all_.slice(new[-1])
            held, count = [all_], all_.num_rows
    if count:
        yield whole()


def _verified(similarity: float, x: np.ndarray, y: np.ndarray, ends: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Which pairs x, y of sets (flat[ends[k]:ends[k + 1]], distinct) are similar indeed."""
    out = np.zeros(len(x), bool)
    order = np.argsort(x, kind="stable")
    size, start = np.diff(ends), 0
    mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    while start < len(order):
        own = x[order[start]]
        stop = start + np.searchsorted(x[order[start:]], own, "right")
        mine = flat[ends[own] : ends[own + 1]]
        mark[mine] = True
        for lo in range(start, stop, PAIRS):
            at = order[lo : min(stop, lo + PAIRS)]
            width = size[y[at]]
            stops = np.cumsum(width)
            place = np.repeat(ends[y[at]] - (stops - width), width) + np.arange(width.sum())
            hit = np.r_[0, np.cumsum(mark[flat[place]])]
            both = hit[stops] - hit[stops - width]
            out[at] = both >= similarity * (len(mine) + width - both) - 1e-9
        mark[mine] = False
        start = stop
    return out


def _meet(radius: int, similarity: float, bits: np.ndarray, exact: bool) -> Callable:
    """Searches whole cells for pairs within `radius` bits whose labels differ and whose sizes let them be
    similar, each pair in the first table that brings it together. Gives the rows that are in such a pair;
    with `exact`, which needs the shingles in `s`, a spanning forest of the pairs that are similar indeed."""
    masks = np.zeros((len(bits), WIDE), np.uint64)
    for t, places in enumerate(bits):
        for p in places:
            masks[t, p // 64] |= np.uint64(1) << np.uint64(p % 64)

    def asks(group: np.ndarray, label: np.ndarray, side: np.ndarray) -> np.ndarray:
        """Rows that search: of two different labels of a cell one does."""
        _, first, which, count = np.unique(np.rec.fromarrays([group, label]), return_index=True, return_inverse=True, return_counts=True)
        most = np.lexsort((count, group[first]))
        most = most[np.r_[group[first][most][1:] != group[first][most][:-1], True]]
        return np.where(side == 2, ~np.isin(which, most), side == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cells(batches, CHUNK // 16 if exact else CHUNK):
            group = np.cumsum(np.r_[0, np.logical_or.reduce([np.diff(b.column(c).to_numpy()) != 0 for c in CELL])])
            label, side = (b.column(c).to_numpy() for c in ("label", "side"))
            ask = asks(group, label, side)
            several = np.flatnonzero((np.bincount(group, ask) > 0)[group])
            if not len(several):
                continue
            b, group, label, side, ask = b.take(pa.array(several)), group[several], label[several], side[several], ask[several]
            ids, n, u, table = (b.column(c).to_numpy() for c in ("doc_id", "n", "u", "t"))
            words = np.stack([b.column(w).to_numpy() for w in WORDS], 1).view(np.uint64)
            found = np.zeros(len(ids), bool)
            if exact:
                node, at = np.unique(ids, return_inverse=True)
                joined = np.arange(len(node))
                ends = b.column("s").offsets.to_numpy()
                flat = np.unique(b.column("s").values.to_numpy()[ends[0] : ends[-1]], return_inverse=True)[1]
                ends = ends - ends[0]
            for x, y, _ in GrayIndex(group, words).links(radius, ask=ask):
                ok = (label[x] != label[y]) & ((side[x] == 2) | (side[x] != side[y]))
                x, y = x[ok], y[ok]
                shared = np.minimum(n[x] - u[x], n[y] - u[y])
                ok = shared >= similarity * (n[x] + n[y] - shared) - 1e-9
                x, y = x[ok], y[ok]
                differ, new = words[x] ^ words[y], np.ones(len(x), bool)
                for t in range(int(table[x].max(initial=0))):
                    new &= (table[x] <= t) | ((differ & masks[t]) != 0).any(1)
                x, y = x[new], y[new]
                if not exact:
                    found[x] = found[y] = True
                    continue
                ok = joined[at[x]] != joined[at[y]]
                x, y = x[ok], y[ok]
                ok = _verified(similarity, x, y, ends, flat)
                joined = forest(len(node), iter([(at[x[ok]], at[y[ok]], None)]), joined)
            if not exact:
                yield b.take(pa.array(np.flatnonzero(found)))
                continue
            out = joined != np.arange(len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[out], pa.int64()), pa.array(node[joined[out]], pa.int64())], names=["a", "b"])

    return run


def _majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, m0..: the bits that most rows of a bucket have, of cells sorted by key."""
    for b in _cells(batches, CHUNK):
        keys, first = np.unique(b.column("key").to_numpy(), return_index=True)
        words = np.stack([b.column(w).to_numpy() for w in WORDS], 1)
        own = np.unpackbits(words.view(np.uint8), axis=1).astype(np.int64)
        ends = np.r_[first[1:], len(words)] - first
        most = np.packbits(2 * np.add.reduceat(own, first) > ends[:, None], axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(c)) for c in most.T)], names=["k", *(f"m{k}" for k in range(WIDE))])


def _sets(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 500):
            known: dict[bytes, int] = {}
            sets = [shingle_hashes(t.as_py(), shingle, known) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_total(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["d", "sum", "s"])

    return run


def _cut(keyed: DataFrame, hubs: bool) -> DataFrame:
    """`keyed` with the cells (i, j) of its buckets in which a row takes part, and its side there: rows of
    sides 0 and 1 meet across, rows of side 2 all.

    A bucket of up to GROUP rows is one cell. In a larger one the rows outside its most common label are
    cut into blocks of some GROUP rows, and so are the others; each block of the first meets each block. So
    no cell exceeds some 2 * GROUP rows and no pair of labels is left out. With `hubs` blocks do not meet;
    instead the HUBS rows nearest to the bucket's majority of bits visit each.
    """
    large = stored(keyed.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > GROUP).select(F.col("key").alias("k"), "rows"), "large-buckets")
    one = [F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")]
    if large.isEmpty():
        return keyed.select("*", *one)
    columns, place = keyed.columns, F.xxhash64("doc_id", "total", "t")
    small = keyed.join(large, keyed["key"] == large["k"], "left_anti").select("*", *one)
    if hubs:
        blocks = F.ceil(F.col("rows") / GROUP).cast("int")
        dealt = keyed.join(large, keyed["key"] == large["k"]).select(*columns, blocks.alias("blocks"), F.pmod(place, blocks).cast("int").alias("own"))
        dealt = stored(dealt, "large-rows")
        fields = ", ".join(f"m{k} long" for k in range(WIDE))
        most = dealt.where("own = 0").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), *WORDS)
        most = stored(map_in_arrow(most.repartition("key").sortWithinPartitions("key"), _majority, f"k long, {fields}"), "majorities")
        far = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"m{k}"))) for k, w in enumerate(WORDS)), F.lit(0))
        near = Window.partitionBy("key").orderBy("far", "doc_id", "total", "t")
        hub = dealt.join(most, dealt["key"] == most["k"]).withColumn("far", far).withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= HUBS)
        hub = hub.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("i <> own").select(*columns, "i")
        return small.unionByName(dealt.select(*columns, F.col("own").alias("i")).unionByName(hub).select("*", F.lit(0).alias("j"), F.lit(2).alias("side")))
    own = keyed.join(large, keyed["key"] == large["k"]).groupBy("key", "label").agg(F.count("*").alias("c"))
    own = own.groupBy("key").agg(F.sum("c").alias("rows"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("top"))
    blocks = [F.ceil(x / GROUP).cast("int") for x in (F.col("rows") - F.col("most"), F.col("most"))]
    own = stored(own.select(F.col("key").alias("k"), "top", blocks[0].alias("askers"), blocks[1].alias("others")).where("askers > 0"), "large-blocks")
    dealt = keyed.join(own, keyed["key"] == own["k"])
    mine = F.when(F.col("label") != F.col("top"), F.pmod(place, "askers")).otherwise(F.col("askers") + F.pmod(place, "others")).cast("int")

    def cell(other):
        return F.struct(F.least("mine", other).alias("i"), F.greatest("mine", other).alias("j"), F.when(other == F.col("mine"), 2).when(other > F.col("mine"), 0).otherwise(1).alias("side"))

    last = F.when(F.col("mine") < F.col("askers"), F.col("askers") + F.col("others")).otherwise(F.col("askers")) - 1
    dealt = dealt.withColumn("mine", mine).withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), last), cell)))
    return small.unionByName(dealt.select(*columns, "at.*"))


def similar_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) for every document that has a near copy: classes
    of documents linked by a Jaccard similarity of `similarity` or more over distinct word shingles.

    Candidates share a bucket of at least one table of fingerprint bits; the number of bits follows
    the number of documents and the number of tables the bits, so that a pair at exactly `similarity`
    is missed with probability MISSED at any size, closer ones far more rarely; pairs with a text of up to
    FEW shingles meet over shingles instead, without a miss. In a bucket the Gray-order index finds the
    fingerprints within the expected distance and DEVIATIONS.

    Every such pair is checked exactly before anything is thinned out: a task sends on the rows that have
    candidates, never the pairs; their shingles are brought to the cell, the pairs found there again and
    compared, and a spanning forest of those that are similar goes on. A first search over one in FIRST
    tables joins families of copies, so that the second, over all tables, need only look at pairs of
    different classes. Before that one compares shingles, a count of those that no other candidate has
    bounds what two rows can share.

    Null ids take no part; rows that share an id are one document, similar to what any of its texts is
    similar to; texts with fewer words than a shingle have one shingle, all their words (none: the empty one).
    """
    with collecting() as made:
        out = _classes(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), shingle, similarity)
    # of what was stored on the way only the result's table stays
    drop_paths(df.sparkSession, made[:-1])
    return out


def _classes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """`similar_classes` of rows doc_id long, text string."""
    small_batches(docs.sparkSession)
    most = int(FEW / similarity + 1e-9)
    marks = stored(map_in_arrow(docs, _wide(shingle, most), "doc_id long, " + ", ".join(f"{w} long" for w in WORDS) + ", total long, n int, few array<long>"), "wide-fingerprints")
    alike = [*WORDS, "total", "n"]
    reps = stored(marks.groupBy(*alike).agg(F.min("doc_id").alias("doc_id"), F.first("few").alias("few")), "distinct-sets")
    share = SPREAD * differing(similarity)
    radius = int(64 * WIDE * share + DEVIATIONS * (64 * WIDE * share * (1 - share)) ** 0.5)
    size = max(2, int(np.ceil(np.log2(max(2, marks.count() / BUCKET)))))
    tables = tables_needed(share, size, radius)
    rng = np.random.default_rng(11)
    bits = np.array([rng.choice(64 * WIDE, size, replace=False) for _ in range(tables)])
    seen = marks.select(F.explode("few").alias("x")).groupBy("x").agg(F.count("*").alias("c")).where(F.col("c") > GROUP)
    common = {r.x: r.c for r in seen.orderBy(F.desc("c"), "x").limit(COMMON).collect()}
    row = ["doc_id", "label", "total", "n", "u", *WORDS]

    def met(keyed: DataFrame, radius: int, bits: np.ndarray, exact: bool) -> DataFrame:
        dealt = keyed.repartition(*CELL).sortWithinPartitions(*CELL)
        return map_in_arrow(dealt, _meet(radius, similarity, bits, exact), "a long, b long" if exact else ", ".join(f"{c} {k}" for c, k in dealt.dtypes))

    def keyed(rows: DataFrame, keys: Callable) -> DataFrame:
        return map_in_arrow(rows, keys, "key long, t int, " + ", ".join(f"{c} {k}" for c, k in rows.dtypes))

    def shingles_of(ids: DataFrame) -> DataFrame:
        ids = ids.select(F.col("doc_id").alias("x")).distinct()
        own = may_hold(docs, F.col("doc_id"), ids).where("_may").drop("_may").join(ids, F.col("doc_id") == F.col("x"), "left_semi")
        return stored(map_in_arrow(own, _sets(shingle), "d long, sum long, s array<long>").dropDuplicates(["d", "sum"]), "shingles")

    def search(rows: DataFrame, bits: np.ndarray, first: bool) -> DataFrame:
        """Links between rows of different labels; not all of them if it is the `first` search."""
        short = rows.where(F.col("few").isNotNull()).select(*row, F.col("few").alias("s"))
        links = met(_cut(keyed(short, _few_keys(similarity, common)), first), FAR, bits[:0], True)
        long = rows.where(F.col("n") > FEW).select(*row)
        open_ = stored(met(_cut(keyed(long, _bucket_keys(bits)), first), radius, bits, False), "candidates")
        sets = shingles_of(open_)
        if not first:
            alone = sets.select("d", "sum", F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("c"), F.min(F.struct("d", "sum")).alias("of")).where("c = 1")
            alone = alone.groupBy("of").agg(F.count("*").cast("int").alias("u")).select("of.*", "u")
            ends = open_.select(*(c for c in row if c != "u")).distinct()
            ends = ends.join(alone, (ends["doc_id"] == alone["d"]) & (ends["total"] == alone["sum"]), "left").select(*(F.coalesce("u", F.lit(0)).alias(c) if c == "u" else c for c in row))
            open_ = stored(met(_cut(keyed(stored(ends, "open"), _bucket_keys(bits)), False), radius, bits, False), "candidates")
        whole = open_.join(sets, (open_["doc_id"] == sets["d"]) & (open_["total"] == sets["sum"])).drop("d", "sum")
        return stored(links.unionByName(met(whole, radius, bits, True)), "links")

    def labelled(rows: DataFrame, label: Column) -> DataFrame:
        return rows.select("doc_id", label.alias("label"), "total", "n", F.lit(0).alias("u"), *WORDS, "few")

    same = marks.join(reps.withColumnRenamed("doc_id", "rep"), alike).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    near = stored(search(labelled(reps, F.col("doc_id")), bits[: max(FIRST, tables // FIRST)], True).unionByName(same), "first-links")
    roots = components(near)
    rows = stored(labelled(reps.join(roots, reps["doc_id"] == roots["node"], "left"), F.coalesce("root", "doc_id")), "labels")
    found = components(near.unionByName(search(rows, bits, False)))
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("class_id"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`df` with the document of the least id of each class of near copies; others are kept as they are."""
    gone = similar_classes(df, id_col=id_col, text_col=text_col, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("x"))
    met = may_hold(df, F.col(id_col), gone)
    unsure = met.where("_may").drop("_may")
    return met.where("not _may").drop("_may").unionByName(unsure.join(gone, unsure[id_col].cast("long") == F.col("x"), "left_anti"))
