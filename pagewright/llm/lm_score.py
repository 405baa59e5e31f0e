"""LM scoring by subword lattice likelihood (operator 3).

A document is its words (ASCII lower case) and an end. The probability of a token sums over all ways to
write it in pieces of an existing vocabulary, or, for a word seen in training, as that word:

    P(end) = (c_end + 1) / (N + 2)
    P(w)   = (max(c_w - D, 0) + (D * V + 1) * Q(w)) / (N + 2)

N tokens, V distinct words and D (absolute discount, from the counts of words seen once and twice)
come from all training documents. Q(w) sums the products of piece probabilities over all
segmentations of w by a forward recursion in log space; a piece sequence ends with an end piece, so Q
is a distribution. The vocabulary's own scores are the start; ROUNDS of expectation-maximisation over
all distinct training words fit the piece probabilities (one number a piece comes back each round).

A document's tokens are drawn from an urn that starts with ALPHA balls in these proportions and gets
a further ball of each token drawn, since words recur within a document. The marginal probability of
the document is then G(A) / G(A + T) * prod_w G(A P(w) + n_w) / G(A P(w)), with G the gamma function,
T tokens and n_w uses of w; it needs no order and so adds up word by word.

lattice_score is the plain marginal without counts and urn: every word by Q alone, P(end) as above.

Counts are pre-aggregated in tasks, then by word. Words that make up 1/COMMON of all tokens or more
(so COMMON at most) go along with the tasks; all others are joined by word, so no word is hot.

Cases: a null or blank text is its end alone; without training documents c, N and V are 0, and words
are scored by Q; rows that repeat an id are documents of their own; very long words are scored like
others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .pieces import MODEL, SPACE

ROUNDS = 3
#: Balls the urn starts with; larger: words recur less.
ALPHA = 2000.0
COMMON = 50_000
#: Distinct words that a task counts before it sends them on.
HELD = 200_000
#: Bytes of equal-length words that a lattice handles at once.
AT_ONCE = 1 << 17
END = b" "  # no word has a space
BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(model: bytes) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a space for the word mark), the 256 single bytes among them, and the natural
    logarithm of the share that the model's own scores give each."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    unigram = proto.trainer_spec.model_type == 1
    weight: dict[bytes, float] = {}
    for p in proto.pieces:
        piece = p.piece.replace(SPACE, " ").encode()
        if p.type == 1 and piece.strip(b" ") or piece == b" ":
            # scores of a merge list are negative ranks, whose frequencies fall off as 1 / rank
            weight[piece] = math.exp(p.score) if unigram else 1 / (2 - p.score)
    least = min(weight.values())
    for b in range(256):
        weight.setdefault(bytes([b]), least)
    pieces = sorted(weight)
    share = np.array([weight[p] for p in pieces])
    return pieces, np.log(share / share.sum())


class Lattice:
    """All segmentations of words over pieces with log probabilities `score`; `end` is the log
    probability that a piece sequence stops."""

    def __init__(self, pieces: list[bytes], score: np.ndarray, end: float):
        self.n, self.longest = len(pieces), max(map(len, pieces))
        size = np.array([len(p) for p in pieces])
        text = np.zeros((self.n, self.longest), np.uint8)
        for k, p in enumerate(pieces):
            text[k, : len(p)] = np.frombuffer(p, np.uint8)
        keys = np.zeros(self.n, np.uint64)
        for j in range(self.longest):
            keys = np.where(j < size, keys * BASE + text[:, j] + np.uint64(1), keys)
        order = np.argsort(keys)
        self.keys, self.text, self.size, self.order = keys[order], text[order], size[order], order
        self.score, self.end = score[order], end
        self.sizes = [int(x) for x in np.unique(size)]
        #: Which top bits any key has: most substrings are no piece and go no further.
        self.some = np.zeros(1 << 18, bool)
        self.some[(self.keys >> np.uint64(46)).astype(np.int64)] = True

    def _arcs(self, text: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end position, (start, rows, pieces)."""
        n, m = text.shape
        sums = np.zeros((n + 1, m), np.uint64)
        for j in range(n):
            sums[j + 1] = sums[j] * BASE + text[j] + np.uint64(1)
        power = np.r_[np.uint64(1), np.cumprod(np.full(self.longest, BASE))]
        out: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[]]
        for j in range(1, n + 1):
            here = []
            for s in self.sizes:
                if s > j:
                    break
                want = sums[j] - sums[j - s] * power[s]
                row = np.flatnonzero(self.some[(want >> np.uint64(46)).astype(np.int64)])
                if not len(row):
                    continue
                at = np.searchsorted(self.keys, want[row])
                at[at == self.n] = 0
                ok = (self.keys[at] == want[row]) & (self.size[at] == s)
                row, at = row[ok], at[ok]
                if len(row):
                    ok = (self.text[at, :s] == text[j - s : j, row].T).all(1)
                    here.append((j - s, row[ok], at[ok]))
            out.append(here)
        return out

    def _forward(self, arcs: list, m: int) -> np.ndarray:
        a = np.full((len(arcs), m), -np.inf)
        a[0] = 0
        for j, here in enumerate(arcs):
            for i, row, at in here:
                a[j, row] = np.logaddexp(a[j, row], a[i, row] + self.score[at])
        return a

    def _batches(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of words of one length, and their bytes (with the word mark), position by position."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(k)
        for n, at in by.items():
            step = max(1, AT_ONCE // n)
            for lo in range(0, len(at), step):
                some = at[lo : lo + step]
                flat = np.frombuffer(b"".join(b" " + words[k] for k in some), np.uint8)
                yield np.array(some), np.ascontiguousarray(flat.reshape(len(some), n).T)

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of Q of each word: the marginal over all its segmentations."""
        out = np.zeros(len(words))
        for at, text in self._batches(words):
            out[at] = self._forward(self._arcs(text), len(at))[-1] + self.end
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of each piece in one copy of each word; at the end the number of words."""
        out = np.zeros(self.n + 1)
        for at, text in self._batches(words):
            arcs = self._arcs(text)
            m, n = len(at), len(arcs) - 1
            a = self._forward(arcs, m)
            b = np.full((n + 1, m), -np.inf)
            b[n] = 0
            used, share = [], []
            for j in range(n, 0, -1):
                for i, row, k in arcs[j]:
                    through = self.score[k] + b[j, row]
                    used.append(k)
                    share.append(a[i, row] + through - a[n, row])
                    b[i, row] = np.logaddexp(b[i, row], through)
            out[self.order] += np.bincount(np.concatenate(used), np.exp(np.concatenate(share)), minlength=self.n)
            out[-1] += m
        return out


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


_COUNTS = "word binary, c long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training and total counts of the words of many documents."""
    train, every = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        words = list(every)
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([train[w] for w in words], pa.int64()), pa.array(list(every.values()), pa.int64())], names=["word", "c", "n"])
        train.clear()
        every.clear()
        return out

    for b in batches:
        for t, held in zip(b.column("text"), b.column("held_out").to_pylist()):
            words = _words(t.as_py())
            words.append(END)
            every.update(words)
            if not held:
                train.update(words)
            if len(every) >= HELD:
                yield flush()
    yield flush()


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 50_000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Small batches put together: words of equal length are worth their while by the thousand."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _expect(pieces: list[bytes], score: np.ndarray, end: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Lattice(pieces, score, end), np.zeros(len(pieces) + 1)
        for b in _gathered(batches):
            total += own.expected(b.column("word").to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["piece", "uses"])

    return run


def _measure(pieces: list[bytes], score: np.ndarray, end: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(pieces, score, end)
        for b in _gathered(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.log_probability(b.column("word").to_pylist()))], names=["word", "c", "n", "q"])

    return run


def fit(counts: DataFrame, model: bytes, rounds: int = ROUNDS) -> tuple[list[bytes], np.ndarray, float]:
    """Piece probabilities (natural logarithms) from the distinct training words."""
    pieces, score = vocabulary(model)
    end = math.log(0.25)
    score = score + math.log(0.75)
    words = counts.where((F.col("c") > 0) & (F.col("word") != F.lit(END))).select("word")
    for _ in range(rounds):
        # a number a piece at most
        got = words.mapInArrow(_expect(pieces, score, end), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.full(len(pieces) + 1, 0.01)
        for r in got:
            uses[r.piece] += r.uses
        share = np.log(uses / uses.sum())
        score, end = share[:-1], float(share[-1])
    return pieces, score, end


class _Table:
    """Scores of tokens: base and model, logarithms to base 10."""

    def __init__(self, n: int, v: int, d: float):
        self.n, self.v, self.d = n, v, d

    def base(self, c: Column) -> Column:
        return F.log10((c + F.lit(0.5)) / F.lit(self.n + 0.5 * (self.v + 1)))

    def log(self, c: Column, q: Column, word: Column) -> Column:
        """Natural logarithm of P."""
        seen = max(0, self.v - 1)
        p = (F.greatest(c - F.lit(self.d), F.lit(0.0)) + F.lit(self.d * seen + 1) * F.exp(q)) / F.lit(self.n + 2.0)
        # a very long word's q is too small for exp
        low = q + F.lit(math.log((self.d * seen + 1) / (self.n + 2.0)))
        return F.when(word == F.lit(END), F.log((c + 1) / F.lit(self.n + 2.0))).when((c == 0) | (p == 0), low).otherwise(F.log(p))


def log_gamma(x: Column) -> Column:
    """For x >= 1, by Stirling's series at x + 6."""
    y = x + 6
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - F.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def _uses(log_p: float, n: int) -> float:
    """Logarithm of G(A P + n) / G(A P)."""
    first = math.log(ALPHA) + log_p
    if n == 1:
        return first
    a = ALPHA * math.exp(log_p)
    return first + math.lgamma(a + n) - math.lgamma(a + 1)


_RARE = "doc_id long, mark long, held_out boolean, tokens long, known long, base double, score double, lattice double, word binary, tf long"


def _split(common: dict[bytes, tuple[int, float, float, float]]) -> Callable:
    """A row for each document with what its common words add up to, and one for each other word. The
    former have tokens, and in place of a word what no word can be, different by document, so that the
    join by word deals them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, words, times, counts, sums = b.num_rows, [], [], [], []
            for t in b.column("text"):
                tf = Counter(_words(t.as_py()))
                tf[END] += 1
                known, base, uses, plain, rare = 0, [], [], [], []
                for w, k in tf.items():
                    if got := common.get(w):
                        known += k if got[0] else 0
                        base.append(k * got[1])
                        uses.append(_uses(got[2], k))
                        plain.append(k * got[3])
                    else:
                        rare.append(w)
                sums.append((sum(tf.values()), known, math.fsum(base), math.fsum(uses), math.fsum(plain)))
                words += rare
                times += map(tf.__getitem__, rare)
                counts.append(len(rare))
            if not n:
                continue
            at = pa.array(np.r_[np.arange(n), np.repeat(np.arange(n), counts)])
            own = [pa.array(np.r_[np.array(c), np.zeros(len(words), type(c[0]))]) for c in zip(*sums)]
            given = [b.column(k).take(at) for k in ("doc_id", "mark", "held_out")]
            tf = pa.array(np.r_[np.ones(n, np.int64), np.array(times, np.int64)])
            yield pa.RecordBatch.from_arrays([*given, *own, pa.array([b"  %d" % m for m in b.column("mark").to_pylist()] + words, pa.binary()), tf], names=[c.split()[0] for c in _RARE.split(", ")])

    return run


def score(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score for every row of `df`."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    counts = stored(docs.select("held_out", "text").mapInArrow(_count, _COUNTS).groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "word-counts")
    once = [F.sum((F.col("c") == k).cast("long")) for k in (1, 2)]
    ends = F.sum(F.when(F.col("word") == F.lit(END), F.col("c")))
    n, v, total, n_end, n1, n2 = (x or 0 for x in counts.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long")), F.sum("n"), ends, *once).first())
    table = _Table(n, v, n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)
    with open(model, "rb") as f:
        pieces, piece_score, end = fit(counts, f.read(), rounds)
    measured = counts.mapInArrow(_measure(pieces, piece_score, end), f"{_COUNTS}, q double")
    p_end = (n_end + 1) / (n + 2)
    plain = F.when(F.col("word") == F.lit(END), math.log(p_end)).otherwise(F.col("q") + math.log1p(-p_end))
    words = stored(measured.select("word", "c", "n", table.base(F.col("c")).alias("w_base"), table.log(F.col("c"), F.col("q"), F.col("word")).alias("w_log"), plain.alias("w_lat")), "word-scores")
    often = F.col("n") * COMMON >= total
    # words with 1/COMMON of all tokens each: COMMON at most
    common = {bytes(r.word): (r.c, r.w_base, r.w_log, r.w_lat) for r in words.where(often).collect()}
    split = docs.select("doc_id", F.xxhash64("text").alias("mark"), "held_out", "text").mapInArrow(_split(common), _RARE)
    rare = words.where(~often).select(F.col("word").alias("w"), "c", "w_base", "w_log", "w_lat")
    near = split.join(rare, split["word"] == rare["w"], "left")
    k, balls = F.col("tf"), ALPHA * F.exp("w_log")
    again = F.when(k == 1, F.lit(0.0)).otherwise(log_gamma(balls + k) - log_gamma(balls + 1))
    uses = math.log(ALPHA) + F.col("w_log") + again
    out = near.groupBy("doc_id", "mark", "held_out").agg(
        F.sum(F.when(F.col("tokens") > 0, 1).otherwise(0)).alias("copies"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.col("known") + F.when(F.col("c") > 0, k).otherwise(0)).alias("known"),
        F.sum(F.col("base") + F.coalesce(k * F.col("w_base"), F.lit(0.0))).alias("base"),
        F.sum(F.col("score") + F.coalesce(uses, F.lit(0.0))).alias("score"),
        F.sum(F.col("lattice") + F.coalesce(k * F.col("w_lat"), F.lit(0.0))).alias("lattice"),
    )
    each = F.explode(F.expr("sequence(1, cast(copies as int))"))
    m = F.col("copies")
    return out.withColumn("_k", each).select(
        "doc_id",
        "held_out",
        (F.col("tokens") / m).cast("long").alias("n_tokens"),
        (F.col("known") / m).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / m).alias("base_score"),
        ((F.col("score") / m + math.lgamma(ALPHA) - log_gamma(ALPHA + F.col("tokens") / m)) / math.log(10)).alias("score"),
        (F.col("lattice") / m / math.log(10)).alias("lattice_score"),
    )
