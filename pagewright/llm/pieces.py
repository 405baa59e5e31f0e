"""SentencePiece encoding and decoding in numpy (operator 9).

Texts are cut where no piece of the vocabulary can lie across; distinct words are encoded once a task,
words of equal length together; hashes of substrings are probed in the sorted keys of the pieces, and
a hit is compared character by character.

A unigram model is encoded by a batched Viterbi: for every end position and piece length, the
vectorised maximum of score so far plus piece score keeps its length as a backpointer; of equal scores
the longest last piece wins.

The scores of a BPE model are merge ranks, whose best sum is not what the model's own encoder gives
(it splits very frequent words), so a Viterbi can't give right ids for it. Its words are merged
instead: again all words of a length advance together, and a vectorised maximum over the scores of
neighbouring symbols picks each word's next merge, the leftmost of equal ones. The model file says
which of the two applies. Characters without a piece become byte pieces, or the unknown piece in a
model without them.

What a task holds at a time does not grow with the texts of a batch: rows go in slices of bounded text, a
longer text is encoded and decoded portion by portion, and the arrays of a step have AT_ONCE characters.

Cases: null texts give no pieces and decode to the empty text; so do empty texts. Very long words are
bounded by their length. With byte pieces decoding is the
exact inverse, a literal U+2581 included, which is encoded as bytes. Repeated rows give repeated
results; an empty table gives none; further columns are kept by `encode` when named.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow, sliced, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal U+2581 while words are encoded: the last, unassigned code point.
MARK = 0x10FFFF
#: Words that a task keeps between batches.
KEPT_WORDS = 200_000
#: Characters of equal-length words that are encoded at once.
AT_ONCE = 1 << 17
#: Bytes of text whose words are looked up together; of a longer text, PORTION // 8 words.
PORTION = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """An encoder and decoder for one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        normal = {1, 4}
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.unknown = next((k for k, p in enumerate(proto.pieces) if p.type == 2), 0)
        self.bytes_of = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_ids = [self.bytes_of.get(f"<0x{b:02X}>") for b in range(256)]
        own = [(p.piece, p.score, k) for k, p in enumerate(proto.pieces) if p.type in normal and p.piece]
        self.table = [p.piece.replace(SPACE, " ").encode() if p.type in normal else b"" for p in proto.pieces]
        for b, k in enumerate(self.byte_ids):
            if k is not None:
                self.table[k] = bytes([b])
        self.table[self.unknown] = " ⁇ ".encode()
        self.longest = max(len(p) for p, _, _ in own)
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in own):
            raise ValueError("a piece crosses a word boundary")
        self.lines = all("\n" not in p or p == "\n" for p, _, _ in own)
        self.cut = re.compile(" *[^ \n]+|\n| +" if self.lines else " *[^ ]+| +")
        letters = np.zeros((len(own), self.longest), np.uint32)
        for k, (p, _, _) in enumerate(own):
            letters[k, : len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(p) for p, _, _ in own])
        keys = np.zeros(len(own), np.uint64)
        for j in range(self.longest):
            keys = np.where(j < lengths, keys * BASE + letters[:, j] + np.uint64(1), keys)
        self.viterbi = proto.trainer_spec.model_type == 1
        order = np.argsort(keys)
        self.keys, self.letters, self.sizes = keys[order], letters[order], lengths[order]
        self.scores, self.ids = np.array([s for _, s, _ in own])[order], np.array([k for _, _, k in own], np.int32)[order]
        order = np.lexsort((keys, lengths))
        self.by_length = {}
        for n in np.unique(lengths):
            at = order[lengths[order] == n]
            self.by_length[int(n)] = (keys[at], letters[at, :n], np.array([own[k][1] for k in at]), np.array([own[k][2] for k in at], np.int32))
        self.penalty = min(s for _, s, _ in own) - 10
        self.kept: dict[str, bytes] = {}

    def _chars(self, c: int) -> list[int]:
        got = [self.byte_ids[b] for b in chr(0x2581 if c == MARK else c).encode()]
        return [self.unknown] if None in got else got

    def _same_length(self, words: list[str], n: int) -> list[bytes]:
        m = len(words)
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(m, n)
        sums = np.zeros((n + 1, m), np.uint64)
        for j in range(n):
            sums[j + 1] = sums[j] * BASE + text[:, j] + np.uint64(1)
        power = np.cumprod(np.full(self.longest + 1, BASE))
        power = np.r_[np.uint64(1), power[:-1]]
        return (self._best if self.viterbi else self._merged)(text, sums, power)

    def _probe(self, text: np.ndarray, sums: np.ndarray, power: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place among the sorted pieces of text[row, lo:hi], -1 where it is none."""
        size = hi - lo
        out = np.full(len(row), -1)
        fits = np.flatnonzero(size <= self.longest)
        want = sums[hi[fits], row[fits]] - sums[lo[fits], row[fits]] * power[size[fits]]
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        hit = (self.keys[at] == want) & (self.sizes[at] == size[fits])
        fits, at = fits[hit], at[hit]
        place = lo[fits][:, None] + np.arange(self.longest)
        inside = np.arange(self.longest) < size[fits][:, None]
        same = (text[row[fits][:, None], np.minimum(place, text.shape[1] - 1)] == self.letters[at]) | ~inside
        ok = same.all(1)
        out[fits[ok]] = at[ok]
        return out

    def _merged(self, text: np.ndarray, sums: np.ndarray, power: np.ndarray) -> list[bytes]:
        m, n = text.shape
        out: list[bytes] = [b""] * m
        row, ends = np.arange(m), np.tile(np.arange(n + 1), (m, 1))

        def scored(r: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            at = self._probe(text, sums, power, r, lo, hi)
            return np.where(at >= 0, self.scores[at], -np.inf)

        score = scored(np.repeat(row, n - 1), ends[:, :-2].ravel(), ends[:, 2:].ravel()).reshape(m, n - 1)
        while len(row):
            k = ends.shape[1] - 1
            if k > 1:
                pick = score.argmax(1)
                done = score[np.arange(len(row)), pick] == -np.inf
            else:
                done = np.ones(len(row), bool)
            if done.any():
                self._emit(text, sums, power, row[done], ends[done], out)
                row, ends = row[~done], ends[~done]
                if not len(row):
                    break
                score, pick = score[~done], pick[~done]
            here = np.arange(len(row))
            keep = np.ones(ends.shape, bool)
            keep[here, pick + 1] = False
            ends = ends[keep].reshape(len(row), k)
            keep = np.ones(score.shape, bool)
            keep[here, pick] = False
            score = score[keep].reshape(len(row), k - 2)
            for at in (pick - 1, pick):
                some = np.flatnonzero((at >= 0) & (at < k - 2))
                if len(some):
                    t = at[some]
                    score[some, t] = scored(row[some], ends[some, t], ends[some, t + 2])
        return out

    def _emit(self, text: np.ndarray, sums: np.ndarray, power: np.ndarray, row: np.ndarray, ends: np.ndarray, out: list[bytes]) -> None:
        k = ends.shape[1] - 1
        flat, lo = np.repeat(row, k), ends[:, :-1].ravel()
        at = self._probe(text, sums, power, flat, lo, ends[:, 1:].ravel())
        ids = np.where(at >= 0, self.ids[at], -1).astype(np.int32).reshape(-1, k)
        for r, own, bad, begin in zip(row.tolist(), ids, (ids < 0).any(1).tolist(), ends):
            if bad:
                own = np.array([x for i, lo in zip(own.tolist(), begin.tolist()) for x in ([i] if i >= 0 else self._chars(int(text[r, lo])))], np.int32)
            out[r] = own.tobytes()

    def _best(self, text: np.ndarray, sums: np.ndarray, power: np.ndarray) -> list[bytes]:
        m, n = text.shape
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0
        back = np.zeros((n + 1, m), np.int32)
        piece = np.full((n + 1, m), -1, np.int32)
        for j in range(1, n + 1):
            for size in range(min(self.longest, j), 0, -1):
                i = j - size
                if size in self.by_length:
                    keys, letters, score, ids = self.by_length[size]
                    want = sums[j] - sums[i] * power[size]
                    at = np.searchsorted(keys, want)
                    at[at == len(keys)] = 0
                    hit = np.flatnonzero(keys[at] == want)
                    if len(hit):
                        k = at[hit]
                        ok = (letters[k] == text[hit, i:j]).all(1)
                        hit, k = hit[ok], k[ok]
                        total = best[i, hit] + score[k]
                        up = total > best[j, hit]
                        hit, k = hit[up], k[up]
                        best[j, hit], back[j, hit], piece[j, hit] = total[up], size, ids[k]
                if size == 1:
                    total = best[i] + self.penalty
                    # a character without a piece of its own; one with a piece scores higher
                    up = total > best[j]
                    best[j, up], back[j, up], piece[j, up] = total[up], 1, -1
        out: list[list[int]] = [[] for _ in range(m)]
        at, rows = np.full(m, n), np.arange(m)
        while len(rows):
            got = piece[at, rows]
            for r, p, j in zip(rows.tolist(), got.tolist(), at.tolist()):
                if p >= 0:
                    out[r].append(p)
                else:
                    out[r].extend(reversed(self._chars(int(text[r, j - 1]))))
            at = at - back[at, rows]
            some = at > 0
            at, rows = at[some], rows[some]
        return [np.array(x[::-1], np.int32).tobytes() for x in out]

    def _segments(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word (spaces still plain), as bytes of 32-bit integers."""
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        out = {}
        for n, own in by.items():
            step = max(1, AT_ONCE // n)
            for lo in range(0, len(own), step):
                some = own[lo : lo + step]
                marked = [w.replace(SPACE, chr(MARK)).replace(" ", SPACE) for w in some]
                out.update(zip(some, self._same_length(marked, n)))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of little-endian 32-bit integers."""
        first = " " if self.prefix else ""
        if sum(len(t) for t in texts if t) <= PORTION:
            return self._looked_up([self.cut.findall(first + t) if t else [] for t in texts])
        if len(texts) > 1:
            return self.encode(texts[: len(texts) // 2]) + self.encode(texts[len(texts) // 2 :])
        found = self.cut.finditer(first + texts[0])
        return [b"".join(iter(lambda: self._looked_up([[m[0] for m in islice(found, PORTION // 8)]])[0], b""))]

    def _looked_up(self, cut: list[list[str]]) -> list[bytes]:
        """The ids of lists of words."""
        new = list({w for words in cut for w in words if w not in self.kept})
        fresh = self._segments(new)
        if len(self.kept) < KEPT_WORDS:
            self.kept.update(zip(new[: KEPT_WORDS - len(self.kept)], map(fresh.__getitem__, new)))
        fresh.update((w, self.kept[w]) for words in cut for w in words if w in self.kept and w not in fresh)
        return [b"".join(map(fresh.__getitem__, words)) for words in cut]

    def decode(self, ids: bytes) -> str:
        whole, step = np.frombuffer(ids, np.int32), PORTION // 8
        parts = (b"".join(map(self.table.__getitem__, whole[lo : lo + step].tolist())) for lo in range(0, len(whole), step))
        text = b"".join(parts).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _codec(model: bytes, check: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(model)
        for b in sliced(batches, 500, PORTION):
            texts = b.column("text").to_pylist()
            coded = own.encode(texts)
            flat = pa.array(np.frombuffer(b"".join(coded), np.int32))
            ends = np.cumsum([0] + [len(x) // 4 for x in coded]).astype(np.int32)
            columns = [*b.columns, pa.ListArray.from_arrays(pa.array(ends), flat)]
            names = [*b.schema.names, "ids"]
            if check:
                decoded = [own.decode(x) for x in coded]
                columns += [pa.array([d == (t or "") for d, t in zip(decoded, texts)]), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded])]
                names += ["round_trip", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(df: DataFrame, keep: list[str], text_col: str = "text", model: str = MODEL, check: bool = True) -> DataFrame:
    """The columns `keep`, text, ids array<int>; with `check` also round_trip (decoding the ids gives the
    text back) and decoded_sha256. Columns of these names in `keep` give way to them. The model file is read
    once on the driver."""
    small_batches(df.sparkSession)
    with open(model, "rb") as f:
        data = f.read()
    keep = [k for k in keep if k not in ("text", "ids", "round_trip", "decoded_sha256")]
    given = df.select(*keep, F.col(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    return map_in_arrow(given, _codec(data, check), f"{schema}, ids array<int>" + (", round_trip boolean, decoded_sha256 string" if check else ""))
