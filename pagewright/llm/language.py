"""Language ID by compression (operator 8).

For each language a few raw-content zstandard dictionaries are cut from a bounded sample of labelled
documents. A text is encoded block by block, whole, with the first dictionary of every language; the
language with the smallest total wins. Each block follows a few slices of the dictionary itself, whose own
size is taken off again: a short text alone would hardly be worth a compressed block, and all languages
would tie. Where the margin between the best and the next is narrow, the
sizes under the next dictionaries are added, one after the other; a margin that stays narrow rejects the
text (it keeps the smallest as its language).

The sample: SAMPLE documents a language, those with the smallest digest of their id, preferably of
200 to SNIPPET bytes (of a longer one SNIPPET characters at most go into a dictionary). It is all
that is fitted, and does not grow with the table.

The dictionaries of all languages go to the driver and along with the tasks, 256 KB a language at most, so
over MOST_LANGUAGES of them are refused.

Cases: null texts and texts without a letter are `und`, score 0, rejected; with no labelled
documents at all every text is `und`; full ties go to the first language by name; repeated rows give
repeated results; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_in_arrow, sliced, small_batches

SAMPLE = 120
SNIPPET = 4000
DICTIONARY = 1 << 16
BLOCK = 4096
#: Slices of the dictionary before each block, and their bytes.
SLICES, SLICE = 12, 16
#: Every text is encoded at this level.
LEVEL = 9
MOST_LANGUAGES = 1000
#: A best size within this share of the next is a narrow margin.
NARROW = 0.002
OUT = ("lang_pred", "score", "rejected")
LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """The runs of letters of a text, lower case."""
    # the pattern also lets through numerals such as ½, which are no letters
    found = LETTERS.findall(text.lower())
    return found if all(map(str.isalpha, found)) else [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


def plain(text: str) -> bytes:
    """The words of a text, lower case, letters only, a space before and after each: markup and digits,
    which tell no language, cost nothing."""
    own = words(text)
    return f" {' '.join(own)} ".encode() if own else b""


def vocabulary(text: str) -> bytes:
    """The distinct words of a text as `plain` gives them, in order of appearance: a dictionary needs no word twice."""
    own = dict.fromkeys(words(text))
    return f" {' '.join(own)} ".encode() if own else b""


def learn(df: DataFrame, rows: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[bytes]]:
    """Dictionaries by language, from the rows of `df` for which `rows` holds."""
    fit = df.where(rows & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    long = F.octet_length(text_col)
    order = Window.partitionBy("lang").orderBy((~long.between(200, SNIPPET)).cast("int"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), text_col)
    ranked = fit.select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, SNIPPET).alias("text"), F.row_number().over(order).alias("rank"))
    if fit.select(lang_col).distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    out: dict[str, list[bytes]] = {}
    for r in sorted(ranked.where(F.col("rank") <= SAMPLE).collect(), key=lambda r: (r.lang, r["rank"])):
        out.setdefault(r.lang, []).append(vocabulary(r.text))
    return {k: _cut(b"".join(v)) for k, v in out.items()}


def _cut(whole: bytes) -> list[bytes]:
    """One to four dictionaries of up to DICTIONARY bytes."""
    parts = [whole[lo : lo + DICTIONARY] for lo in range(0, min(len(whole), 4 * DICTIONARY), DICTIONARY)]
    return [p for p in parts if len(p) >= 8] or [whole.ljust(8)]


def lead(raw: bytes) -> bytes:
    """What stands before each block."""
    return b"".join(raw[at : at + SLICE] for at in (k * len(raw) // (SLICES + 1) for k in range(1, SLICES + 1)))


class Classifier:
    def __init__(self, dictionaries: dict[str, list[bytes]]):
        self.names = sorted(dictionaries)
        least = min((len(x) for x in dictionaries.values()), default=0)
        self.coders = [[self._coder(dictionaries[n][k]) for n in self.names] for k in range(least)]

    @staticmethod
    def _coder(raw: bytes) -> Callable[[list[bytes]], int]:
        """What gives the bytes that blocks add."""
        d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        encode = zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        first = lead(raw)
        own = len(encode(first))
        return lambda blocks: sum(len(encode(first + b)) - own for b in blocks)

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        data = plain(text) if text else b""
        if not data or not self.names:
            return "und", 0.0, True
        if len(self.names) == 1:
            return self.names[0], 1.0, False
        blocks = [data[lo : lo + BLOCK] for lo in range(0, len(data), BLOCK)]
        size, margin = [0] * len(self.names), 0.0
        for coders in self.coders:
            size = [s + f(blocks) for s, f in zip(size, coders)]
            best, next_ = sorted(size)[:2]
            margin = (next_ - best) / max(1, next_)
            if margin >= NARROW:
                break
        return self.names[size.index(min(size))], min(1.0, margin / (margin + 0.05)), margin < NARROW


def _classify(dictionaries: dict[str, list[bytes]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(dictionaries)
        for b in sliced(batches, 2000):
            got = [own.classify(t.as_py()) for t in b.column(b.num_columns - 1)]
            lang, score, rejected = zip(*got) if got else ((), (), ())
            keep = [b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(lang, pa.string()), pa.array(np.array(score, float)), pa.array(rejected, pa.bool_())], names=[*b.schema.names[:-1], *OUT])

    return run


def predict(df: DataFrame, dictionaries: dict[str, list[bytes]], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred, score and rejected (columns of these names are not kept)."""
    small_batches(df.sparkSession)
    keep = [c for c in keep if c not in OUT]
    given = df.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return map_in_arrow(given, _classify(dictionaries), f"{schema}, lang_pred string, score double, rejected boolean")
