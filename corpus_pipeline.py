"""Corpus pipeline: language ID, exact dedup, near dedup, source mix, tokens.

Each stage reads what the one before has written. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import content_sort, language, mixing, pieces, simhash
from pagewright.llm.common import collecting, crc_remainder, documents, drop_paths, stored


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: null, without a letter, or undecided between languages.
    The languages are learned as in operator 8; where nothing can be learned all documents go. Repeated
    rows share their fate; further columns, whatever their names, are kept."""
    learned = language.learn(docs, crc_remainder(F.col("doc_id"), 5) != 0)
    marked = docs.withColumns({f"_in_{c}": F.col(c) for c in docs.columns})
    got = language.predict(marked, learned, [f"_in_{c}" for c in docs.columns])
    return got.where(~F.col("rejected")).select(*(F.col(f"_in_{c}").alias(c) for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the one with the smallest id (a null id counts as
    the largest; null text as empty). Of repeated rows one stays; further columns are kept."""
    return content_sort.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (shingles of five words, similarity 0.8) the document with the smallest
    id stays. Rows with a null id are kept; rows that share an id are one document and stay or go together;
    null and empty texts are copies of each other; further columns are kept."""
    return simhash.drop_near_copies(docs, shingle=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their targets, in the order of the schedule: a document as often as the mix takes its
    words. Null is a source of its own; texts without a word are never taken; rows that share id, source
    and size share what is taken of them; further columns are kept."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces, whether decoding gives the text back, and its digest.
    Null and empty texts have no ids; columns named ids, round_trip or decoded_sha256 give way to these;
    further columns are kept."""
    return pieces.encode(docs, docs.columns)


STAGES = [
    ("language ID", identify),
    ("exact dedup", exact),
    ("near dedup", near),
    ("source mix", mix),
    ("sentencepiece", tokens),
]
#: Fingerprint buckets and merges are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        with collecting() as made:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # a stage's rows stand alone once they are written: all that was stored before them goes
        drop_paths(spark, [*done, *made[:-1]])
        done = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
