"""Key-value stores as append-only Parquet, the latest row of a key being its value."""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_SETTINGS


class Store:
    """Rows by key: puts and deletes append, `load` reads the last of each key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "fingerprint"):
        self.spark, self.path, self.key = spark, path, key
        self.schema = f"{schema}, _at double, _gone boolean"

    def put(self, rows: DataFrame, at: float) -> None:
        rows.withColumns({"_at": F.lit(float(at)), "_gone": F.lit(False)}).write.mode("append").parquet(self.path)

    def delete(self, keys: DataFrame, at: float) -> None:
        names = [c.strip().split()[0] for c in self.schema.split(", ")]
        kinds = dict(self.spark.createDataFrame([], self.schema).dtypes)
        gone = keys.select(*(F.col(self.key) if n == self.key else F.lit(float(at)).alias(n) if n == "_at" else F.lit(True).alias(n) if n == "_gone" else F.lit(None).cast(kinds[n]).alias(n) for n in names))
        gone.write.mode("append").parquet(self.path)

    def clear(self, at: float) -> int:
        held = self.load()
        n = held.count()
        self.delete(held.select(self.key), at)
        return n

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.schema)
            raise

    def load(self) -> DataFrame:
        return latest(self.log(), self.key, "_at").where("not _gone").drop("_at", "_gone")


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key, by partial aggregates rather than a window."""
    names = rows.columns
    by = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(at, F.xxhash64(*names))).alias("v"))
    return by.select("v.*")


def recent(positions: DataFrame, limit: int = 10) -> DataFrame:
    return positions.orderBy(F.desc("last_opened_at"), "fingerprint").limit(limit)


def usage(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("used_bytes"), F.count("*").alias("entries"))


def merge_settings(stored: dict | None) -> dict:
    """Stored settings over the defaults, group by group; an older shape lacks some."""
    out = copy.deepcopy(DEFAULT_SETTINGS)
    for k, v in (stored or {}).items():
        out[k] = {**out[k], **v} if isinstance(out.get(k), dict) and isinstance(v, dict) and k != "region_overrides" else v
    out["region_overrides"] = dict((stored or {}).get("region_overrides") or {})
    return out
