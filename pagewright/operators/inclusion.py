"""What is read: reading modes, overrides, summaries. A region is never deleted, only flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORY_OF, DEFAULT_CATEGORIES, EXCLUDABLE, HIGH, MEDIUM
from ..functions.text import round_half_up, trim, word_count


def _category(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in CATEGORY_OF.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def decide(kind: Column, confidence: Column, override: Column, mode: str, categories: dict[str, bool] | None = None) -> Column:
    """struct(included, reason, uncertain) for a region."""
    on = DEFAULT_CATEGORIES | (categories or {})
    said = lambda included, reason, uncertain=False: F.struct(F.lit(included).alias("included"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), (F.lit(uncertain) if isinstance(uncertain, bool) else uncertain).alias("uncertain"))
    percent = round_half_up(confidence * 100).cast("string")
    out = F.when(override == "include", said(True, "You chose to include this region.")).when(override == "exclude", said(False, "You chose to exclude this region."))
    if mode == "strict-verbatim":
        return out.otherwise(said(True, "Strict Verbatim Mode reads all extractable text, including headers, footers and references."))
    if mode == "custom":
        category = _category(kind)
        for name in dict.fromkeys(CATEGORY_OF.values()):
            out = out.when(category == name, said(on[name], f'Custom Mode: the "{name}" category is switched {"on" if on[name] else "off"}.'))
        return out.otherwise(said(True, "Body content is always read in Custom Mode."))
    body = said(True, F.concat(F.lit("Classified as "), kind, F.lit(", which Clean Mode always reads.")), confidence < MEDIUM)
    sure = said(False, F.concat(F.lit("Detected as "), kind, F.lit(" with "), percent, F.lit("% confidence, above the 80% threshold for automatic exclusion. You can restore it at any time.")))
    maybe = said(True, F.concat(F.lit("Possibly "), kind, F.lit(" ("), percent, F.lit("% confidence), which is below the automatic-exclusion threshold. It is still being read and has been flagged for your review.")), True)
    weak = said(True, F.concat(F.lit("Weak "), kind, F.lit(" signal ("), percent, F.lit("% confidence). Treated as body content and read.")))
    return out.when(~kind.isin(*EXCLUDABLE), body).when(confidence >= HIGH, sure).when(confidence >= MEDIUM, maybe).otherwise(weak)


def apply_mode(regions: DataFrame, mode: str, categories: dict[str, bool] | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Regions with included, inclusion_reason and uncertain; overrides: document_id, id, override."""
    if overrides is None:
        out = regions.withColumn("user_override", F.lit(None).cast("string"))
    else:
        o = overrides.select(F.col("document_id").alias("_d"), F.col("id").alias("_i"), F.col("override").alias("_o"))
        out = regions.join(o, (regions["document_id"] == o["_d"]) & (regions["id"] == o["_i"]), "left").withColumn("user_override", F.col("_o")).drop("_d", "_i", "_o")
    out = out.withColumn("_said", decide(F.col("type"), F.col("confidence"), F.col("user_override"), mode, categories))
    return out.withColumns({"included": F.col("_said.included"), "inclusion_reason": F.col("_said.reason"), "uncertain": F.col("_said.uncertain")}).drop("_said")


def exclusion_summary(applied: DataFrame, by_type: bool = False) -> DataFrame:
    """Regions and words in and out by document; with `by_type` those out by type."""
    w = word_count(F.col("text"))
    if by_type:
        return applied.where(~F.col("included")).groupBy("document_id", "type").agg(F.count("*").alias("regions"), F.sum(w).cast("long").alias("words"))
    inside = F.col("included")
    return applied.groupBy("document_id").agg(
        F.count_if(inside).alias("included_regions"), F.count_if(~inside).alias("excluded_regions"),
        F.sum(F.when(inside, w).otherwise(0)).cast("long").alias("included_words"), F.sum(F.when(~inside, w).otherwise(0)).cast("long").alias("excluded_words"),
    )


def exclusion_rollup(applied: DataFrame) -> DataFrame:
    """Totals of what is left out, by document and type, by document, and over all."""
    w = word_count(F.col("text"))
    return applied.where(~F.col("included")).rollup("document_id", "type").agg(F.count("*").alias("regions"), F.sum(w).cast("long").alias("words"))


def uncertain_regions(applied: DataFrame) -> DataFrame:
    """Included regions to review: between the thresholds, not overridden, no body text."""
    sure = ~F.col("type").isin("paragraph", "heading")
    return applied.where(F.col("included") & F.col("user_override").isNull() & (F.col("confidence") >= 0.5) & (F.col("confidence") < 0.8) & sure)


def set_overrides(overrides: DataFrame, changes: DataFrame) -> DataFrame:
    """Overrides after changes (document_id, id, override); a null override clears one."""
    kept = overrides.join(changes, ["document_id", "id"], "left_anti")
    return kept.unionByName(changes.where("override is not null").select(*overrides.columns))


def restore_all(overrides: DataFrame, excluded: DataFrame) -> DataFrame:
    """An override to include for every region that is left out now."""
    return set_overrides(overrides, excluded.where(~F.col("included")).select("document_id", "id", F.lit("include").alias("override")))


def reset(overrides: DataFrame) -> DataFrame:
    return overrides.limit(0)


def review_tab(applied: DataFrame, tab: str) -> DataFrame:
    return {"excluded": lambda: applied.where(~F.col("included")), "uncertain": lambda: uncertain_regions(applied), "included": lambda: applied.where("included"), "all": lambda: applied}[tab]()


def blank_regions(regions: DataFrame) -> DataFrame:
    return regions.where(trim(F.col("text")) == "")
