"""Recognised pages: words, corrections, and their way into a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_PAGE = ["document_id", "page_number"]
_WORD = [*_PAGE, "word_index"]
LOW = 0.75
VISION = (
    "struct<text:string,pages:array<struct<property:struct<detectedLanguages:array<struct<languageCode:string>>>,blocks:array<struct<paragraphs:array<struct<words:array<struct<confidence:double,"
    "symbols:array<struct<text:string>>,boundingBox:struct<vertices:array<struct<x:double,y:double>>,normalizedVertices:array<struct<x:double,y:double>>>>>>>>>>>>"
)


def low_confidence(words: DataFrame) -> DataFrame:
    """Word indexes below the threshold, by page, in order."""
    return words.groupBy(*_PAGE).agg(F.array_sort(F.collect_list(F.when(F.col("confidence") < LOW, F.col("word_index")))).alias("low_confidence_word_indexes"))


def flatten_annotation(answers: DataFrame, col: str = "annotation") -> DataFrame:
    """Words of a recogniser's JSON answers (document_id, page_number, annotation), in order: symbols put
    together, boxes from the corners, unknown confidence 0."""
    tree = answers.select(*_PAGE, F.from_json(col, VISION).alias("a"))
    inside = lambda c, f: F.flatten(F.filter(F.transform(c, f), lambda x: x.isNotNull()))
    words = inside(F.col("a.pages"), lambda p: inside(p["blocks"], lambda b: inside(b["paragraphs"], lambda q: q["words"])))
    each = tree.select(*_PAGE, F.posexplode(words).alias("k", "w"))
    text = F.array_join(F.transform("w.symbols", lambda s: F.coalesce(s["text"], F.lit(""))), "")
    plain = F.col("w.boundingBox.vertices")
    corners = F.when(F.size(plain) > 0, plain).otherwise(F.col("w.boundingBox.normalizedVertices"))
    side = lambda c: F.transform(corners, lambda v: F.coalesce(v[c], F.lit(0.0)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = each.select(
        *_PAGE, "k", F.coalesce(text, F.lit("")).alias("text"), zero(F.col("w.confidence")).alias("confidence"), zero(F.array_min(side("x"))).alias("x"), zero(F.array_min(side("y"))).alias("y"),
        zero(F.array_max(side("x")) - F.array_min(side("x"))).alias("width"), zero(F.array_max(side("y")) - F.array_min(side("y"))).alias("height"),
    ).where("text <> ''")
    return out.withColumn("word_index", F.row_number().over(Window.partitionBy(*_PAGE).orderBy("k")) - 1).drop("k")


def page_confidence(words: DataFrame) -> DataFrame:
    return words.groupBy(*_PAGE).agg(F.avg("confidence").alias("confidence"))


def dominant_language(answers: DataFrame, col: str = "annotation") -> DataFrame:
    codes = F.filter(F.transform(F.from_json(col, VISION)["pages"], lambda p: F.get(p["property"]["detectedLanguages"], F.lit(0))["languageCode"]), lambda c: F.coalesce(c, F.lit("")) != "")
    return answers.select(*_PAGE, F.get(codes, F.lit(0)).alias("language"))


def last_corrections(corrections: DataFrame) -> DataFrame:
    """The last correction of each word; one that says nothing, or what was there, takes itself back."""
    last = corrections.groupBy(*_WORD).agg(F.max_by(F.struct("original", "corrected"), "corrected_at").alias("c"))
    kept = (F.trim("c.corrected") != "") & (F.col("c.corrected") != F.col("c.original"))
    return last.where(kept).select(*_WORD, "c.original", "c.corrected")


def effective_words(words: DataFrame, corrections: DataFrame) -> DataFrame:
    """Words with their text after corrections; corrections of words that are not there do nothing."""
    last = corrections.groupBy(*_WORD).agg(F.max_by("corrected", "corrected_at").alias("corrected"))
    return words.join(last, _WORD, "left").withColumn("text", F.coalesce("corrected", "text")).drop("corrected")


def to_items(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Source items in page space from words in image pixels. pages: render_scale, page_width, page_height."""
    scale = F.when(F.col("render_scale") > 0, F.col("render_scale")).otherwise(1.0)
    met = words.join(pages.select(*_PAGE, "render_scale", "page_height"), _PAGE).withColumn("s", scale)
    high, x, y = F.col("height") / F.col("s"), F.col("x") / F.col("s"), F.col("page_height") - (F.col("y") + F.col("height")) / F.col("s")
    zero = F.lit(0.0)
    return met.select(*_PAGE, F.col("word_index").alias("source_index"), "text", F.lit("ltr").alias("dir"), (F.col("width") / F.col("s")).alias("width"), high.alias("height"), F.array(high, zero, zero, high, x, y).alias("transform"), F.lit(None).cast("string").alias("font_name"), F.lit(None).cast("boolean").alias("has_eol"))


def page_summary(words: DataFrame, corrections: DataFrame, pages: DataFrame) -> DataFrame:
    """Words, those still in doubt, corrections and confidence of each recognised page."""
    fixed = corrections.select(*_WORD).distinct().withColumn("fixed", F.lit(True))
    doubt = (F.col("confidence") < LOW) & F.col("fixed").isNull()
    by = words.join(fixed, _WORD, "left").groupBy(*_PAGE).agg(F.count("*").alias("words"), F.count_if(doubt).alias("low_confidence"))
    n = corrections.groupBy(*_PAGE).agg(F.count("*").alias("corrected"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = pages.select(*_PAGE, "provider", "confidence").join(by, _PAGE, "left").join(n, _PAGE, "left")
    return out.select(*_PAGE, "provider", "confidence", zero("words"), zero("low_confidence"), zero("corrected"), (F.coalesce("words", F.lit(0)) == 0).alias("empty"))


def remaining_low(words: DataFrame, corrections: DataFrame) -> DataFrame:
    return words.where(F.col("confidence") < LOW).join(corrections.select(*_WORD).distinct(), _WORD, "left_anti").select(*_WORD)


def provenance(summary_confidence: Column, provider: Column, low: Column, page: Column) -> Column:
    doubt = F.when(low > 0, F.format_string(", with %d word(s) the recogniser was unsure of.", low)).otherwise(".")
    return F.concat(F.format_string("Read from an image of page %d by \"%s\", not from the PDF's text layer. Average confidence %.0f%%", page, provider, summary_confidence * 100), doubt)


def splice(base: DataFrame, recognized: DataFrame, done: DataFrame) -> DataFrame:
    """`base` with the rows of the pages in `done` (document_id, page_number) replaced by `recognized`."""
    return base.join(done.select(*_PAGE).distinct(), _PAGE, "left_anti").unionByName(recognized.join(done.select(*_PAGE).distinct(), _PAGE, "left_semi"), allowMissingColumns=True)


def splice_regions(base: DataFrame, recognized: DataFrame, summary: DataFrame) -> DataFrame:
    """Regions with recognised pages in place: their confidence is the recogniser's at most, and each says
    where it comes from. summary from `page_summary`, for accepted pages that are not empty."""
    own = summary.select(*_PAGE, F.col("confidence").alias("_c"), F.col("provider").alias("_p"), F.col("low_confidence").alias("_l"))
    met = recognized.join(own, _PAGE)
    said = provenance(F.col("_c"), F.col("_p"), F.col("_l"), F.col("page_number"))
    marked = met.withColumns({"confidence": F.least("confidence", "_c"), "inclusion_reason": F.concat("inclusion_reason", F.lit(" "), said), "classification_evidence": F.concat("classification_evidence", F.array(said))}).drop("_c", "_p", "_l")
    return base.join(summary.select(*_PAGE), _PAGE, "left_anti").unionByName(marked, allowMissingColumns=True)


def renumber(sents: DataFrame) -> DataFrame:
    """document_index after a splice: by page, each page in its own order."""
    return sents.withColumn("document_index", F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "document_index")) - 1)


def accepted(pages: DataFrame, words: DataFrame) -> DataFrame:
    return pages.where("accepted").join(words.select(*_PAGE).distinct(), _PAGE, "left_semi")


def gate(requests: DataFrame, most_bytes: int) -> DataFrame:
    """Recognition requests with the code that refuses them, null if none."""
    code = F.when(~F.coalesce("consent", F.lit(False)), "invalid_request").when(F.coalesce("size", F.lit(0)) == 0, "invalid_request").when(F.col("size") > most_bytes, "invalid_request")
    why = F.when(~F.coalesce("consent", F.lit(False)), "consent").when(F.coalesce("size", F.lit(0)) == 0, "empty").when(F.col("size") > most_bytes, "too large")
    return requests.withColumns({"error_code": code, "error_cause": why})
