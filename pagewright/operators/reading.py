"""The reading queue and what is shown around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.speech import projection
from ..functions.text import marker_speech, trim, word_count
from .inclusion import uncertain_regions

_DOC = "document_id"


def queue_entries(applied: DataFrame, sents: DataFrame, mode: str = "clean", table_mode: str = "skip", settings: dict | None = None) -> DataFrame:
    """Sentences of included regions with their spoken form; tables as set, empty forms dropped."""
    strict = mode == "strict-verbatim"
    keep = F.col("included") & (F.lit(strict) | (F.col("type") != "table") | F.lit(table_mode != "skip"))
    r = applied.where(keep).select(F.col(_DOC).alias("_d"), F.col("id").alias("_r"), F.col("type").alias("region_type"))
    met = sents.join(r, (sents[_DOC] == r["_d"]) & (sents["region_id"] == r["_r"])).drop("_d", "_r")
    marks = F.col("marker_spans") if "marker_spans" in sents.columns else None
    said = met.withColumn("_p", projection(F.col("text"), marks, settings, strict))
    return said.withColumns({"speech_text": F.col("_p.text"), "skipped": F.col("_p.skipped"), "anchors": F.col("_p.anchors")}).drop("_p").where(trim(F.col("speech_text")) != "")


def announcements(entries: DataFrame, placed: DataFrame) -> DataFrame:
    """Entries with one more for each marker, before the first entry of its paragraph. placed: document_id,
    paragraph_id, kind, page_number, marker_index, id."""
    first = entries.withColumn("_n", F.row_number().over(Window.partitionBy(_DOC, "paragraph_id").orderBy("document_index"))).where("_n = 1")
    p = placed.select(F.col(_DOC).alias("_d"), F.col("paragraph_id").alias("_p"), F.col("kind").alias("_kind"), F.col("page_number").alias("_page"), F.col("marker_index").alias("_m"), F.col("id").alias("_id"))
    met = first.join(p, (first[_DOC] == p["_d"]) & (first["paragraph_id"] == p["_p"]))
    speech = marker_speech(F.col("_kind"), F.col("_page"))
    empty = lambda c: F.array().cast(entries.schema[c].dataType)
    said = met.withColumns({"id": F.col("_id"), "page_number": F.col("_page"), "text": speech, "speech_text": speech, "skipped": empty("skipped"), "anchors": empty("anchors"), "_at": F.col("document_index"), "document_index": F.lit(-1), "_o": F.col("_m")})
    said = said.select(*entries.columns, "_at", "_o", F.lit(True).alias("announcement"))
    rest = entries.select("*", F.col("document_index").alias("_at"), F.lit(2147483647).alias("_o"), F.lit(False).alias("announcement"))
    at = F.row_number().over(Window.partitionBy(_DOC).orderBy("_at", "_o")) - 1
    return rest.unionByName(said).withColumn("queue_index", at).drop("_at", "_o")


def numbered(entries: DataFrame) -> DataFrame:
    return entries.withColumn("queue_index", F.row_number().over(Window.partitionBy(_DOC).orderBy("document_index")) - 1)


def order_footnotes(entries: DataFrame, mode: str) -> DataFrame:
    """Footnotes left out (skip), after their page (after-page) or their section (after-section); groups in
    the order they first appear. entries: queue_index, region_type, page_number."""
    if mode == "skip":
        at = F.row_number().over(Window.partitionBy(_DOC).orderBy("queue_index")) - 1
        return entries.where("region_type <> 'footnote'").withColumn("queue_index", at)
    upto = Window.partitionBy(_DOC).orderBy("queue_index").rowsBetween(Window.unboundedPreceding, 0)
    key = F.col("page_number") if mode == "after-page" else F.sum((F.col("region_type") == "heading").cast("int")).over(upto)
    keyed = entries.withColumn("_key", key)
    keyed = keyed.withColumn("_first", F.min("queue_index").over(Window.partitionBy(_DOC, "_key")))
    at = F.row_number().over(Window.partitionBy(_DOC).orderBy("_first", (F.col("region_type") == "footnote").cast("int"), "queue_index")) - 1
    return keyed.withColumn("queue_index", at).drop("_key", "_first")


def reading_queue(applied: DataFrame, sents: DataFrame, mode: str = "clean", table_mode: str = "skip", settings: dict | None = None, footnotes: str = "after-page", placed: DataFrame | None = None) -> DataFrame:
    entries = queue_entries(applied, sents, mode, table_mode, settings)
    out = numbered(entries) if placed is None else announcements(entries, placed)
    return out if mode == "strict-verbatim" else order_footnotes(out, footnotes)


def total_characters(queue: DataFrame) -> DataFrame:
    return queue.groupBy(_DOC).agg(F.sum(F.length("speech_text")).alias("total_characters"))


def reader_paragraphs(applied: DataFrame, sents: DataFrame, queue: DataFrame) -> DataFrame:
    """Paragraphs in reading order with their sentences: what is spoken, what is struck out."""
    unsure = uncertain_regions(applied).select(F.col(_DOC).alias("_d"), F.col("id").alias("_u"))
    r = applied.select(F.col(_DOC).alias("_rd"), F.col("id").alias("_r"), F.col("type").alias("region_type"), "included")
    q = queue.select(F.col(_DOC).alias("_qd"), F.col("id").alias("_q"), F.col("skipped").alias("_skipped"))
    met = sents.join(r, (sents[_DOC] == r["_rd"]) & (sents["region_id"] == r["_r"]))
    met = met.join(q, (met[_DOC] == q["_qd"]) & (met["id"] == q["_q"]), "left").join(unsure, (F.col(_DOC) == unsure["_d"]) & (F.col("region_id") == unsure["_u"]), "left")
    each = F.struct("document_index", F.col("id").alias("sentence_id"), "text", F.coalesce("_skipped", F.array().cast(queue.schema["skipped"].dataType)).alias("skipped"), F.col("_q").isNotNull().alias("spoken"))
    return met.groupBy(_DOC, "paragraph_id", "region_id", "region_type").agg(
        F.min("page_number").alias("page_number"), F.first("included").alias("included"), F.bool_or(F.col("_u").isNotNull()).alias("uncertain"),
        F.array_sort(F.collect_list(each)).alias("sentences"), F.min("document_index").alias("first_index"),
    )


_OVER = "{0}.x < {1}.x + {1}.width and {0}.x + {0}.width > {1}.x and {0}.y < {1}.y + {1}.height and {0}.y + {0}.height > {1}.y"


def drawn_areas(rects: DataFrame, items: DataFrame) -> DataFrame:
    """Drawn areas that hold labels rather than prose: no figure overlaps them, three items or more are
    inside, 70 % of these of three words or fewer. rects from `layout.drawn`. Joins are by page."""
    key = [_DOC, "page_number"]
    areas, figures = rects.where("kind = 'drawing'").alias("a"), rects.where("kind = 'figure'").alias("f")
    same = "a.document_id = {0}.document_id and a.page_number = {0}.page_number"
    free = areas.join(figures, F.expr(f"{same.format('f')} and {_OVER.format('a', 'f')}"), "left_anti").alias("a")
    met = free.join(items.alias("i"), F.expr(f"{same.format('i')} and {_OVER.format('i', 'a')}"))
    short = (word_count(F.col("i.text")) <= 3).cast("int")
    cols = [*key, "rect_index", "x", "y", "width", "height"]
    by = met.groupBy(*(F.col(f"a.{c}").alias(c) for c in cols)).agg(F.count("*").alias("n"), F.sum(short).alias("short"))
    return by.where((F.col("n") >= 3) & (F.col("short") / F.col("n") >= 0.7)).select(*cols)


def place_markers(figures: DataFrame, areas: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """document_id, paragraph_id, kind, page_number, marker_index, id. Drawn areas stand before their page's
    first paragraph; figures before the first that begins below their top, else the last. paragraphs:
    document_id, page_number, paragraph_id, order, top (null if unknown)."""
    p = paragraphs.select(F.col(_DOC).alias("_d"), F.col("page_number").alias("_g"), "paragraph_id", "order", "top")
    at = lambda x: x.join(p, (x[_DOC] == p["_d"]) & (x["page_number"] == p["_g"]))
    index = F.row_number().over(Window.partitionBy(_DOC).orderBy("page_number", "rect_index")) - 1
    drawn = at(areas.withColumn("n", index)).groupBy(_DOC, "page_number", "n").agg(F.min_by("paragraph_id", "order").alias("paragraph_id")).withColumn("kind", F.lit("drawn-area"))
    below = F.when(F.col("top") < F.col("y") + F.col("height"), F.col("order"))
    hosts = at(figures.withColumn("n", index)).groupBy(_DOC, "page_number", "n").agg(F.coalesce(F.min_by("paragraph_id", below), F.max_by("paragraph_id", "order")).alias("paragraph_id"))
    every = drawn.unionByName(hosts.withColumn("kind", F.lit("figure")))
    name = F.concat(F.lit("marker-"), F.when(F.col("kind") == "figure", "figure").otherwise("drawn"), F.lit("-"), F.col("page_number").cast("string"), F.lit("-"), F.col("n").cast("string"))
    order = F.row_number().over(Window.partitionBy(_DOC, "paragraph_id").orderBy("kind", "n")) - 1
    return every.select(_DOC, "paragraph_id", "kind", "page_number", order.alias("marker_index"), name.alias("id"))


def search(sents: DataFrame, term: str, limit: int = 40) -> DataFrame:
    """The first sentences of each document that hold the term (three characters or more), whatever case."""
    from ..constants import WS_CHARS

    t = term.strip(WS_CHARS).lower()
    if len(t) < 3:
        return sents.limit(0)
    found = sents.where(F.contains(F.lower("text"), F.lit(t)))
    rank = F.row_number().over(Window.partitionBy(_DOC).orderBy("document_index"))
    return found.withColumn("_n", rank).where(F.col("_n") <= limit).drop("_n")


def remaining_characters(queue: DataFrame) -> DataFrame:
    after = Window.partitionBy(_DOC).orderBy("queue_index").rowsBetween(0, Window.unboundedFollowing)
    return queue.withColumn("remaining_characters", F.sum(F.length("speech_text")).over(after))


def sections(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """The section that each page stands in: the last heading on or before it (an as-of join made a union
    and a running last value). outline: document_id, page_number, title, reading_order."""
    heads = outline.select(_DOC, "page_number", "title", F.col("reading_order").alias("o"), F.lit(0).alias("k"))
    marks = pages.select(_DOC, "page_number", F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("o"), F.lit(1).alias("k"))
    w = Window.partitionBy(_DOC).orderBy("page_number", "k", "o").rowsBetween(Window.unboundedPreceding, 0)
    return heads.unionByName(marks).withColumn("section", F.last("title", ignorenulls=True).over(w)).where("k = 1").select(_DOC, "page_number", "section")


def sentence_boxes(sents: DataFrame, document_id: str, sentence_id: str) -> DataFrame:
    return sents.where((F.col(_DOC) == document_id) & (F.col("id") == sentence_id)).select(F.explode("bounding_boxes").alias("box")).select("box.*")
