"""The whole extraction of many documents at once, and the report over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import classify, inclusion, layout, reading, sentences

_KEYS = ["document_id", "region_id"]


@dataclass
class Extraction:
    """Tables of an extraction; each is lazy, keep those that are read more than once."""

    pages: DataFrame
    items: DataFrame
    lines: DataFrame
    blocks: DataFrame
    regions: DataFrame
    paragraphs: DataFrame
    sentences: DataFrame
    outline: DataFrame


def extract(source: DataFrame, pages: DataFrame, keep=lambda df, name: df) -> Extraction:
    """source: `layout.raw_items` input; pages: document_id, page_number, width, height, rotation. `keep`
    stores a table that several stages read (say, as Parquet) and gives it back."""
    items = layout.raw_items(source)
    marked = keep(layout.remove_duplicates(items), "items")
    lines = keep(layout.lines(items, pages), "lines")
    blocks = keep(layout.blocks(lines, pages), "blocks")
    doc_sizes = keep(layout.body_sizes(lines, ["document_id"]), "sizes")
    page_sizes = _page_sizes(lines, doc_sizes)
    bands = lines.groupBy("document_id", "page_number").agg(F.first("n_columns").alias("n"), F.first("columns_confidence").alias("confidence"))
    bands = bands.select("document_id", "page_number", F.array_repeat(F.struct(F.lit(0).alias("index")), F.col("n")).alias("columns"), "confidence")
    metrics = keep(layout.page_metrics(marked, pages, bands, blocks), "pages")
    regions = keep(classify.regions(blocks, pages, doc_sizes, page_sizes, metrics), "regions")
    paragraphs, sents = paragraphs_and_sentences(blocks, regions)
    return Extraction(metrics, marked, lines, blocks, regions, paragraphs, sents, sentences.outline(regions))


def _page_sizes(lines: DataFrame, doc_sizes: DataFrame) -> DataFrame:
    """Body size of each page that has four lines, else its document's."""
    own = layout.body_sizes(lines, ["document_id", "page_number"])
    n = lines.groupBy("document_id", "page_number").agg(F.count("*").alias("n"))
    both = own.join(n, ["document_id", "page_number"]).join(doc_sizes.withColumnRenamed("body_size", "d"), "document_id")
    return both.select("document_id", "page_number", F.when(F.col("n") >= 4, F.coalesce(F.nullif("body_size", F.lit(0.0)), "d")).otherwise(F.col("d")).alias("body_size"))


def paragraphs_and_sentences(blocks: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paragraphs (one a region) and sentences with offsets, source items, raised markers and log."""
    rows = blocks.select("document_id", F.col("id").alias("region_id"), F.posexplode("lines").alias("k", "line")).select(*_KEYS, "k", "line.text", "line.spans", "line.items")
    parts = sentences.join_wrapped(rows, _KEYS, "k")
    ordered = F.array_sort(F.collect_list(F.struct("k", "piece")))
    text = parts.groupBy(*_KEYS).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text"))
    r = regions.select("document_id", F.col("id").alias("region_id"), "page_number", "reading_order", "bounding_boxes")
    paras = sentences.document_offsets(text.join(r, _KEYS), "reading_order").withColumn("paragraph_id", F.concat("region_id", F.lit(":para0")))
    cut = sentences.sentences(paras, [*_KEYS, "paragraph_id", "page_number", "reading_order", "paragraph_offset"])
    cut = cut.withColumn("id", F.concat("paragraph_id", F.lit(":s"), F.col("sentence_index").cast("string")))
    limit = F.length("piece") - F.when(F.col("joint") == "line-wrap-join", 1).otherwise(0)
    spans = parts.select(*_KEYS, "base", limit.alias("limit"), F.explode(F.arrays_zip("spans", "items")).alias("z"))
    spans = spans.select(*_KEYS, F.col("z.spans.item_id").alias("item_id"), (F.col("base") + F.col("z.spans.start")).alias("span_start"), (F.col("base") + F.least("z.spans.end", "limit")).alias("span_end"), F.col("z.items.raised").alias("raised"), F.col("z.items.x").alias("x"), F.col("z.items.y").alias("y"), F.col("z.items.width").alias("width"), F.col("z.items.height").alias("height"), F.col("z.items.font_size").alias("font_size")).where("span_end > span_start")
    met = sentences.overlapping_items(cut.select(*_KEYS, "sentence_index", "text", "start", "end"), spans, _KEYS)
    key = [*_KEYS, "sentence_index"]
    ids = met.groupBy(*key).agg(F.transform(F.array_sort(F.collect_set(F.struct("span_start", "item_id"))), lambda x: x["item_id"]).alias("source_text_item_ids"))
    marks, boxes = sentences.marker_spans(met, _KEYS), layout.sentence_boxes(met, key)
    after = parts.select(*_KEYS, (F.col("base") + F.length("piece") - F.when(F.col("joint") == "line-wrap-join", 1).otherwise(0)).alias("offset"), F.col("joint").alias("kind")).where("kind is not null")
    before = F.when(F.col("kind") == "hyphen-join", "-\n").otherwise("\n")
    log = sentences.sentence_transformations(cut.select(*_KEYS, "sentence_index", "start", "end"), after, _KEYS)
    log = log.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("offset", "kind", before.alias("before"), F.when(F.col("kind") == "hyphen-join", "").otherwise(" ").alias("after")))).alias("transformations"))
    out = cut.join(ids, key, "left").join(marks, key, "left").join(boxes, key, "left").join(log, key, "left")
    out = out.withColumns({"normalized_start": F.col("paragraph_offset") + F.col("start"), "normalized_end": F.col("paragraph_offset") + F.col("end"), "inclusion_status": F.lit("included")})
    out = out.withColumn("document_index", F.row_number().over(Window.partitionBy("document_id").orderBy("reading_order", "sentence_index")) - 1)
    sent_ids = cut.groupBy(*_KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("sentence_index", "id"))), lambda x: x["id"]).alias("sentence_ids"))
    return paras.join(sent_ids, _KEYS, "left"), out


def report(ex: Extraction, mode: str = "clean") -> DataFrame:
    """One row a document: what an inspection of a folder of files prints."""
    applied = inclusion.apply_mode(ex.regions, mode)
    summary = inclusion.exclusion_summary(applied)
    queue = reading.queue_entries(applied, ex.sentences, mode)
    pages = ex.pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if("likely_scanned").alias("scanned"), F.count_if("reading_order_uncertain").alias("uncertain"), F.max("column_count").alias("most_columns"))
    items = ex.items.groupBy("document_id").agg(F.count("*").alias("items"), F.count_if("removed").alias("duplicates"))
    types = ex.regions.groupBy("document_id", "type").agg(F.count("*").alias("n")).groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("regions_by_type"))
    said = queue.groupBy("document_id").agg(F.count("*").alias("queue_entries"), F.sum(F.length("speech_text")).alias("characters"))
    out = pages
    for t in (items, summary, types, said):
        out = out.join(t, "document_id", "left")
    words = F.coalesce("included_words", F.lit(0)) + F.coalesce("excluded_words", F.lit(0))
    return out.withColumn("skipped_share", F.coalesce("excluded_words", F.lit(0)) / F.greatest(words, F.lit(1)))
