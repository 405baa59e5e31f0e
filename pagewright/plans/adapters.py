"""The given tables as the library's entities. All plain expressions, so that SQL can repeat them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_LINES = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer splits than there are cores is dealt out, so that all cores work on it."""
    out, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return out.repartition(cores) if out.rdd.getNumPartitions() < cores else out


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents.text, forty a page, on a synthetic page."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    k = F.col("line_no") % PAGE_LINES
    return d.select(
        "document_id", "line_no", "text", F.floor(F.col("line_no") / PAGE_LINES + 1).cast("int").alias("page_number"), F.lit(54.0).alias("x"),
        (F.lit(738.0) - 14 * k).alias("baseline"), F.lit(11.0).alias("font_size"), (F.lit(5.5) * F.length("text")).alias("width"),
    )


def html_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of pages.html as regions: type and confidence by tag, ten a page."""
    found = F.regexp_extract_all("html", F.lit('(<(?:h1|p|div class="ad"|a [^>]*|footer)>[^<]*)'), F.lit(1))
    each = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("document_id"), F.posexplode(found).alias("reading_order", "m"))
    tag = F.regexp_extract("m", "^<([a-z0-9]+)", 1)
    kind = F.when(tag == "h1", "heading").when(tag == "p", "paragraph").when(tag == "a", "header").otherwise("footer")
    sure = F.when(tag == "h1", 0.9).when(tag == "p", 0.5).when(tag == "a", 0.85).when(tag == "div", 0.7).otherwise(0.9)
    return each.select(
        "document_id", F.concat("document_id", F.lit(":r"), F.col("reading_order").cast("string")).alias("id"), "reading_order", F.floor(F.col("reading_order") / 10 + 1).cast("int").alias("page_number"),
        kind.alias("type"), sure.alias("confidence"), F.regexp_replace("m", "^<[^>]*>", "").alias("text"),
    )


def conv_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as reading queues: users are footnotes, the system a heading, two turns a page."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "footnote").when(F.col("role") == "system", "heading").otherwise("paragraph")
    doc = F.col("conv_id").cast("string")
    return c.select(
        doc.alias("document_id"), F.concat(doc, F.lit(":"), F.col("turn").cast("string")).alias("id"), F.col("turn").cast("int").alias("queue_index"), F.col("turn").cast("int").alias("document_index"),
        F.floor(F.col("turn") / 2 + 1).cast("int").alias("page_number"), kind.alias("region_type"), F.concat(doc, F.lit(":p"), F.floor(F.col("turn") / 3).cast("string")).alias("paragraph_id"),
        F.concat(doc, F.lit(":r"), F.floor(F.col("turn") / 3).cast("string")).alias("region_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("text", F.lit("")).alias("speech_text"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as service requests."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("client"), F.col("event_type").alias("bucket"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("now_seconds"), F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string")).alias("cache_key"))


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document as recognised words, confidence by place."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("word_index", "text"))
    grade = (F.col("doc_id") * 7 + F.col("word_index") * 13) % 100 / F.lit(100.0)
    doc = F.col("doc_id").cast("string")
    return w.select(doc.alias("document_id"), F.lit(1).alias("page_number"), "word_index", "text", grade.alias("confidence"), (F.lit(20.0) * F.col("word_index")).alias("x"), F.lit(100.0).alias("y"), F.lit(18.0).alias("width"), F.lit(20.0).alias("height"))


def ocr_corrections(words: DataFrame) -> DataFrame:
    """A correction of every word in grave doubt."""
    fixed = words.where("confidence < 0.4")
    return fixed.select("document_id", "page_number", "word_index", F.col("text").alias("original"), F.concat("text", F.lit("+")).alias("corrected"), F.col("word_index").cast("long").alias("corrected_at"))


def ocr_pages(words: DataFrame) -> DataFrame:
    by = words.groupBy("document_id", "page_number").agg(F.avg("confidence").alias("confidence"))
    return by.select("document_id", "page_number", F.lit("mock").alias("provider"), "confidence", F.lit(2.0).alias("render_scale"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), (F.col("document_id").cast("long") % 2 == 0).alias("accepted"))


_ITEMS = "array<struct<id:string,transform:array<double>>>"


def _blocks(rows: DataFrame, doc, page, order, items=None) -> DataFrame:
    """Rows (document_id, line_no, text, x, baseline, width, type, confidence, size) as blocks of one line."""
    items = F.array().cast(_ITEMS) if items is None else items
    line = F.struct("text", "x", "baseline", "width", F.lit(11.0).alias("height"), F.col("size").alias("font_size"), items.alias("items"))
    return rows.select(
        doc.alias("document_id"), page.alias("page_number"), F.concat("document_id", F.lit(":"), F.col("line_no").cast("string")).alias("id"), "type",
        "confidence", F.array(F.lit("layout")).alias("evidence"), F.col("x"), F.col("baseline").alias("y"), "width", F.lit(11.0).alias("height"),
        F.array(line).alias("lines"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), F.lit(1).alias("n_lines"), F.col("text").alias("joined"), F.trim("text").alias("first_text"), F.col("size").alias("font_size"),
        F.col("size").alias("first_size"), F.col("baseline").alias("bottom"), (F.col("baseline") + 11).alias("top"), order.alias("block_order"), F.lit(11.0).alias("body_size"),
    )


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as a block with what the detectors read, each document a page of one document."""
    short = (F.length("text") < 40) & ~F.regexp_like("text", F.lit(r"[.!?]$"))
    rows = doc_lines(spark, sf_dir).withColumns({"type": F.when(short, "heading").otherwise("paragraph"), "confidence": F.when(short, 0.65).otherwise(0.5), "size": F.col("font_size")})
    return _blocks(rows, F.lit("corpus"), F.col("document_id").cast("int") + 1, F.col("document_id").cast("long") * 1000000 + F.col("line_no"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, four a page: the first of a page is its number in one of several forms or a
    running head; some are headings, some read like entries of a bibliography."""
    n, k = F.col("document_id").cast("long"), F.col("line_no")
    page, j = F.floor(k / 4 + 1).cast("int"), k % 4
    number = page.cast("string")
    form = F.when(n % 8 == 5, F.concat(F.lit("Running head "), number)).when(n % 4 == 0, number).when(n % 4 == 1, F.concat(F.lit("Page "), number))
    form = form.when(n % 4 == 3, F.concat(F.lit("- "), number, F.lit(" -"))).when(page <= 2, F.repeat(F.lit("i"), page)).otherwise(number)
    named = F.when((k == 1) & (n % 3 == 0), "Preface").when((k == 2) & (n % 5 == 0), "References").when((k == 7) & (n % 10 == 0), "Appendix")
    entry = F.when(n % 4 == 0, F.concat("text", F.lit(" (2019) pp. 12-34, vol.2")))
    head = named.isNotNull()
    x = F.when((j == 0) & (n % 8 != 0), F.when((n % 7 == 0) & (page % 2 == 0), 330.0).otherwise(290.0)).when(j == 3, 72.0).otherwise(54.0)
    rows = doc_lines(spark, sf_dir).withColumns({"page_number": page, "j": j, "n": n, "type": F.when(head, "heading").otherwise("paragraph"), "confidence": F.when(head, 0.65).otherwise(0.5), "size": F.when(head, 14.0).otherwise(11.0), "x": x, "baseline": F.lit(738.0) - 200 * j})
    rows = rows.withColumn("text", F.when(j == 0, form).otherwise(F.coalesce(named, entry, F.col("text"))))
    return rows.withColumn("width", F.lit(5.5) * F.length("text"))


def marked_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(_marked(spark, sf_dir), F.col("document_id"), F.col("page_number"), F.col("line_no"))


def watermark_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with a stamp on every page or every other one: rotated, very large or neither."""
    stamp = (F.col("j") == 2) & ((F.col("n") % 2 == 0) | (F.col("page_number") % 3 == 1))
    turned = stamp & (F.col("n") % 3 == 0)
    rows = _marked(spark, sf_dir).withColumns({"text": F.when(stamp, "Draft copy").otherwise(F.col("text")), "size": F.when(stamp & (F.col("n") % 3 == 1), 30.0).otherwise(F.col("size")), "turned": turned})
    matrix = F.when(F.col("turned"), F.array(*map(F.lit, (0.7, 0.7, -0.7, 0.7, 0.0, 0.0)))).otherwise(F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))))
    items = F.array(F.struct(F.col("line_no").cast("string").alias("id"), matrix.alias("transform")))
    return _blocks(rows, F.col("document_id"), F.col("page_number"), F.col("line_no"), items)


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rects, items): labels and rectangles by arithmetic on documents."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id").cast("string")
    rect = d.select(doc.alias("document_id"), F.lit(1).alias("page_number"), F.when(F.col("doc_id") % 4 == 0, "figure").otherwise("drawing").alias("kind"), F.lit(0).alias("rect_index"), (F.col("doc_id") % 50 * 4.0).alias("x"), F.lit(300.0).alias("y"), F.lit(200.0).alias("width"), F.lit(200.0).alias("height"))
    second = d.select(doc.alias("document_id"), F.lit(1).alias("page_number"), F.lit("drawing").alias("kind"), F.lit(1).alias("rect_index"), F.lit(150.0).alias("x"), (F.col("doc_id") % 20 * 15.0).alias("y"), F.lit(250.0).alias("width"), F.lit(180.0).alias("height"))
    items = d.select(doc.alias("document_id"), F.lit(1).alias("page_number"), F.posexplode(F.split("text", " ")).alias("k", "w"))
    items = items.select("document_id", "page_number", F.col("k").alias("source_index"), F.when(F.col("k") % 5 == 0, F.concat("w", F.lit(" a b c"))).otherwise(F.col("w")).alias("text"), (F.col("k") * 37.0 + 20).alias("x"), (F.lit(520.0) - F.col("k") * 25).alias("y"), F.lit(30.0).alias("width"), F.lit(10.0).alias("height"), F.lit(10.0).alias("font_size"))
    return rect.unionByName(second), items


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as lines of pages with what block building reads: gaps, indents, sizes, faces, and
    on two documents of three some lines whose items stand in three cells."""
    k, n = F.col("line_no") % PAGE_LINES, F.col("document_id").cast("long")
    size = F.when(k % 11 == 0, 14.0).when(k > 35, 8.0).otherwise(11.0)
    x = F.when(k % 6 == 1, 74.0).otherwise(54.0)
    # cells line up but in one line of every fifth document
    in_table = k.between(3, 6) & (n % 3 < 2)
    cell = lambda c: F.struct(F.concat("line_no", F.lit(f":{c}")).alias("id"), F.lit(f"cell {c}").alias("text"), (x + 100.0 * c + F.when((k == 4) & (n % 5 == 0), 15.0 * c).otherwise(0.0)).alias("x"), F.lit(0.0).alias("y"), F.lit(40.0).alias("width"), F.lit(11.0).alias("height"), F.lit(11.0).alias("font_size"), F.lit(False).alias("raised"), F.array(F.lit(1.0)).alias("transform"))
    items = F.when(in_table, F.array(cell(0), cell(1), cell(2))).otherwise(F.array().cast("array<struct<id:string,text:string,x:double,y:double,width:double,height:double,font_size:double,raised:boolean,transform:array<double>>>"))
    baseline = F.lit(738.0) - 14 * k - 12 * F.floor(k / 8) - F.when((k >= 3) & (n % 3 == 0), 30.0).otherwise(0.0) - F.when((k >= 7) & (n % 3 < 2), 30.0).otherwise(0.0)
    return doc_lines(spark, sf_dir).select(
        "document_id", "page_number", k.cast("int").alias("line_index"), F.concat("document_id", F.lit(":"), F.col("line_no").cast("string")).alias("id"), "text", F.array().cast("array<struct<start:int,end:int,item_id:string>>").alias("spans"), x.alias("x"),
        F.least(F.lit(480.0), F.lit(5.5) * F.length("text")).alias("width"), F.lit(11.0).alias("height"), baseline.alias("baseline"), size.alias("font_size"), F.when(k % 13 == 0, "Face-Bold").otherwise("f1").alias("font_name"),
        F.lit(0).alias("column_index"), F.lit(False).alias("spans_columns"), items.alias("items"), F.lit(1).alias("n_columns"), F.lit(480.0).alias("column_width"), F.lit(0.9).alias("columns_confidence"),
    )
