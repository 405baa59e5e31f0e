"""Lines to paragraphs to sentences.

Segmentation is position-local, so it runs on the array of a paragraph's tokens inside one row: no
shuffle, no Python. Wrapped lines are joined by a window over each region's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import ABBREVIATIONS, BULLETS, CLOSERS, TERMINATORS, WS
from ..functions.text import matches, short_title, splits_word, trim, trim_end

_TAIL = f"[{TERMINATORS}][{TERMINATORS}{CLOSERS}]*$"


def _bare(token: Column) -> Column:
    return F.regexp_replace(token, f"[{WS}]+", "")


def _plain(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[^a-z.]", "")


def _ends(token: Column, before: Column, after: Column) -> Column:
    """Whether a sentence ends with `token`, given its neighbours (null at the ends)."""
    bare = _bare(token)
    tail = F.regexp_extract(bare, f"({_TAIL})", 1)
    head = F.regexp_replace(bare, _TAIL, "")
    stops = F.length(F.regexp_replace(tail, r"[^.]", ""))
    word = _plain(F.when(head == "", F.coalesce(_bare(before), F.lit(""))).otherwise(head))
    known = [F.lit(a) for a in ABBREVIATIONS]
    abbreviated = lambda w: w.isin(*known) | F.regexp_replace(w, r"\.$", "").isin(*known)
    initial = matches(head, r"(^|\()[A-Za-z]$")
    initials = matches(_plain(F.concat(head, F.lit("."))), r"^([a-z]\.){2,5}$")
    decimal = matches(head, "[0-9]$") & matches(after, "^[0-9]")
    one = ~(abbreviated(word) | initial | initials | decimal)
    # a second stop in a row only yields to an abbreviation, a third to nothing
    survives = matches(tail, "[!?…]") | (stops >= 3) | ((stops == 2) & ~_plain(head).isin(*known)) | ((stops == 1) & one)
    opens = matches(after, r"^[\p{Lu}\p{N}\"'“‘(\[]")
    return F.coalesce((tail != "") & survives & opens, F.lit(False))


def with_sentences(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """`df` with `out`, the array of the text's sentences; put together again they are the text.

    Tokens and the places where sentences start are columns of their own, so that each is computed once a
    row and not once a token.
    """
    tokens, at = F.col("_tokens"), F.col("_starts")
    bullet = lambda t: matches(t, f"^[{BULLETS}][{WS}]+$")
    # only a token with a terminator in its tail needs the rules
    ends = lambda i: F.when(matches(F.get(tokens, i - 1), f"[{TERMINATORS}][{TERMINATORS}{CLOSERS}]*[{WS}]*$"), _ends(F.get(tokens, i - 1), F.get(tokens, i - 2), F.get(tokens, i))).otherwise(False)
    starts = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: (i == 0) | bullet(F.get(tokens, i)) | ends(i))
    cut = F.transform(at, lambda s, k: F.array_join(F.slice(tokens, s + 1, F.coalesce(F.get(at, k + 1), F.size(tokens)) - s), ""))
    cut = F.when(F.size(tokens) > 0, cut).otherwise(F.array().cast("array<string>"))
    given = df.withColumn("_tokens", F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"(^[{WS}]+|[^{WS}]+[{WS}]*)"), F.lit(1)))
    marked = given.withColumn("_starts", F.when(F.size(tokens) > 0, starts).otherwise(F.array().cast("array<int>")))
    return marked.withColumn(out, cut).drop("_tokens", "_starts")


def sentences(paragraphs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row a sentence: `keys`, sentence_index, text, start, end (offsets into the paragraph)."""
    cut = with_sentences(paragraphs.select(*keys, F.col(text_col).alias("_text")), "_text", "_all").select(*keys, "_all")
    zero = F.array(F.lit(0))
    ends = F.aggregate("_all", zero, lambda acc, s: F.concat(acc, F.array((F.element_at(acc, -1) + F.length(s)).cast("int"))))
    # the outer form: for the inner one the optimizer would push size(_all) > 0, spelt out, below the columns
    rows = cut.withColumn("_at", ends).select(*keys, "_at", F.posexplode_outer("_all").alias("sentence_index", "text")).where("sentence_index is not null")
    return rows.select(*keys, "sentence_index", "text", F.get("_at", F.col("sentence_index")).alias("start"), F.get("_at", F.col("sentence_index") + 1).alias("end"))


def assert_lossless(paragraphs: DataFrame, text_col: str = "text") -> DataFrame:
    """`paragraphs` with n_sentences, failing where the sentences do not add up to the text."""
    cut = with_sentences(paragraphs, text_col, "_all")
    whole = F.array_join("_all", "") == F.coalesce(F.col(text_col), F.lit(""))
    checked = F.when(F.assert_true(whole, F.lit("segmentation altered the text")).isNull(), F.size("_all"))
    return cut.withColumn("n_sentences", checked).drop("_all")


def join_wrapped(lines: DataFrame, keys: list[str], order: str, text_col: str = "text") -> DataFrame:
    """`lines` with `piece` (what the line adds to its region's text), `base` (where that begins) and
    `joint` (hyphen-join, line-wrap-join or null): a hyphen that wraps a word goes, else a space joins."""
    w = Window.partitionBy(*keys).orderBy(order)
    nxt = F.lead(text_col).over(w)
    cur = trim_end(F.col(text_col))
    hyphen = splits_word(cur, nxt)
    shown = lines.withColumns({"_next": nxt, "_cur": cur, "_hyphen": hyphen})
    wraps = F.col("_next").isNotNull() & (F.col("_cur") != "") & ~F.col("_hyphen")
    piece = F.when(F.col("_hyphen"), F.expr("substring(_cur, 1, length(_cur) - 1)")).when(wraps, F.concat("_cur", F.lit(" "))).otherwise(F.col("_cur"))
    joint = F.when(F.col("_hyphen"), F.lit("hyphen-join")).when(wraps, F.lit("line-wrap-join"))
    out = shown.withColumns({"piece": piece, "joint": joint})
    base = F.coalesce(F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return out.withColumn("base", base).drop("_next", "_cur", "_hyphen")


def region_texts(lines: DataFrame, keys: list[str], order: str, text_col: str = "text") -> DataFrame:
    """`keys` and text: each region's joined lines."""
    parts = join_wrapped(lines, keys, order, text_col)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("piece").alias("p"))))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["p"]), "").alias("text"))


def document_offsets(paragraphs: DataFrame, order: str, document: str = "document_id", text_col: str = "text") -> DataFrame:
    """`paragraphs` with paragraph_offset: where each begins in the document's text, two line ends apart."""
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return paragraphs.withColumn("paragraph_offset", F.coalesce(F.sum(F.length(text_col) + 2).over(w), F.lit(0)).cast("long"))


def document_index(rows: DataFrame, order: list[str], document: str = "document_id") -> DataFrame:
    return rows.withColumn("document_index", F.row_number().over(Window.partitionBy(document).orderBy(*order)) - 1)


def overlapping_items(sents: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Each sentence with each item span that overlaps it; `s`/`e` are the overlap within the sentence.
    sents: keys, sentence_index, start, end; spans: keys, item_id, span_start, span_end, raised."""
    met = sents.join(spans, keys).where("span_end > start and span_start < end")
    return met.withColumns({"s": F.greatest("span_start", "start") - F.col("start"), "e": F.least("span_end", "end") - F.col("start")})


def marker_spans(met: DataFrame, keys: list[str]) -> DataFrame:
    """Raised parts of each sentence, trimmed; from `overlapping_items`."""
    part = F.expr("substring(text, s + 1, e - s)")
    lead = F.length(part) - F.length(F.regexp_replace(part, f"^[{WS}]+", ""))
    trail = F.length(part) - F.length(trim_end(part))
    cut = met.where("raised").withColumns({"m_start": F.col("s") + lead, "m_end": F.col("e") - trail}).where("m_end > m_start")
    spans = F.array_sort(F.collect_list(F.struct(F.col("m_start").cast("int").alias("start"), F.col("m_end").cast("int").alias("end"))))
    return cut.groupBy(*keys, "sentence_index").agg(spans.alias("marker_spans"))


def sentence_transformations(sents: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Log rows (keys, kind, offset, ...) of each sentence, both ends included: a record on a boundary
    belongs to two sentences."""
    return sents.join(log, keys).where("offset between start and end")


def outline(regions: DataFrame) -> DataFrame:
    """Headings as a flat outline; a confident heading is of the first level."""
    heads = regions.where((F.col("type") == "heading") & (trim(F.col("text")) != ""))
    return heads.select(
        "document_id",
        F.concat("id", F.lit(":outline")).alias("id"),
        short_title(F.col("text")).alias("title"),
        "page_number",
        F.when(F.col("confidence") >= 0.75, 1).otherwise(2).alias("level"),
        F.col("id").alias("region_id"),
        "reading_order",
    )


def apply_inclusion(sents: DataFrame, regions: DataFrame) -> DataFrame:
    """Sentences with the inclusion of their region; those without a region stay as they are."""
    r = regions.select(F.col("document_id").alias("_d"), F.col("id").alias("_r"), F.col("included").alias("_inc"), F.col("confidence").alias("_conf"), F.col("user_override").alias("_over"))
    uncertain = (F.col("_conf") >= 0.5) & (F.col("_conf") < 0.8) & F.col("_over").isNull()
    status = F.when(F.col("_r").isNull(), F.lit("included")).when(~F.col("_inc"), F.lit("excluded")).when(uncertain, F.lit("uncertain")).otherwise(F.lit("included"))
    joined = sents.join(r, (sents["document_id"] == r["_d"]) & (sents["region_id"] == r["_r"]), "left")
    return joined.withColumn("inclusion_status", status).drop("_d", "_r", "_inc", "_conf", "_over")


def transformation_log(sents: DataFrame) -> DataFrame:
    return sents.select("document_id", F.col("id").alias("sentence_id"), F.explode("transformations").alias("t")).select("document_id", "sentence_id", "t.*")
