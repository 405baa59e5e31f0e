import pytest
from pyspark.sql import functions as F

from pagewright.operators import layout, reading
from pagewright.plans import extract
from pagewright.sources import fixtures, pdf


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pdf")
    for k in ("single-page", "two-column", "table", "typography", "front-matter", "scanned", "flow-chart"):
        (d / f"{k}.pdf").write_bytes(fixtures.FIXTURES[k]())
    (d / "many.pdf").write_bytes(fixtures.many_pages(12))
    (d / "bad.pdf").write_bytes(b"not a pdf")
    (d / "locked.pdf").write_bytes(fixtures.single_page().replace(b"trailer\n<<", b"trailer\n<< /Encrypt << /Filter /Standard >>"))
    out = tmp_path_factory.mktemp("tables")

    def keep(df, name):
        df.write.parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    parsed = keep(pdf.read(spark, str(d)), "parsed")
    ex = extract.extract(pdf.source_items(parsed), pdf.page_dims(parsed), keep)
    ex.sentences = keep(ex.sentences, "sentences")
    names = {r.document_id: r.name.removesuffix(".pdf") for r in parsed.collect()}
    by = {n: {} for n in names.values()}
    for r in ex.regions.orderBy("document_id", "reading_order").collect():
        by[names[r.document_id]].setdefault(r.type, []).append(r)
    return ex, parsed, names, by


def test_load_errors(made):
    _, parsed, names, _ = made
    assert {names[r.document_id]: r.code for r in pdf.load_errors(parsed).collect()} == {"bad": "invalid-pdf", "locked": "password-required"}


def test_hyphen_and_heading(made):
    ex, _, names, by = made
    one = by["single-page"]
    assert len(one["heading"]) == 1 and len(one["paragraph"]) == 2
    assert "ultrafiltrate" in one["paragraph"][0].text


def test_running_heads_and_page_numbers(made):
    by = made[3]["many"]
    assert len(by["header"]) == len(by["footer"]) == len(by["page-number"]) == 12
    assert all(r.confidence >= 0.8 for r in by["header"] + by["footer"]) and len(by["heading"]) == 12


def test_columns_and_references(made):
    ex, _, names, by = made
    two = by["two-column"]
    assert any("Left column line 29" in r.text and "Right" not in r.text for r in two["paragraph"])
    assert two["footnote"] and len(two["reference"]) >= 2
    pages = {(names[r.document_id], r.page_number): r for r in ex.pages.collect()}
    assert pages["two-column", 1].column_count == 2 and pages["scanned", 1].likely_scanned


def test_table(made):
    by = made[3]["table"]
    assert len(by["table"]) == 1 and by["caption"] and len(by["paragraph"]) == 2


def test_duplicates_removed(made):
    ex, _, names, _ = made
    assert {names[r.document_id] for r in ex.items.where("removed").collect()} == {"typography"}


def test_front_matter_is_noted(made):
    evidence = [e for own in made[3]["front-matter"].values() for r in own for e in r.classification_evidence]
    assert any("[front-matter detection]" in e for e in evidence)


def test_sentences_trace_to_items(made):
    ex, _, names, _ = made
    rows = [r for r in ex.sentences.collect() if names[r.document_id] == "single-page"]
    first = next(r for r in rows if "ultrafiltrate" in r.text)
    assert len(first.source_text_item_ids) == 2 and len(first.bounding_boxes) == 2
    assert [t.kind for t in first.transformations] == ["hyphen-join"]
    assert sorted(r.document_index for r in rows) == list(range(len(rows)))


def test_report_and_queue(made):
    ex, _, names, _ = made
    got = {names[r.document_id]: r for r in extract.report(ex).collect()}
    assert got["many"].pages == 12 and got["many"].excluded_regions == 36 and got["scanned"].scanned == 1


def test_drawn_area(spark, made):
    ex, parsed, names, _ = made
    rects = layout.drawn(pdf.draw_ops(parsed), pdf.page_dims(parsed))
    found = reading.drawn_areas(rects, ex.items).collect()
    assert {names[r.document_id] for r in found} == {"flow-chart"}


def item(k, text, x, y, width, size=10.0):
    return {"document_id": "d", "page_number": 1, "source_index": k, "text": text, "transform": [size, 0, 0, size, x, y], "x": x, "y": y, "width": width, "height": size, "font_name": "f1", "font_size": size, "direction": "ltr", "has_eol": False, "raised": False}


def test_a_chain_of_near_places_keeps_every_other_item():
    kept, gone = layout.split_duplicates([item(k, "same", 10 + 0.8 * k, 10, 20) for k in range(3)])
    assert [i["source_index"] for i in kept] == [0, 2]


def test_tight_columns_are_found_by_line_starts():
    items = [item(2 * r + c, "words", x, 700 - 11 * r, 205) for r in range(20) for c, x in enumerate((62, 269))]
    assert len(layout.detect_columns(items, 612)["columns"]) == 2


def test_superscript_and_subscript():
    items = [item(k, "text", 50 + 30 * k, 500, 25) for k in range(4)] + [item(4, "12", 171, 504.4, 6, 6.6), item(5, "2", 76, 498, 3, 6.6), item(6, "next line", 50, 480, 100)]
    lines = layout.group_lines(items, [(50, 180)], 792)
    assert len(lines) == 2 and {i["id"][-2:]: i["raised"] for i in lines[0]["items"]} == {"i0": False, "i1": False, "i2": False, "i3": False, "i4": True, "i5": False}


def test_drop_cap_joins_the_first_line_it_spans():
    items = [item(0, "T", 50, 486, 20, 30)] + [item(k, "words of the text", 75, 500 - 12 * (k - 1), 120) for k in (1, 2, 3)] + [item(4, "below it all", 50, 460, 140)]
    lines = layout.group_lines(items, [(50, 200)], 792)
    assert lines[0]["text"].startswith("T") and len(lines) == 4


def test_reading_order_as_sql(spark, made):
    ex = made[0]
    got = layout.reading_order(ex.lines)
    assert got.where(F.col("reading_index") != F.col("line_index")).count() == 0


def test_figures_follow_the_matrix():
    ops = [("save", None), ("transform", [2, 0, 0, 2, 10, 10]), ("transform", [100, 0, 0, 100, 0, 0]), ("paint_image", None), ("restore", None), ("construct_path", [100, 200, 400, 500]), ("construct_path", [0, 0, 612, 792])]
    figures, drawings = layout.page_rects(ops, 612, 792)
    assert figures == [{"x": 10, "y": 10, "width": 200, "height": 200}] and drawings == [{"x": 100, "y": 200, "width": 300, "height": 300}]
