"""Pages from spans, by hand."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import clean, layout


def span(line, text, x0, y0, x1=None, size=10.0, page=1, no=0, doc="d", bold=False, mono=False, rotated=False):
    return (doc, page, line, no, text, float(x0), float(y0), float(x1 if x1 is not None else x0 + 5 * len(text)), float(y0 + size), float(size), bold, mono, rotated)


def lines(spark, spans, pages=((1, 600.0, 800.0),), doc="d"):
    table = spark.createDataFrame(spans, layout.SPANS)
    units = spark.createDataFrame([(doc, p, w, h, 0) for p, w, h in pages], layout.PAGES)
    return layout.page_lines(table, units).orderBy("document_id", "unit", "line").collect()


def texts(found):
    return [r.text for r in found]


def test_visual_lines(spark):
    spans = [
        span(0, "Split", 10, 100), span(1, "heading", 40, 101),  # one baseline, a small gap: one line with a space
        span(2, "left box", 10, 130), span(3, "right box", 300, 130), span(4, "left again", 10, 145),  # boxes side by side stay apart
        span(5, "shadow", 10, 170), span(6, "shadow", 10.2, 170.3),  # drawn twice
        span(7, "short", 10, 200, 60), span(8, "longer text wins", 12, 200, 90), span(9, "tiny", 20, 201, 50),  # printed over each other
        span(10, "7", 5, 230, 9, size=6.0), span(10, "int x = 1;", 20, 228, 80, no=1, mono=True),  # a gutter number
        span(11, "turned", 500, 300, rotated=True), span(12, "   ", 10, 310),
        span(13, "no", 10, 330, 20), span(13, "gap", 20.5, 330, 35, no=1), span(13, " own space", 40, 330, 90, no=2),
    ]
    assert texts(lines(spark, spans)) == ["Split heading", "left box", "right box", "left again", "shadow", "longer text wins", "int x = 1;", "nogap own space"]


def test_kinds_of_a_document(spark):
    body = [span(10 + i, f"body text of the page number {i} goes on and on", 10, 200 + 12 * i) for i in range(20)]
    spans = [span(0, "Great Title", 10, 20, size=20.0), span(1, "Part one", 10, 60, size=14.0), span(2, "Bold words", 10, 100, bold=True), span(3, "Bold sentence.", 10, 112, bold=True), span(4, "Answer: bold", 10, 124, bold=True), *body, span(40, "12", 10, 700, size=6.0), span(41, "for (;;) {", 30, 500, mono=True)]
    found = {r.text: (r.kind, r.level) for r in lines(spark, spans)}
    assert found["Great Title"] == ("heading", 1) and found["Part one"] == ("heading", 2) and found["Bold words"] == ("heading", 3)
    assert found["Bold sentence."] == ("text", 0) and found["Answer: bold"] == ("text", 0) and "12" not in found
    # monospace under 2 % of the characters: code is told by its looks
    assert found["for (;;) {"] == ("code", 0)
    plain = {r.text: r.kind for r in lines(spark, [*body, span(50, "listing without signs of code at all", 10, 500, mono=True)])}
    assert plain["listing without signs of code at all"] == "code"


def test_slides(spark):
    spans = [span(0, "Deck", 100, 300, size=40.0), span(1, "first words of it", 10, 500)]
    spans += [x for p in (2, 3) for x in (span(0, f"Slide {p}", 10, 20, size=30.0, page=p), span(1, "o point", 10, 300, page=p), span(2, "Large but low", 10, 400, size=30.0, page=p), *[span(3 + i, "words of the body", 10, 420 + 12 * i, page=p) for i in range(5)])]
    table, pages = spark.createDataFrame(spans, layout.SPANS), spark.createDataFrame([("d", p, 800.0, 600.0, p - 1) for p in (1, 2, 3)], layout.PAGES)
    found = layout.page_lines(table, pages)
    assert [(r.unit, r.text) for r in found.where("kind = 'heading'").orderBy("unit").collect()] == [(1, "Deck"), (2, "Slide 2"), (3, "Slide 3")]
    assert [tuple(r) for r in layout.page_units(found, pages).select("unit", "title", "images").orderBy("unit").collect()] == [(1, "Deck", 0), (2, "Slide 2", 1), (3, "Slide 3", 2)]
    blocks = {(r.type, r.text) for r in clean.clean(found).collect()}
    assert ("heading", "Slide 2") in blocks and not any(kind == "list_item" for kind, _ in blocks)


def test_paragraphs_and_tables_without_rows(spark):
    found = lines(spark, [span(0, "First line of a paragraph here", 10, 100, 500), span(1, "second", 10, 111, 60), span(2, "third after a gap", 10, 150, 100)])
    assert [r.para_break for r in found] == ["para", "wrap", "para"]
    assert lines(spark, []) == [] and lines(spark, [span(0, " ", 1, 1)]) == []


@pytest.mark.parametrize(("y1", "width", "out"), [(20.0, 5.0, "a_b"), (15.0, 5.0, "a b"), (20.0, 30.0, "a b"), (20.0, 1.0, "a b")])
def test_underscores(spark, y1, width, out):
    chars = [("a", 0.0, 5.0, 20.0), (" ", 5.0, 10.0, 20.0), ("b", 10.0, 15.0, 20.0)]
    row = spark.createDataFrame([(chars, [(5.0, 5.0 + width, y1)])], "c array<struct<c string, x0 double, x1 double, y1 double>>, s array<struct<x0 double, x1 double, y1 double>>")
    assert row.select(layout.underscores(F.col("c"), F.col("s"), F.lit(10.0))).first()[0] == out
    assert row.select(layout.underscores(F.col("c"), F.lit(None).cast("array<struct<x0:double,x1:double,y1:double>>"), F.lit(10.0))).first()[0] == "a b"


def test_spans_are_shuffled_once(spark):
    """Each step of a page used to shuffle its spans anew (F2)."""
    from corvane.plans import pages as plans

    spans = spark.createDataFrame([("d", 1, i // 3, i, f"w{i}", 10.0 * i, 10.0 * (i // 3), 10.0 * i + 8, 10.0 * (i // 3) + 8, 8.0, False, False, False) for i in range(9)], layout.SPANS)
    moves = lambda rows: rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert moves(layout.visual_lines(spans)) == 1 and layout.visual_lines(spans).count() == 3
    made, pages = plans.made_pages(spark, "/root/testdata/sf0.001")
    assert moves(layout.visual_lines(made, dealt=True)) == 1  # the texts
    assert pages.groupBy("document_id", "page").count().where("count > 1").isEmpty() and made.select("document_id", "page").subtract(pages.select("document_id", "page")).isEmpty()
