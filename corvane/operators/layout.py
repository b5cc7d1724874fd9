"""Pages from spans: what a PDF reader finds (runs of characters with boxes and fonts) becomes visual lines, then LINES.

A page is assembled in two dimensions.  The reader's own lines are fragments.  Sorted by the middle of their height, they
fall into bands, a new one where the step down is over half the lower height.  In a band, of fragments printed over each
other the longest stays, and the rest are cut into visual lines where the gap is 1.5 type sizes or more, so boxes side by
side stay apart.  Lines keep the place of their first fragment, so the reading order is the reader's.

Everything is windows over a page's fragments and expressions over a line's spans; no step has more than a page in a row.

SPANS is the input, one row a span; PAGES has a row for each page.  Rotated spans, blank ones and a text drawn twice at
one place do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.lines import ANSWER
from corvane.functions.text import code_like
from corvane.operators.clean import paragraph_breaks
from corvane.sources.shared import stored

SPANS = "document_id string, page int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, mono boolean, rotated boolean"
PAGES = "document_id string, page int, width double, height double, images int"
# Shares of a type size that part words and lines, how far boxes may touch, what is large, small or code.
WORD_GAP, LINE_GAP, TOUCH, HEADING, SLIDE_TITLE, GUTTER, TINY = 0.15, 1.5, -2.0, 1.08, 1.15, 0.75, 0.7
MONO_LINE, MONO_DOCUMENT, TITLE_ZONE, BOLD_CHARS = 0.7, 0.02, 0.25, 80

PAGE = ("document_id", "page")
OF_ITEM = "struct<line:int,x0:double,x1:double,y0:double,y1:double,length:bigint,size:double,spans:array<struct<x0:double,span:int,x1:double,text:string,size:double,bold:boolean,mono:boolean>>>"


def underscores(chars: Column, strokes: Column, size: Column) -> Column:
    """The text of chars array<struct<c, x0, x1, y1>>: a space under which a short stroke of the page lies is an underscore.

    strokes array<struct<x0, x1, y1>> may be null; a stroke counts that is on the base of the space, covers most of it and
    is not much longer.
    """

    def one(ch: Column) -> Column:
        wide = ch["x1"] - ch["x0"]
        under = lambda s: (F.abs(s["y1"] - ch["y1"]) < 0.35 * size) & (F.least(s["x1"], ch["x1"]) - F.greatest(s["x0"], ch["x0"]) > 0.6 * wide) & (s["x1"] - s["x0"] < 1.5 * wide)
        return F.when((ch["c"] == " ") & F.coalesce(F.exists(strokes, under), F.lit(False)), "_").otherwise(ch["c"])

    return F.array_join(F.transform(chars, one), "")


def fragments(spans: DataFrame, dealt: bool = False) -> DataFrame:
    """(document_id, page, line, x0, x1, y0, y1, size, length, spans) of the reader's lines.

    Spans are shuffled once, by page, and no later step moves them; not at all if they are ``dealt`` already, which says
    that they come partitioned by document or page.
    """
    good = spans.where(~F.coalesce("rotated", F.lit(False)) & (F.trim("text") != ""))
    good = good if dealt else good.repartition(*PAGE)
    place = Window.partitionBy(*PAGE, F.trim("text"), F.round("x0"), F.round("y0")).orderBy("line", "span")
    good = good.withColumn("again", F.row_number().over(place)).where("again = 1")
    held = F.collect_list(F.struct("x0", "span", "x1", "text", "size", "bold", "mono"))
    size = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.max("size").alias("size")]
    return good.groupBy(*PAGE, "line").agg(*size, F.sum(F.char_length(F.trim("text"))).alias("length"), F.sort_array(held).alias("spans"))


def bands(found: DataFrame) -> DataFrame:
    """Fragments with the number of their band on the page."""
    down = Window.partitionBy(*PAGE).orderBy("middle", "line")
    rows = found.withColumns({"middle": (F.col("y0") + F.col("y1")) / 2, "high": F.col("y1") - F.col("y0")})
    new = (F.col("middle") - F.lag("middle").over(down) > 0.5 * F.least("high", F.lag("high").over(down))).cast("int")
    return rows.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("band", F.sum("new").over(down)).drop("new", "middle", "high")


def _not_overprinted(items: Column) -> Column:
    """Of a band's fragments in reading order: one that lies over others takes their place if it is longer than each."""

    def step(kept: Column, x: Column) -> Column:
        over = lambda v: F.greatest(x["x0"] - v["x1"], v["x0"] - x["x1"]) < TOUCH
        longer = F.forall(kept, lambda v: ~over(v) | (x["length"] > v["length"]))
        return F.when(longer, F.concat(F.filter(kept, lambda v: ~over(v)), F.array(x))).otherwise(kept)

    return F.aggregate(items, F.array().cast(f"array<{OF_ITEM}>"), step)


def visual_lines(spans: DataFrame, dealt: bool = False) -> DataFrame:
    """(document_id, page, line, y0, y1, spans): spans from left to right, gutter numbers before them left out."""
    item = F.struct(*[F.col(c) for c in ("line", "x0", "x1", "y0", "y1", "length", "size", "spans")])
    kept = bands(fragments(spans, dealt)).groupBy(*PAGE, "band").agg(F.sort_array(F.collect_list(item)).alias("items"))
    rows = kept.select(*PAGE, "band", F.explode(_not_overprinted(F.col("items").cast(f"array<{OF_ITEM}>"))).alias("i")).select(*PAGE, "band", "i.*")
    along = Window.partitionBy(*PAGE, "band").orderBy("x0", "line")
    before = F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce((F.col("x0") - before >= LINE_GAP * F.col("size")).cast("int"), F.lit(0))
    rows = rows.withColumn("cut", cut).withColumn("part", F.sum("cut").over(along))
    joined = rows.groupBy(*PAGE, "band", "part").agg(F.min("line").alias("line"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.max("size").alias("most"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    text_at = F.array_position(F.transform("spans", lambda s: ~(F.trim(s["text"]).rlike("^[0-9]+$") & (s["size"] < GUTTER * F.col("most")))), True)
    start = F.when(text_at == 0, F.size("spans")).otherwise(text_at).cast("int")
    return joined.withColumn("spans", F.slice("spans", start, F.size("spans"))).drop("most", "band", "part")


def line_text(spans: Column) -> Column:
    """The texts of spans, a space between two where neither has one and the gap is over 0.15 type sizes."""

    def piece(s: Column, i: Column) -> Column:
        last = F.get(spans, i - 1)
        apart = (i > 0) & ~last["text"].rlike(r"\s$") & ~s["text"].rlike(r"^\s") & (s["x0"] - last["x1"] > WORD_GAP * s["size"])
        return F.concat(F.when(apart, " ").otherwise(""), s["text"])

    return F.regexp_replace(F.array_join(F.transform(spans, piece), ""), r"\s+$", "")


def dominant_size(spans: Column) -> Column:
    """The type size, to one place, of most characters; of equal ones the first."""
    own = F.transform(spans, lambda s: F.struct(F.round(s["size"], 1).alias("z"), F.char_length(F.trim(s["text"])).alias("n")))
    sizes = F.array_distinct(F.transform(own, lambda o: o["z"]))
    total = lambda z: F.aggregate(own, F.lit(0), lambda a, o: a + F.when(o["z"] == z, o["n"]).otherwise(0))
    return F.array_max(F.transform(sizes, lambda z, i: F.struct(total(z).alias("n"), (-i).alias("i"), z.alias("z"))))["z"]


def measured(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """visual_lines with text and what the rules need to know of it; lines without text are left out."""
    n = F.char_length(F.trim("text"))
    mono = F.aggregate("spans", F.lit(0), lambda a, s: a + F.when(s["mono"], F.char_length(F.trim(s["text"]))).otherwise(0))
    first = F.coalesce(F.get(F.filter("spans", lambda s: s["mono"]), F.lit(0)), F.col("spans")[0])
    # an explode of one: a filter on text would otherwise be pushed into the lambdas, and each step build the line anew
    rows = lines.select("*", F.explode(F.array(line_text(F.col("spans")))).alias("text")).where(F.trim("text") != "")
    rows = rows.select(
        *PAGE, "line", "text", n.cast("long").alias("n"), dominant_size(F.col("spans")).alias("size"), mono.cast("long").alias("mono_chars"), F.forall("spans", lambda s: s["bold"]).alias("bold"),
        F.round(first["x0"], 1).alias("x0"), F.array_max(F.transform("spans", lambda s: s["x1"])).alias("x1"), "y0", "y1",
        F.round((first["x1"] - first["x0"]) / F.greatest(F.char_length(first["text"]), F.lit(1)), 2).alias("cw"), F.trim("text").rlike("^[0-9]+$").alias("digits"),
    )
    # the page is met when the spans are gone
    share = {"top": F.round(F.col("y0") / F.col("height"), 3), "bottom": F.round(F.col("y1") / F.col("height"), 3)}
    return rows.join(pages.select(*PAGE, "height"), list(PAGE)).withColumns(share).drop("height")


def typography(lines: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document_id, body, font_code, slides, sizes) and (document_id, size, heading): the body's size is that of most
    characters, larger ones are headings by rank; slides are pages wider than high, most of them."""
    sizes = lines.groupBy("document_id", "size").agg(F.sum("n").alias("n"), F.min(F.struct("page", "line")).alias("first"))
    body = sizes.groupBy("document_id").agg(F.max_by("size", F.struct("n", (-F.col("first.page")).alias("p"), (-F.col("first.line")).alias("l"))).alias("body"))
    code = lines.groupBy("document_id").agg((F.sum("mono_chars") / F.sum("n") >= MONO_DOCUMENT).alias("font_code"))
    wide = pages.groupBy("document_id").agg((F.count_if(F.col("width") > F.col("height")) > F.count(F.lit(1)) / 2).alias("slides"))
    large = sizes.join(body, "document_id").where(F.col("size") >= F.col("body") * HEADING)
    ranks = large.select("document_id", "size", F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("size").desc())).alias("heading"))
    counts = ranks.groupBy("document_id").agg(F.max("heading").alias("sizes"))
    return body.join(code, "document_id").join(wide, "document_id", "left").join(counts, "document_id", "left").fillna(0, "sizes").fillna(False, "slides"), ranks


def page_lines(spans: DataFrame, pages: DataFrame, dealt: bool = False) -> DataFrame:
    """SPANS and PAGES -> LINES (with size): headings, code, paragraph breaks and margins, from the layout alone."""
    lines = stored(measured(visual_lines(spans, dealt), pages))
    types, ranks = typography(lines, pages)
    page = Window.partitionBy(*PAGE)
    titled = (F.col("top") < TITLE_ZONE) | (F.col("page") == 1)
    # ranks of sizes go with the document's row: joined by size, the lines would be shuffled a second time
    own = ranks.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("size", "heading"))).alias("ranks"))
    rows = lines.join(types.join(own, "document_id", "left"), "document_id").withColumn("heading", F.try_element_at("ranks", F.col("size"))).drop("ranks").withColumn("title_size", F.max(F.when(titled, F.col("size"))).over(page))
    rows = rows.where(~(F.col("digits") & (F.col("size") <= TINY * F.col("body"))))
    share = F.col("mono_chars") / F.col("n")
    title = (F.col("size") == F.col("title_size")) & (F.col("title_size") >= SLIDE_TITLE * F.col("body")) & titled
    strong = F.col("bold") & (F.char_length("text") <= BOLD_CHARS) & ~F.col("text").rlike("(?i)" + ANSWER.pattern) & ~F.rtrim("text").endswith(".")
    large = (F.col("size") >= HEADING * F.col("body")) & (share < 0.5)
    level = F.when(F.col("slides"), F.when(title, 1)).when(large, F.least("heading", F.lit(3))).when(strong, F.least(F.col("sizes") + 1, F.lit(4)))
    code = F.when(F.col("font_code"), share >= MONO_LINE).otherwise(code_like(F.col("text")))
    kind = F.when(level.isNotNull(), "heading").when(code, "code").otherwise("text")
    rows = rows.withColumns({"kind": kind, "level": F.coalesce(level, F.lit(0)), "unit": F.col("page"), "line": F.row_number().over(page.orderBy("line")) - 1})
    rows = paragraph_breaks(rows)
    return rows.select("document_id", "unit", F.lit("page").alias("unit_kind"), "line", "text", "kind", "level", "para_break", "top", "bottom", "x0", "cw", F.lit(None).cast("string").alias("error"), "size", "slides")


def page_units(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, unit, title, images): the first heading of a slide is its title."""
    heads = lines.where(F.col("slides") & (F.col("kind") == "heading")).groupBy("document_id", "unit").agg(F.min_by(F.trim("text"), "line").alias("title"))
    return pages.select("document_id", F.col("page").alias("unit"), F.coalesce("images", F.lit(0)).alias("images")).join(heads, ["document_id", "unit"], "left")
