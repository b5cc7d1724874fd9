"""Slides built by hand, indexes that grow, embeddings by a made model, layered prompts, citation groups."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import dialogue, embedding
from corvane.plans.ingest import ingest
from corvane.sources import files
from corvane.sources.listing import Entry, FolderReader, listing
from corvane.sources.slides import pptx_lines

NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def box(text, place=None, ph=None, font=None, level=0):
    xfrm = f'<a:xfrm><a:off x="{place[1]}" y="{place[0]}"/></a:xfrm>' if place else ""
    own = f'<p:ph type="{ph}"/>' if ph else ""
    style = f'<a:rPr><a:latin typeface="{font}"/></a:rPr>' if font else ""
    paragraphs = "".join(f'<a:p><a:pPr lvl="{level}"/><a:r>{style}<a:t>{t}</a:t></a:r></a:p>' for t in text.split("\n"))
    return f"<p:sp><p:nvSpPr><p:nvPr>{own}</p:nvPr></p:nvSpPr><p:spPr>{xfrm}</p:spPr><p:txBody>{paragraphs}</p:txBody></p:sp>"


def tree(kind, shapes):
    return f"<p:{kind} {NS}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:{kind}>"


def rels(*links):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{REL}/{kind}" Target="{target}"/>' for i, kind, target in links) + "</Relationships>"


def deck():
    table = '<p:graphicFrame><p:nvGraphicFramePr><p:nvPr/></p:nvGraphicFramePr><p:xfrm><a:off x="0" y="900"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>a  b</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p/></a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    one = box("below", (500, 0), level=1) + box("right", (300, 9)) + f"<p:grpSp>{box('left', (300, 1))}</p:grpSp>" + box("Locks  and more", ph="title") + box("page 1", ph="sldNum") + box("x = 1", (600, 0), font="Courier New") + table
    two = box("Untitled but short\nthen this", (10, 0)) + box("late", (800, 0))
    parts = {
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst><p:sldSz cx="1000" cy="1000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "slides/slide2.xml")),
        "ppt/slides/slide2.xml": tree("sld", one),
        "ppt/slides/_rels/slide2.xml.rels": rels(("r1", "notesSlide", "../notesSlides/n.xml")),
        "ppt/notesSlides/n.xml": tree("notes", box("say this", ph="body") + box("7", ph="sldNum")),
        "ppt/slides/slide1.xml": tree("sld", two),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


def test_slides(spark):
    got = [(r["unit"], r["kind"], r["level"], r["text"]) for r in pptx_lines(deck())]
    assert got == [
        (1, "heading", 1, "Locks and more"), (1, "bullet", 0, "left"), (1, "bullet", 0, "right"), (1, "bullet", 1, "below"),
        (1, "code", 0, "x = 1"), (1, "table", 0, "| a b |  |"), (1, "notes", 0, "say this"),
        (2, "heading", 1, "Untitled but short"), (2, "bullet", 0, "then this"), (2, "bullet", 0, "late"),
    ]
    rows = spark.createDataFrame([("d1", "pptx", deck()), ("d2", "pptx", b"no zip"), ("d3", "txt", b"plain")], "document_id string, file_type string, content binary")
    found = files.extract_lines(rows).orderBy("document_id", "line").collect()
    assert [(r.unit, r.unit_kind, r.line) for r in found if r.document_id == "d1"][6:8] == [(1, "slide", 6), (2, "slide", 7)]
    assert [(r.unit_kind, r.error is None) for r in found if r.document_id != "d1"] == [("section", False), ("section", True)]


def test_embed(spark):
    spec = embedding.Spec("toy", 2, 4, "doc: ")

    def model(texts):
        if "boom" in texts[0]:
            raise RuntimeError("down")
        return np.array([[3.0, 4.0]]) * ("null" not in texts[0])

    rows = spark.createDataFrame([("a", "two words"), ("b", " "), ("c", None), ("d", "one two three four"), ("e", "boom"), ("f", "null")], "chunk_id string, text string")
    got = {r.chunk_id: (r.vector, r.error) for r in embedding.embed(rows, spec, lambda t: len(t.split()), model).collect()}
    assert got["a"] == (pytest.approx([0.6, 0.8]), None)
    assert got["b"][1] == got["c"][1] == "empty input" and got["d"][1] == "input has 5 tokens, toy takes 4"
    assert got["e"][1] == "RuntimeError: down" and "2 finite" in got["f"][1] and all(got[k][0] is None for k in "bcdef")
    known = embedding.Registry()
    known.add(spec)
    assert known["toy"] is spec
    with pytest.raises(ValueError, match="unknown model"):
        known["none"]
    with pytest.raises(ValueError, match="other properties"):
        known.add(embedding.Spec("toy", 3, 4))


def test_prompts(spark):
    history = "array<struct<who: string, text: string>>"
    rows = [(1, "CHECK", "Why?", [("Tutor", "Hm?"), ("Student", "Because.")]), (2, "NONE", "How?", []), (3, "CHECK", "Who?", None)]
    sessions = spark.createDataFrame(rows, f"session_id long, stage string, question string, history {history}")
    context = spark.createDataFrame([(1, 2, "S2", "f", None, "s", "second"), (1, 1, "S1", "g", "p.3", None, "first")], "session_id long, rank int, ref string, filename string, location string, section string, text string")
    got = {r.session_id: r.prompt for r in dialogue.prompts(sessions, context, "P", {"CHECK": "ask"}, "G", "S").collect()}
    assert got[1].startswith("TUTOR POLICY\nP\n\nGROUNDING\nG\n\nHOW TO WRITE TO THE STUDENT\nS\n\nTASK\nask\n\nCOURSE CONTEXT\n[S1] g (p.3) \nfirst\n\n[S2] f (-) s\nsecond\n\nSTUDENT QUESTION\nWhy?\n\n")
    assert got[1].endswith("to follow)\nTutor: Hm?\n\nSTUDENT'S LAST MESSAGE\nBecause.")
    assert all("to follow)\n(none)\n\nSTUDENT'S LAST MESSAGE\n(none yet)" in got[i] for i in (2, 3))
    assert "HOW TO WRITE" not in dialogue.prompts(sessions, context, "P", {}).first().prompt


def test_citation_groups(spark):
    said = {"x[S9, S1]": "x [S1]", "x[S1, S9] y": "x[S1] y", "[S9]": "", "a [S2,3].": "a [S2] [S3].", "b [S7] .": "b."}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", dialogue.validated(F.col("t"), F.lit(3)).alias("v"))
    assert {r.t: r.v for r in rows.collect()} == said


CORE = '<cp:coreProperties xmlns:cp="c" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> Locks </dc:title><dc:creator>A. Author</dc:creator><cp:lastModifiedBy/></cp:coreProperties>'


def with_parts(content, parts):
    out = io.BytesIO(content)
    with zipfile.ZipFile(out, "a") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


def lecture():
    """A deck with a master, a slide that is a picture, notes and properties."""
    picture = "<p:pic><p:nvPicPr><p:nvPr/></p:nvPicPr></p:pic>"
    words = " ".join(f"semaphore{i}" for i in range(60))
    parts = {
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldIdLst><p:sldId r:id="r1"/><p:sldId r:id="r2"/><p:sldId r:id="r3"/></p:sldIdLst><p:sldSz cx="1000" cy="1000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/1.xml"), ("r2", "slide", "slides/2.xml"), ("r3", "slide", "slides/3.xml"), ("m", "slideMaster", "masters/m.xml")),
        "ppt/masters/m.xml": tree("sldMaster", box("Operating System Concepts") + box("Click to edit")),
        "ppt/slides/1.xml": tree("sld", box("Lecture 1", ph="title") + picture), "ppt/slides/2.xml": tree("sld", box("A picture", ph="title") + picture),
        "ppt/slides/3.xml": tree("sld", box("Locks", ph="title") + box(f"o {words}\nint x = 1;")), "docProps/core.xml": CORE,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w"):
        pass
    return with_parts(out.getvalue(), parts)


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, style=None, level=None, font=None):
    own = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/></w:numPr>' if level is not None else "")
    fonts = f'<w:rPr><w:rFonts w:ascii="{font}"/></w:rPr>' if font else ""
    return f"<w:p><w:pPr>{own}</w:pPr><w:r>{fonts}<w:t>{text}</w:t></w:r></w:p>"


def letter():
    body = paragraph("Title  here", "Title") + paragraph("Part", "Heading2") + paragraph("plain  text") + paragraph("item", level=1) + paragraph("listed", "ListParagraph") + paragraph("x  = y", "SourceCode")
    body += paragraph("mono", font="Courier New") + paragraph("int z;", level=0) + paragraph(" ") + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        archive.writestr("docProps/core.xml", CORE)
    return out.getvalue()


def test_word(spark):
    rows = spark.createDataFrame([("w", "docx", letter())], "document_id string, file_type string, content binary")
    got = [(r.kind, r.level, r.text, r.para_break) for r in files.extract_lines(rows).orderBy("line").collect()]
    assert got == [
        ("heading", 1, "Title here", "para"), ("heading", 2, "Part", "para"), ("text", 0, "plain  text", "para"), ("bullet", 1, "item", "para"), ("bullet", 0, "listed", "para"),
        ("code", 0, "x  = y", "wrap"), ("code", 0, "mono", "wrap"), ("code", 0, "int z;", "wrap"), ("table", 0, "| a |  |", "para"),
    ]
    assert files.extract_details(rows).first().properties == {"title": "Locks", "author": "A. Author"}


def test_listing(spark, tmp_path):
    for name in ("a.txt", ".hidden", "sub/b.md", "sub/.git/c.txt", ".cache/d/e.txt", "_under/f.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    rows = {r.relative_path: (r.hidden, r.length, r.error) for r in listing(spark, str(tmp_path)).collect()}
    assert rows == {n: (h, len(n), None) for n, h in (("a.txt", False), (".hidden", True), ("sub/b.md", False), ("sub/.git/c.txt", True), (".cache/d/e.txt", True), ("_under/f.txt", False))}
    (tmp_path / "empty").mkdir()
    assert listing(spark, str(tmp_path / "empty")).collect() == [] and listing(spark, f"file://{tmp_path}").count() == 6
    _, _, ignored = files.scan(spark, str(tmp_path))
    assert {r.relative_path for r in ignored.collect()} == {".hidden", "sub/.git/c.txt", ".cache/d/e.txt"}
    gone = FolderReader(str(tmp_path))
    assert "Error" in next(gone.read(Entry(str(tmp_path / "no such folder"), True)))[-1]


def test_ingest_of_decks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "deck.pptx").write_bytes(lecture())
    (folder / "letter.docx").write_bytes(letter())
    (folder / ".DS_Store").write_bytes(b"1")
    (folder / "bad.pptx").write_bytes(b"no zip")
    out = ingest(spark, str(folder))
    docs = {r.filename: r for r in out["documents"].collect()}
    deck = docs["deck.pptx"]
    assert (deck.layout, deck.document_type, deck.image_only_units, deck.derived_from, deck.title) == ("slides", "lecture", [2], "Operating System Concepts", "Lecture 1")
    assert deck.properties["author"] == "A. Author" and docs["bad.pptx"].extraction_status == "failed" and docs["letter.docx"].title == "Title here"
    assert [r.relative_path for r in out["ignored"].collect()] == [".DS_Store"]
    codes = {(r.code, r.document_id) for r in out["issues"].collect()}
    assert not {c for c, _ in codes} & {"missing_location", "empty_chunk"} and {d for c, d in codes if c == "extraction_failed"} <= {docs["bad.pptx"].document_id}
    own = [r for r in out["chunks"].collect() if r.document_id == deck.document_id]
    assert all(r.slide_start and r.slide_end >= r.slide_start and r.page_start is None for r in own) and {r.chunk_type for r in own} == {"slide"}
    assert all(r.subtopics is not None and r.problem_types == [] for r in own)
    said = {(r.type, r.text[:3]) for r in out["blocks"].where("unit_kind = 'slide'").collect()}
    assert ("code", "int") in said and ("list_item", "sem") in said
    written = {r.document_id: r.markdown for r in out["markdown"].collect()}
    assert written[deck.document_id].startswith("<!-- deck.pptx -->\n\n<!-- slide 1 -->\n# Lecture 1")
