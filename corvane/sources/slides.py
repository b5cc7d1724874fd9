"""PowerPoint files (Office Open XML) as lines, by the standard library alone.

A slide is a unit.  Its title is the title placeholder or, without one, the short first line of a box in the top
quarter.  Boxes are read from top to bottom, then left to right; a placeholder that has no position of its own takes
that of its layout's placeholder, else it comes first.  Footers, dates and slide numbers are left out.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

from corvane.functions.lines import MONOSPACE

A, P = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SKIPPED, TITLES, TITLE_CHARS = {"ftr", "sldNum", "dt"}, {"title", "ctrTitle"}, 80


def _squeezed(text: str) -> str:
    return re.sub(r"[ \t\v\xa0]+", " ", text).strip()


@dataclass
class Package:
    archive: zipfile.ZipFile

    def part(self, name: str) -> Element:
        return ElementTree.fromstring(self.archive.read(name))

    def links(self, name: str) -> list[tuple[str, str, str]]:
        """(id, kind, part) of what a part refers to inside the package."""
        folder, file = posixpath.split(name)
        path = f"{folder}/_rels/{file}.rels"
        if path not in self.archive.namelist():
            return []
        inside = (r for r in self.part(path) if r.get("TargetMode") != "External")
        return [(r.get("Id"), r.get("Type").rsplit("/", 1)[-1], posixpath.normpath(posixpath.join("/", folder, r.get("Target"))).lstrip("/")) for r in inside]


def _shapes(tree: Element) -> Iterator[Element]:
    for node in tree:
        if node.tag == f"{P}grpSp":
            yield from _shapes(node)
        elif node.tag in (f"{P}sp", f"{P}pic", f"{P}graphicFrame"):
            yield node


def _placeholder(shape: Element) -> tuple[str, str] | None:
    found = shape.find(f"./*/{P}nvPr/{P}ph")
    return None if found is None else (found.get("type", "obj"), found.get("idx", "0"))


def _place(shape: Element) -> tuple[int, int] | None:
    off = next(iter(shape.iterfind(f".//{A}xfrm/{A}off")), None) if shape.tag != f"{P}graphicFrame" else shape.find(f"{P}xfrm/{A}off")
    return None if off is None else (int(off.get("y")), int(off.get("x")))


def _text(paragraph: Element) -> str:
    return "".join("\n" if e.tag == f"{A}br" else e.text or "" for e in paragraph.iter() if e.tag in (f"{A}t", f"{A}br"))


def _paragraphs(shape: Element) -> list[Element]:
    return shape.findall(f"{P}txBody/{A}p")


def _line(no: int, text: str, kind: str, level: int = 0, para_break: str = "para", raw: str | None = None) -> dict:
    return {"text": text, "kind": kind, "level": level, "para_break": para_break, "unit": no, "unit_kind": "slide", "raw": raw}


def _body(no: int, shape: Element, title: str | None) -> Iterator[dict]:
    if rows := shape.findall(f".//{A}tbl/{A}tr"):
        cells = [[_squeezed("\n".join(map(_text, cell.iter(f"{A}p")))) for cell in row.findall(f"{A}tc")] for row in rows]
        yield _line(no, "\n".join(f"| {' | '.join(row)} |" for row in cells), "table")
    for p in _paragraphs(shape):
        text = _text(p).replace("\v", "\n").rstrip()
        if not text.strip() or _squeezed(text) == title:
            continue
        said = [r for r in p.findall(f"{A}r") if (r.findtext(f"{A}t") or "").strip()]
        fonts = [r.find(f"{A}rPr/{A}latin") for r in said]
        mono = bool(fonts) and all(f is not None and MONOSPACE.search(f.get("typeface", "")) for f in fonts)
        properties = p.find(f"{A}pPr")
        level = 0 if properties is None else int(properties.get("lvl", 0))
        yield _line(no, text, "code", level, "wrap") if mono else _line(no, _squeezed(text), "bullet", level, raw=text)


def pptx_lines(content: bytes) -> Iterator[dict]:
    """Headings, bullets, code, tables and notes of every slide, in order of the slides."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        package = Package(archive)
        deck = package.part("ppt/presentation.xml")
        size = deck.find(f"{P}sldSz")
        top = 0.25 * (int(size.get("cy")) if size is not None else 1)
        parts = {key: part for key, _, part in package.links("ppt/presentation.xml")}
        for no, entry in enumerate(deck.iterfind(f"{P}sldIdLst/{P}sldId"), 1):
            name = parts[entry.get(LINK)]
            links = {kind: part for _, kind, part in package.links(name)}
            layout = {}
            if "slideLayout" in links:
                layout = {_placeholder(s): _place(s) for s in _shapes(package.part(links["slideLayout"]).find(f"{P}cSld/{P}spTree"))}
            shapes = [s for s in _shapes(package.part(name).find(f"{P}cSld/{P}spTree")) if (_placeholder(s) or ("",))[0] not in SKIPPED]
            place = {id(s): _place(s) or (layout.get(_placeholder(s)) if _placeholder(s) else None) or (0, 0) for s in shapes}
            whole = lambda s: "\n".join(map(_text, _paragraphs(s))).strip()
            head = next((s for s in shapes if (_placeholder(s) or ("",))[0] in TITLES and whole(s)), None)
            body = sorted((s for s in shapes if s is not head), key=lambda s: place[id(s)])
            title = _squeezed(whole(head)) if head is not None else None
            if head is None and body and place[id(body[0])][0] < top and 0 < len(first := whole(body[0]).split("\n")[0].strip()) <= TITLE_CHARS:
                title = _squeezed(first)
            if title:
                yield _line(no, title, "heading", 1)
            for shape in body:
                yield from _body(no, shape, title)
            if "notesSlide" in links:
                spoken = [whole(s) for s in _shapes(package.part(links["notesSlide"]).find(f"{P}cSld/{P}spTree")) if (_placeholder(s) or ("",))[0] == "body"]
                if notes := "\n".join(filter(None, spoken)):
                    yield _line(no, notes, "notes")


def _boxes(package: Package, name: str) -> Iterator[Element]:
    yield from _shapes(package.part(name).find(f"{P}cSld/{P}spTree"))


def deck_details(content: bytes) -> tuple[str, list[tuple[int, int]]]:
    """(lines of text of the masters and their layouts, prompts and repeats left out; (slide, pictures) of each slide)."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        package = Package(archive)
        deck = package.part("ppt/presentation.xml")
        links = package.links("ppt/presentation.xml")
        parts = {key: part for key, _, part in links}
        said: dict[str, None] = {}
        for master in (part for _, kind, part in links if kind == "slideMaster"):
            for name in (master, *[part for _, kind, part in package.links(master) if kind == "slideLayout"]):
                texts = (_squeezed("\n".join(map(_text, _paragraphs(s)))) for s in _boxes(package, name))
                said |= dict.fromkeys(t for t in texts if t and not t.lower().startswith("click"))
        slides = [parts[e.get(LINK)] for e in deck.iterfind(f"{P}sldIdLst/{P}sldId")]
        return "\n".join(said), [(no, sum(s.tag == f"{P}pic" for s in _boxes(package, name))) for no, name in enumerate(slides, 1)]
