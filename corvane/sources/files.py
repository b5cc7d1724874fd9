"""Files in and out: scans, loaders for text, Markdown, DOCX and PPTX, chunk files.

PDF and binary PowerPoint need libraries that are not at hand: give their extracted lines as JSON in the LINES schema.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.lines import MONOSPACE
from corvane.functions.text import code_like, document_id, text_hash, topic_area
from corvane.sources.listing import listing
from corvane.sources.shared import stored  # noqa: F401  for callers of this module
from corvane.sources.slides import deck_details, pptx_lines

SUPPORTED = ("pdf", "pptx", "ppt", "docx", "txt", "md")
LINES = "document_id string, unit int, unit_kind string, line int, text string, kind string, level int, para_break string, top double, bottom double, x0 double, cw double, error string"
REQUIRED = ("chunk_id", "document_id", "text", "filename", "relative_path", "text_hash")


def scan(spark: SparkSession, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, unsupported, ignored) below a folder; files are read once, for their hash.

    Documents come by Spark's listing, which skips names that begin with a dot or underscore; what is ignored, hidden
    files and those in hidden folders, by a listing of its own (see corvane.sources.listing).
    """
    root = source.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^[a-z]+:/+(?=/)", "")
    relative = F.expr(f"substring(path, instr(path, '{root.split('://')[-1]}') + {len(root.split('://')[-1]) + 1})")
    rows = files.withColumns({"relative_path": relative, "absolute_path": path})
    name = F.element_at(F.split("relative_path", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"(?<=.)\.([^.]*)$", 1))
    rows = rows.withColumns({"filename": name, "file_type": kind})
    known = rows.where(F.col("file_type").isin(*SUPPORTED))
    documents = known.select(document_id(F.col("relative_path")).alias("document_id"), "filename", "relative_path", "absolute_path", "file_type", F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("file_hash"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("modified_time"), topic_area(F.col("relative_path")).alias("topic_area"), F.split("relative_path", "/").alias("corpus_pos"), "content")
    unsupported = rows.where(~F.col("file_type").isin(*SUPPORTED)).select("relative_path", F.col("file_type").alias("extension"), F.lit("unsupported format").alias("reason"))
    return documents, unsupported, listing(spark, root).where("hidden").select("relative_path")


#: What str.splitlines parts lines at.
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\u0085\u2028\u2029]"
RAW = "document_id string, unit int, unit_kind string, line int, text string, kind string, level int, para_break string, raw string, error string"


def text_lines(documents: DataFrame) -> DataFrame:
    """documents(document_id, content) of plain text or Markdown -> LINES: fences are code, # are headings, a blank line
    breaks a paragraph.  A line is inside a fence where the fence lines before it are odd in number."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    cut = F.split(text, LINE_END)
    cut = F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)
    rows = documents.select("document_id", F.posexplode(cut).alias("line", "row"))
    before = Window.partitionBy("document_id").orderBy("line")
    fence, heading = F.col("row").rlike(r"^\s*```"), r"^(#{1,6})\s+(.*)$"
    rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(before))
    inside = ~fence & (F.col("fences") % 2 == 1)
    what = F.when(fence, "fence").when(inside, "code").when(F.col("row").rlike(r"^\s*$"), "blank").when(F.col("row").rlike(heading), "heading").when(code_like(F.col("row")), "code").otherwise("text")
    rows = rows.withColumns({"what": what, "inside": inside})
    fresh = F.coalesce(F.lag(F.when(F.col("inside"), "code").otherwise(F.col("what"))).over(before).isin("fence", "blank", "heading"), F.lit(True))
    flat = F.when(F.col("inside"), F.col("row")).when(F.col("what") == "heading", F.trim(F.regexp_extract("row", heading, 2))).otherwise(F.regexp_replace("row", r"\s+$", ""))
    level = F.when(F.col("what") == "heading", F.char_length(F.regexp_extract("row", heading, 1))).otherwise(0)
    broken = F.when(~F.col("inside") & (fresh | (F.col("what") == "heading")), "para").otherwise("wrap")
    rows = rows.select("document_id", F.lit(0).alias("unit"), F.lit("section").alias("unit_kind"), "line", flat.alias("text"), F.col("what").alias("kind"), level.alias("level"), broken.alias("para_break"))
    return _as_lines(rows.where("kind not in ('fence', 'blank')"))


def _as_lines(rows: DataFrame) -> DataFrame:
    """Rows with the columns of LINES alone, null where they have none."""
    columns = [c.split() for c in LINES.split(", ")]
    return rows.select(*[F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in columns])


WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SAID = {"t": lambda e: e.text or "", "tab": lambda _: "\t", "br": lambda _: "\n", "cr": lambda _: "\n"}


class Paragraph:
    """What decides the kind of a Word paragraph: its style, the depth of its numbering (-1: none), its fonts."""

    def __init__(self, node: ElementTree.Element) -> None:
        value = lambda path: next((e.get(f"{WORD_NS}val") or "" for e in node.iterfind(path.replace("w:", WORD_NS))), None)
        self.text = "".join(SAID[tag](e) for e in node.iter() if (tag := e.tag.removeprefix(WORD_NS)) in SAID)
        self.flat = " ".join(self.text.split())
        self.style = value("w:pPr/w:pStyle") or ""
        listed = node.find(f"{WORD_NS}pPr/{WORD_NS}numPr") is not None
        self.depth = int(value("w:pPr/w:numPr/w:ilvl") or 0) if listed else -1
        self.fonts = [f.get(f"{WORD_NS}ascii") or "" for f in node.iter(f"{WORD_NS}rFonts")]


#: Kinds of paragraphs, the first whose rule holds: (kind, rule, what it makes of the paragraph).
KINDS = (
    (re.compile(r"(?i)(?:heading|title)\s*(\d*)"), lambda p, m: {"kind": "heading", "text": p.flat, "level": int(m[1] or 1)}),
    (re.compile(r"(?i).*(?:code|source|html|verbatim)"), lambda p, _: {"kind": "code", "text": p.text.rstrip(), "para_break": "wrap"}),
    (re.compile(r"(?i).*list"), lambda p, _: {"kind": "bullet", "text": p.flat, "level": max(p.depth, 0), "raw": p.text.rstrip()}),
    (re.compile(""), lambda p, _: {"kind": "text", "text": p.text.strip(), "raw": p.text.rstrip()}),
)


def styled(p: Paragraph) -> str:
    """The style that a paragraph counts as: fonts and numbering stand for one where the style says nothing."""
    if not KINDS[0][0].match(p.style) and p.fonts and all(map(MONOSPACE.search, p.fonts)):
        return "code"
    return "list" if p.depth >= 0 and not any(rule.match(p.style) for rule, _ in KINDS[:2]) else p.style


def docx_lines(content: bytes) -> Iterator[dict]:
    """Paragraphs and tables of a Word file."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{WORD_NS}body")
    for block in body:
        if block.tag == f"{WORD_NS}tbl":
            cells = [["".join(t.text or "" for t in cell.iter(f"{WORD_NS}t")).strip() for cell in row.iter(f"{WORD_NS}tc")] for row in block.iter(f"{WORD_NS}tr")]
            yield {"kind": "table", "text": "\n".join(f"| {' | '.join(row)} |" for row in cells)}
        elif block.tag == f"{WORD_NS}p" and (p := Paragraph(block)).flat:
            yield next(make(p, m) for rule, make in KINDS if (m := rule.match(styled(p))))


CORE = {"title": "title", "creator": "author", "lastModifiedBy": "last_modified_by"}


def core_properties(content: bytes) -> dict[str, str]:
    """Title, author and last editor of an Office file, where it names them."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        if "docProps/core.xml" not in archive.namelist():
            return {}
        found = ElementTree.fromstring(archive.read("docProps/core.xml"))
    return {CORE[tag]: e.text.strip() for e in found if (tag := e.tag.rpartition("}")[2]) in CORE and (e.text or "").strip()}


LOADERS = {"docx": docx_lines, "pptx": pptx_lines}
TEXTS = ("txt", "md")


def extract_lines(documents: DataFrame, loaders: dict = LOADERS) -> DataFrame:
    """documents(document_id, file_type, content) -> LINES; a file that can't be read gives one row with an error.

    A loader's lines are one section unless they name their unit, as those of slides do.  Where a line comes with its raw
    text, it becomes code if that looks like code.
    """
    plain = {"unit": 0, "unit_kind": "section", "level": 0, "para_break": "para", "raw": None, "error": None}
    columns = [c.split()[0] for c in RAW.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for key, kind, content in zip(part["document_id"], part["file_type"], part["content"], strict=True):
                try:
                    rows = [plain | row for row in loaders[kind](bytes(content))]
                except Exception as e:  # noqa: BLE001  the row says so, the task goes on
                    rows = [plain | {"text": None, "kind": None, "para_break": None, "error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame([row | {"document_id": key, "line": i} for i, row in enumerate(rows)], columns=columns)

    found = documents.where(~F.col("file_type").isin(*TEXTS)).select("document_id", "file_type", "content").mapInPandas(run, RAW)
    code = F.col("raw").isNotNull() & code_like(F.col("raw"))
    either = {"kind": F.when(code, "code").otherwise(F.col("kind")), "text": F.when(code, F.col("raw")).otherwise(F.col("text")), "para_break": F.when(code, "wrap").otherwise(F.col("para_break"))}
    return _as_lines(found.withColumns(either)).unionByName(text_lines(documents.where(F.col("file_type").isin(*TEXTS))))


DETAILS = "document_id string, properties map<string,string>, master_text string, units array<struct<unit:int,images:int>>"


def extract_details(documents: DataFrame) -> DataFrame:
    """(document_id, properties, master_text, units) of Office files: what they say of themselves, the text of a deck's
    masters, the pictures of each slide.  A file that can't be read has no row (extract_lines gives its error)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, kind, content in zip(part["document_id"], part["file_type"], part["content"], strict=True):
                try:
                    said, shown = core_properties(bytes(content)), deck_details(bytes(content)) if kind == "pptx" else ("", [])
                except Exception:  # noqa: BLE001, S112  extract_lines says why
                    continue
                rows.append((key, said, shown[0], [{"unit": u, "images": n} for u, n in shown[1]]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DETAILS.split(", ")])

    return documents.where(F.col("file_type").isin("docx", "pptx")).select("document_id", "file_type", "content").mapInPandas(run, DETAILS)


def load_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Chunks of a JSON Lines file; raises with the number of bad rows of each kind and some examples."""
    rows = spark.read.schema(schema + ", __bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    again = F.row_number().over(Window.partitionBy("chunk_id").orderBy("document_id")) > 1
    problem = F.when(F.col("__bad").isNotNull(), "invalid JSON").when(missing, "missing field").when(again, "duplicate chunk_id").when(text_hash(F.col("text")) != F.col("text_hash"), "text_hash does not match text")
    checked = rows.withColumn("__problem", problem)
    wrong = checked.where("__problem is not null").groupBy("__problem").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("example")).collect()
    if wrong:
        raise ValueError("invalid chunks: " + "; ".join(f"{r['n']} x {r['__problem']} (e.g. {r['example']})" for r in wrong))
    return rows.drop("__bad")


def resolved(path: str) -> str:
    """A path without its scheme, dot parts and doubled slashes; a relative one below the working folder."""
    return posixpath.abspath(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)", "", path))


def guard_output(source: str, target: str) -> None:
    a, b = (resolved(x).rstrip("/") + "/" for x in (source, target))
    if b.startswith(a):
        raise ValueError("the output folder must not be inside the source")
