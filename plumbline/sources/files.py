"""Files in: uploads with their checks, documents by kind, word-processor files; tables out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import config, schemas
from plumbline.staging import stored

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_ELEMENTS = "document_id string, element_index int, type string, level int, text string, data array<array<string>>"


def uploads(spark: SparkSession, path: str, max_mb: int = config.THRESHOLDS["max_upload_mb"]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files of a folder: the ending must be known and the size within the limit. Contents aren't read here.

    Accepted rows are ``documents`` rows with status queued; rejected ones carry the reason.
    """
    return check_uploads(spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime"), max_mb)


def check_uploads(files: DataFrame, max_mb: int = config.THRESHOLDS["max_upload_mb"]) -> tuple[DataFrame, DataFrame]:
    """The same for a listing (path, length, modificationTime)."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.select(
        schemas.key(F.col("path")).alias("document_id"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        ending.alias("file_type"),
        F.col("path").alias("storage_path"),
        F.col("length").alias("file_size_bytes"),
        F.lit("queued").alias("status"),
        F.col("modificationTime").alias("created_at"),
    )
    reason = F.when(~F.col("file_type").isin(*config.FILE_TYPES), "unsupported file type").when(F.col("file_size_bytes") > max_mb * 1024 * 1024, "file too large")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def by_kind(documents: DataFrame) -> dict[str, DataFrame]:
    """Documents split by file type; another type is an error where its rows are read."""
    known = F.col("file_type").isin(*config.FILE_TYPES)
    checked = documents.withColumn("file_type", F.when(known, F.col("file_type")).otherwise(F.raise_error(F.concat(F.lit("unsupported file type: "), F.coalesce("file_type", F.lit("null"))))))
    return {kind: checked.where(F.col("file_type") == kind) for kind in config.FILE_TYPES}


def heading_level(style: str) -> int | None:
    """0 for a title style, the number of a heading style (1 without one), null otherwise."""
    if style == "Title":
        return 0
    if style.startswith("Heading"):
        digits = "".join(c for c in style if c.isdigit())
        return int(digits) if digits else 1
    return None


def _styles(archive: zipfile.ZipFile) -> dict[str, str]:
    """Style names by style id."""
    if "word/styles.xml" not in archive.namelist():
        return {}
    names = {}
    for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
        name = style.find(f"{_W}name")
        if name is not None:
            names[style.get(f"{_W}styleId", "")] = name.get(f"{_W}val", "")
    return names


def _text(node) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab":
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def docx_elements(content: bytes) -> list[dict]:
    """Headings, non-blank paragraphs and tables of a word-processor file, in body order."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        styles = _styles(archive)
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    out: list[dict] = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}tbl":
            rows = [["\n".join(_text(p) for p in cell.iter(f"{_W}p")) for cell in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            out.append({"type": "table", "level": None, "text": None, "data": rows})
        elif node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            ident = style.get(f"{_W}val", "") if style is not None else ""
            name = styles.get(ident, ident)
            level = heading_level(name[:1].upper() + name[1:])
            text = _text(node)
            if level is not None:
                out.append({"type": "heading", "level": level, "text": text, "data": None})
            elif text.strip():
                out.append({"type": "paragraph", "level": None, "text": text, "data": None})
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Element rows of the word-processor files under a path; one file is one unit of work."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return parse_docx(files.select(schemas.key(F.col("path")).alias("document_id"), "content"))


def parse_docx(rows: DataFrame) -> DataFrame:
    """The same for rows (document_id string, content binary)."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["type", "level", "text", "data"]

        def rows_of(document_id: str, content: bytes) -> list[tuple]:
            return [(document_id, i, *map(e.get, names)) for i, e in enumerate(docx_elements(content))]

        return _by_rows(frames, rows_of, ["document_id", "element_index", *names])

    return rows.select("document_id", "content").mapInPandas(parse, _ELEMENTS)


#: Rows that a parser gathers before it hands them on.
PARSED_ROWS = 5_000


def _by_rows(frames: Iterator[pd.DataFrame], rows_of: Callable[[str, bytes], list[tuple]], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of (document_id, content) parsed document by document, handed on in frames of some thousand rows."""
    out: list[tuple] = []
    for frame in frames:
        for document_id, content in zip(frame.document_id, frame.content, strict=True):
            out += rows_of(document_id, bytes(content))
            if len(out) >= PARSED_ROWS:
                yield pd.DataFrame(out, columns=columns)
                out = []
    yield pd.DataFrame(out, columns=columns)


_PAGES = (
    "document_id string, page_number int, text string, words array<struct<text:string,x0:double,top:double,size:double>>, "
    "boxes array<struct<x0:double,top:double,x1:double,bottom:double,data:array<array<string>>>>, read array<struct<ordinal:int,text:string,conf:double>>"
)


def pdf_pages(rows: DataFrame, reader: Callable[[bytes], list[dict]]) -> DataFrame:
    """Pages of portable documents: rows (document_id string, content binary) -> a row a page with its text, placed words, table
    boxes and, for scanned pages, recognised words. ``reader`` stands for the library that opens the bytes; it gives
    a dict a page with any of text, words (text, x0, top, size), boxes (x0, top, x1, bottom, data), read (text, conf)."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows_of(document_id: str, content: bytes) -> list[tuple]:
            out = []
            for number, page in enumerate(reader(content), 1):
                words = [dict(zip(("text", "x0", "top", "size"), w, strict=True)) for w in page.get("words", ())]
                boxes = [dict(zip(("x0", "top", "x1", "bottom", "data"), b, strict=True)) for b in page.get("boxes", ())]
                read = [{"ordinal": i, "text": t, "conf": float(c)} for i, (t, c) in enumerate(page.get("read", ()))]
                out.append((document_id, number, page.get("text"), words, boxes, read))
            return out

        return _by_rows(frames, rows_of, ["document_id", "page_number", "text", "words", "boxes", "read"])

    return rows.select("document_id", "content").mapInPandas(parse, _PAGES)


def parse_pdf(rows: DataFrame, reader: Callable[[bytes], list[dict]]) -> DataFrame:
    """Element rows of portable documents, each page by its layout or, where it has no text, by recognition. Pages are written
    once read, so that a file is opened once."""
    from plumbline.operators import layout

    pages = stored(layout.native_pages(pdf_pages(rows, reader)), "pages")
    native = pages.where("source = 'native'")
    words = native.select("document_id", "page_number", F.inline("words"))
    boxes = native.select("document_id", "page_number", F.inline("boxes"))
    scanned = pages.where("source = 'ocr'").select("document_id", "page_number", F.inline("read"))
    return layout.document_elements(words, boxes, scanned)


def parse_documents(documents: DataFrame, reader: Callable[[bytes], list[dict]]) -> DataFrame:
    """Elements of documents (document_id, file_type, content) of both kinds; another kind is an error."""
    kinds = by_kind(documents)
    return parse_docx(kinds["docx"]).unionByName(parse_pdf(kinds["pdf"], reader), allowMissingColumns=True)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines term list: (label, pattern)."""
    return spark.read.schema("label string, pattern string").json(path)


def persist(tables: dict[str, DataFrame], path: str, run: DataFrame | None = None) -> None:
    """Write the tables of an ingest as Parquet, appending; the run's row goes last, so that a run is listed when it is whole."""
    for name, rows in tables.items():
        rows.write.mode("append").parquet(f"{path}/{name}")
    if run is not None:
        run.write.mode("append").parquet(f"{path}/pipeline_runs")
