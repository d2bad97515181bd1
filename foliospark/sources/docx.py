"""Word documents: paragraphs and tables of .docx files, as pages of text and as tables."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.sources.content import PAGE, paged

# Names of the format.
SPACE_OF_WORDS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SPACE_OF_LINKS = "http://schemas.openxmlformats.org/package/2006/relationships"
SPACE_OF_KINDS = "http://schemas.openxmlformats.org/package/2006/content-types"
MAIN_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
MAIN_KIND = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
LINKS_KIND = "application/vnd.openxmlformats-package.relationships+xml"
MAIN_PART = "word/document.xml"

W = "{" + SPACE_OF_WORDS + "}"
#: Bytes of a file, and of its main part once inflated, beyond which a file is an error and isn't read.
FILE_BYTES, PART_BYTES = 64 << 20, 256 << 20
#: Columns that one cell may span; the format itself ends at 63.
SPAN = 1 << 10
#: Bytes of small files that leave as one batch.
TOGETHER = 1 << 18
TOO_LARGE = "file is too large"
SHAPE = "paragraphs array<string>, tables array<array<struct<row:int,cells:array<string>>>>, error string"


def _piece(e: ElementTree.Element) -> str:
    """What an element of a run says; breaks of pages and columns say nothing."""
    kind = e.tag.removeprefix(W)
    if kind == "t":
        return e.text or ""
    if kind in ("tab", "ptab"):
        return "\t"
    if kind == "cr" or kind == "br" and e.get(W + "type", "textWrapping") == "textWrapping":
        return "\n"
    return "-" if kind == "noBreakHyphen" else ""


def _said(paragraph: ElementTree.Element) -> str:
    """Text of the runs of a paragraph and of its links; text boxes in it, and what was deleted, aren't part of it."""
    out = []
    for child in paragraph:
        runs = (child,) if child.tag == W + "r" else child.findall(W + "r") if child.tag == W + "hyperlink" else ()
        out += [_piece(e) for run in runs for e in run]
    return "".join(out)


def _number(e: ElementTree.Element, path: str, default: int) -> int:
    found = e.find("/".join(W + p for p in path.split("/")))
    return default if found is None else int(found.get(W + "val", default))


def _rows(table: ElementTree.Element) -> list[dict]:
    """Rows with any text: their place, and cells without blank ones. A cell counts once for each column that it spans, and
    again in each row that it is merged into."""
    out, above = [], {}
    for i, row in enumerate(table.findall(W + "tr")):
        at, here, cells = _number(row, "trPr/gridBefore", 0), {}, []
        for cell in row.findall(W + "tc"):
            span = _number(cell, "tcPr/gridSpan", 1)
            if not 0 < span <= SPAN:
                raise ValueError(f"a cell spans {span} columns")
            merged = cell.find(f"{W}tcPr/{W}vMerge")
            text = "\n".join(map(_said, cell.findall(W + "p"))).strip()
            if merged is not None and merged.get(W + "val", "continue") == "continue":
                text = above.get(at, text)
            here.update(dict.fromkeys(range(at, at + span), text))
            cells += [text] * span
            at += span
        above = here
        if cells := [c for c in cells if c]:
            out.append({"row": i, "cells": cells})
    return out


def _opened(package: zipfile.ZipFile, name: str):  # noqa: ANN202
    part = package.getinfo(name)
    if part.file_size > PART_BYTES:
        raise ValueError(TOO_LARGE)
    return package.open(part)


def _main_part(package: zipfile.ZipFile) -> str:
    if "_rels/.rels" in package.namelist():
        with _opened(package, "_rels/.rels") as f:
            links = ElementTree.parse(f).getroot()
        for link in links:
            if link.get("Type") == MAIN_LINK:
                return link.get("Target", "").lstrip("/")
    return MAIN_PART


def _read(content: bytes) -> tuple[list[str], list[list[dict]]]:
    """Paragraphs and tables of the body. What is nested deeper than the body belongs to neither."""
    paragraphs, tables = [], []
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        with _opened(package, _main_part(package)) as f:
            depth, body = 0, None
            for event, e in ElementTree.iterparse(f, ("start", "end")):
                depth += 1 if event == "start" else -1
                if event == "start":
                    body = e if depth == 2 and e.tag == W + "body" else body
                elif depth == 2 and body is not None:
                    if e.tag == W + "p" and (text := _said(e).strip()):
                        paragraphs.append(text)
                    elif e.tag == W + "tbl" and (rows := _rows(e)):
                        tables.append(rows)
                    body.remove(e)
    if not paragraphs and not tables:
        raise ValueError("no extractable text")
    return paragraphs, tables


def _one(content: bytes | None) -> dict:
    if content is None:
        return {"paragraphs": None, "tables": None, "error": TOO_LARGE}
    try:
        paragraphs, tables = _read(content)
    except Exception as e:  # noqa: BLE001 - a broken file is a row with an error, and stops no other
        return {"paragraphs": None, "tables": None, "error": str(e) or type(e).__name__}
    return {"paragraphs": paragraphs, "tables": tables, "error": None}


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs of files that leave together: of under TOGETHER bytes behind the first file of a run."""
    full = np.cumsum(sizes, dtype=np.int64) // TOGETHER
    return itertools.pairwise([0, *(int(i) + 1 for i in np.flatnonzero(np.diff(full, append=-1)))])


def parsed(files: DataFrame, content: str = "content") -> DataFrame:
    """files with paragraphs, tables and error in place of the content.

    Paragraphs are stripped and not blank, tables hold rows(row, cells) with any text. A file that can't be read has null
    paragraphs and tables and an error; so has a null content (a file that is too large), an empty one, and a document without
    text. Other columns stay, but for those named paragraphs, tables or error, which are replaced. No rows give no rows.
    Files arrive in Arrow batches of spark.sql.execution.arrow.maxBytesPerBatch, and leave in runs of about TOGETHER bytes.
    """
    kept = [c for c in files.columns if c not in (content, "paragraphs", "tables", "error")]
    tables = pa.list_(pa.list_(pa.struct([("row", pa.int32()), ("cells", pa.list_(pa.string()))])))
    kinds = {"paragraphs": pa.list_(pa.string()), "tables": tables, "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            others, files_ = b.column("_kept"), b.column(content)
            for start, end in _runs(pc.fill_null(pc.binary_length(files_), 0).to_numpy(zero_copy_only=False)):
                done = [_one(files_[i].as_py()) for i in range(start, end)]
                new = [pa.array([d[n] for d in done], k) for n, k in kinds.items()]
                yield pa.RecordBatch.from_arrays([others.slice(start, end - start), *new], ["_kept", *kinds])

    columns = F.struct(F.lit(0), *(F.col(f"`{c}`") for c in kept)).alias("_kept")  # a name with a dot is none for Arrow
    rows = files.select(columns, F.col(f"`{content}`").alias(content))
    done = rows.mapInArrow(run, T.StructType([rows.schema["_kept"], *T.StructType.fromDDL(SHAPE)]))
    return done.select(*(F.col("_kept")[c].alias(c) for c in kept), *kinds)


def read(spark: SparkSession, path: str, most: int = FILE_BYTES) -> DataFrame:
    """path, paragraphs, tables, error of all .docx files below a path of any file system that Spark reads. Files of more than
    `most` bytes aren't opened: they are rows with an error. Files of no bytes give no row, as in all of Spark's file sources."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").option("recursiveFileLookup", True).load(path)
    small = found.filter(F.col("length") <= most).select("path", "content")
    large = found.filter(F.col("length") > most).select("path", F.lit(TOO_LARGE).alias("error"))  # its content isn't asked for, so isn't read
    return parsed(small).unionByName(large, allowMissingColumns=True)


def text(paragraphs: Column, tables: Column) -> Column:
    """All text of a document: paragraphs, then rows of tables with bars between cells, a blank line between any two."""
    rows = F.flatten(F.transform(tables, lambda t: F.transform(t, lambda r: F.array_join(r["cells"], " | "))))
    return F.array_join(F.concat(paragraphs, rows), "\n\n")


def pages(documents: DataFrame, size: int = PAGE) -> DataFrame:
    """Rows of documents, as `parsed` makes them, by page: page_num from 1, text, words and position_type. Word documents have
    no pages of their own, so `size` code points are one; documents with an error have none."""
    rest = [F.col(f"`{c}`") for c in documents.columns if c not in ("paragraphs", "tables", "error", "page_num", "text", "words", "position_type")]
    cut = documents.select(*rest, F.explode(paged(text(F.col("paragraphs"), F.col("tables")), size)).alias("_p"))
    return cut.select(*rest, "_p.*", F.lit("chunk").alias("position_type"))


def tables(documents: DataFrame) -> DataFrame:
    """Rows of documents by table: table_num from 1, headers, rows, raw_text. The first row has the headers; a table whose first
    row is blank isn't listed, but its rows are part of the text."""
    headed = F.filter("tables", lambda t: t[0]["row"] == 0)
    rest = [F.col(f"`{c}`") for c in documents.columns if c not in ("paragraphs", "tables", "error", "table_num", "headers", "rows", "raw_text")]
    each = documents.select(*rest, F.posexplode(headed).alias("_i", "_t"))
    cells = F.transform("_t", lambda r: r["cells"])
    raw = F.array_join(F.transform(cells, lambda c: F.array_join(c, " | ")), "\n")
    return each.select(*rest, (F.col("_i") + 1).alias("table_num"), cells[0].alias("headers"), F.slice(cells, 2, F.size(cells)).alias("rows"), raw.alias("raw_text"))


_UNFIT = re.compile(f"[^\t\n\r\x20-{chr(0xD7FF)}{chr(0xE000)}-{chr(0xFFFD)}{chr(0x10000)}-{chr(0x10FFFF)}]")
_SIGNS = {"\t": "<w:tab/>", "\n": "<w:br/>", "\r": "<w:cr/>"}


def _paragraph(said: str | None) -> str:
    pieces = re.split(r"([\t\n\r])", _UNFIT.sub("", said or ""))
    return "<w:p><w:r>" + "".join(_SIGNS.get(p) or f'<w:t xml:space="preserve">{escape(p)}</w:t>' for p in pieces if p) + "</w:r></w:p>"


def _packed(paragraphs: list[str | None], grids: list[list[list[str | None]]]) -> bytes:
    row = lambda cells: "<w:tr>" + "".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in cells) + "</w:tr>"
    body = "".join(map(_paragraph, paragraphs)) + "".join(f"<w:tbl>{''.join(map(row, g))}</w:tbl>" for g in grids)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{SPACE_OF_KINDS}"><Default Extension="rels" ContentType="{LINKS_KIND}"/><Override PartName="/{MAIN_PART}" ContentType="{MAIN_KIND}"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{SPACE_OF_LINKS}"><Relationship Id="r1" Type="{MAIN_LINK}" Target="{MAIN_PART}"/></Relationships>',
        MAIN_PART: f'<w:document xmlns:w="{SPACE_OF_WORDS}"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, xml in parts.items():
            package.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + xml, zipfile.ZIP_DEFLATED)  # no time of day: reruns agree
    return out.getvalue()


def packed(paragraphs: Column, grids: Column) -> Column:
    """A .docx file as bytes: paragraphs (array of texts), then tables (array of arrays of rows of cells). Nulls are empty;
    characters that XML can't hold go."""
    @F.pandas_udf("binary")
    def made(p: pd.Series, g: pd.Series) -> pd.Series:
        listed = lambda x: [] if x is None else list(x)
        return pd.Series([_packed(listed(a), [[listed(r) for r in listed(t)] for t in listed(b)]) for a, b in zip(p, g, strict=True)])

    return made(paragraphs, grids)
