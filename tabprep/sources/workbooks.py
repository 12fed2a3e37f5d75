"""Folders of .xlsx workbooks as tables. A workbook is a compressed package, so one task reads one whole workbook.

Sheets are read as streams: rows leave in bounded batches as they are parsed, and no tree of a sheet is held. Shared texts are needed in any order and
are held, as bytes. Small packages come from Spark as values; of larger ones a task reads the parts that it needs from the file.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Refused
from ..storage import materialize
from . import stored
from .csv import infer_types
from .stored import located

#: Names in the package, and of its XML.
_TYPES, _BOOK, _RELS, _TEXTS = "[Content_Types].xml", "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"
#: Cells of one batch of rows.
BATCH_CELLS = 100_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _opened(path: str, content: bytes | None) -> zipfile.ZipFile | None:
    """The package, from its content or else from its file; None for what isn't a whole workbook package."""
    try:
        system, place = (None, None) if content is not None else located(path)
        book = zipfile.ZipFile(io.BytesIO(content) if content is not None else system.open_input_file(place))
        return book if {_TYPES, _BOOK} <= set(book.namelist()) and book.testzip() is None else None
    except (zipfile.BadZipFile, OSError, ValueError, RuntimeError, NotImplementedError, EOFError, zlib.error):
        return None


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and relation ids in workbook order."""
    return [(s.get("name"), s.get(_REL_ID)) for s in ElementTree.fromstring(book.read(_BOOK)).iter(f"{_MAIN}sheet")]


def _text(node: ElementTree.Element) -> str:
    """All text of a string item, without phonetic hints."""
    runs = [node, *node.findall(f"{_MAIN}r")]
    return "".join(t.text or "" for r in runs for t in r.findall(f"{_MAIN}t"))


def _elements(book: zipfile.ZipFile, member: str, parent: str, child: str) -> Iterator[ElementTree.Element]:
    """The children of the parent element as they end; each is dropped when the next one is asked for."""
    held = None
    with book.open(member) as stream:
        for event, node in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start" and node.tag == _MAIN + parent:
                held = node
            elif event == "end" and node.tag == _MAIN + child and held is not None:
                yield node
                held.clear()


class _Shared:
    """The shared texts of a workbook, as bytes one behind the other."""

    def __init__(self, book: zipfile.ZipFile):
        self.ends, self.data = array("Q", [0]), bytearray()
        for node in _elements(book, _TEXTS, "sst", "si") if _TEXTS in book.namelist() else ():
            self.data += _text(node).encode()
            self.ends.append(len(self.data))

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < len(self.ends) - 1:
            raise IndexError(i)
        return self.data[self.ends[i] : self.ends[i + 1]].decode()


def _cells(book: zipfile.ZipFile, member: str) -> Iterator[tuple[int, list[str | None]]]:
    """Row numbers and cells as texts; cells that the file leaves out are null."""
    shared = _Shared(book)
    for at, row in enumerate(_elements(book, member, "sheetData", "row"), 1):
        cells: list[str | None] = []
        for cell in row.findall(f"{_MAIN}c"):
            letters = re.match("[A-Z]*", cell.get("r", ""))[0]
            column = 0
            for letter in letters:
                column = column * 26 + ord(letter) - 64
            cells += [None] * (column - 1 - len(cells))
            value, kind = cell.findtext(f"{_MAIN}v"), cell.get("t", "n")
            if kind == "s" and value is not None:
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = _text(cell.find(f"{_MAIN}is"))
            elif kind == "b" and value is not None:
                value = "True" if value == "1" else "False"
            cells.append(value)
        yield int(row.get("r", at)), cells


def _in_batches(path: str, rows: Iterator[tuple[int, list[str | None]]]) -> Iterator[pd.DataFrame]:
    """Frames of at most about BATCH_CELLS cells."""
    held, cells = [], 0
    for at, row in rows:
        held.append((path, at, row))
        cells += 1 + len(row)
        if cells >= BATCH_CELLS:
            yield pd.DataFrame(held, columns=["path", "row_index", "cells"])
            held, cells = [], 0
    if held:
        yield pd.DataFrame(held, columns=["path", "row_index", "cells"])


def _package(sheets: list[tuple[str, list[list[str | None]]]]) -> bytes:
    """A workbook of the named sheets, all cells as texts."""
    types = '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    kept, names, rels = {}, "", ""
    for i, (name, rows) in enumerate(sheets, 1):
        lines = "".join(f"<row>{''.join('<c/>' if v is None else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' for v in row)}</row>" for row in rows)
        kept[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{lines}</sheetData></worksheet>'
        names += f"<sheet name={quoteattr(name)} sheetId=\"{i}\" r:id=\"rId{i}\"/>"
        rels += f'<Relationship Id="rId{i}" Type="{_REL_ID[1:].rpartition("}")[0]}/worksheet" Target="worksheets/sheet{i}.xml"/>'
    kept[_TYPES] = f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/>{types}</Types>'
    kept[_BOOK] = f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL_ID[1:].rpartition("}")[0]}"><sheets>{names}</sheets></workbook>'
    kept[_RELS] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for member, content in kept.items():
            book.writestr(member, content)
    return out.getvalue()


def write_workbooks(df: DataFrame, folder: str, sheet: str, rows_each: int = 1000) -> int:
    """Writes df as workbooks of at most some rows_each rows, the names above them, to a folder that all executors see; tells how many.

    A second sheet, about, says how many rows there are. Files are named by their content, so a task that runs again writes the same.
    """
    names = df.columns

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), rows_each):
                rows = [[None if v is None else str(v) for v in r] for r in batch.iloc[i : i + rows_each].itertuples(index=False)]
                yield pd.DataFrame({"content": [_package([(sheet, [names, *rows]), ("about", [["rows"], [str(len(rows))]])])]})

    books = materialize(df.select(*(F.col(c).cast("string") for c in names)).mapInPandas(write, "content binary"))

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                name = hashlib.sha256(content).hexdigest()
                system, path = fs.FileSystem.from_uri(f"{folder}/{name}.xlsx") if "://" in folder else (fs.LocalFileSystem(), f"{folder}/{name}.xlsx")
                system.create_dir(posixpath.dirname(path), recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    return books.mapInPandas(store, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    small, large = F.col("length") <= stored.SMALL_BYTES, F.col("length") > stored.SMALL_BYTES
    return files.where(small).select("path", "content").unionByName(files.where(large).select("path", F.lit(None).cast("binary").alias("content")))


def workbook_sheets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, sheet_index, sheet_name, status): a row per sheet in workbook order, status ok; one row, status invalid, for what isn't a workbook."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                book = _opened(path, content)
                rows += [(path, None, None, "invalid")] if book is None else [(path, i, name, "ok") for i, (name, _) in enumerate(_sheets(book))]
            yield pd.DataFrame(rows, columns=["path", "sheet_index", "sheet_name", "status"]).astype({"sheet_index": "Int32"})

    return _files(spark, paths).mapInPandas(read, "path string, sheet_index int, sheet_name string, status string")


def workbook_rows(spark: SparkSession, paths: str | list[str], sheet: str) -> DataFrame:
    """(path, row_index, cells) of the sheet of this name in every workbook that has it; invalid files give no rows, see workbook_sheets."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                book = _opened(path, content)
                ids = [r for name, r in _sheets(book) if name == sheet] if book else []
                if not ids:
                    continue
                targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read(_RELS))}
                member = posixpath.normpath(posixpath.join("/xl", targets[ids[0]])).lstrip("/")
                yield from _in_batches(path, _cells(book, member))

    return _files(spark, paths).mapInPandas(read, "path string, row_index long, cells array<string>")


def load_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """One sheet as a table: the first row names the columns, types are inferred; sheets are never merged, empty ones and rows longer than the first are refused."""
    found = {r["sheet_name"]: r["status"] for r in workbook_sheets(spark, path).collect()}
    if None in found:
        raise Refused("invalid_workbook", path)
    if sheet not in found:
        raise Refused("unknown_sheet", sheet)
    rows = workbook_rows(spark, path, sheet).where(F.exists("cells", lambda c: c.isNotNull()))
    head = rows.orderBy("row_index").first()
    if head is None:
        raise Refused("sheet_is_empty", sheet)
    names = [(c or "").strip() for c in head["cells"]]
    if not all(names):
        raise Refused("empty_column_names")
    if len(set(names)) != len(names):
        raise Refused("duplicate_column_names")
    body = rows.where(F.col("row_index") > head["row_index"])
    if body.isEmpty():
        raise Refused("sheet_is_empty", sheet)
    if not body.where(F.exists(F.slice("cells", len(names) + 1, F.greatest(F.size("cells"), F.lit(1))), lambda c: c.isNotNull())).isEmpty():
        raise Refused("sheet_has_too_many_cells", sheet)
    return infer_types(body.select(*(F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names))))
