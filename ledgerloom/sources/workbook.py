"""Workbook loader: ``.xlsx`` files to the cells table, one file per row of ``binaryFile``.

A file is small (uploads are limited to 25 MiB), so Spark spreads files over tasks and each task
reads one at a time. Only the standard library is used to open them.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CELLS = (
    "document_id string, sheet_name string, row_num bigint, col_num int, str_value string, "
    "num_value double, sheet_no int"
)
CHUNK_CELLS = 50_000
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_STYLES = {*range(14, 23), *range(45, 48)}
EPOCH = dt.datetime(1899, 12, 30)


def _column(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in root]


def _date_formats(book: zipfile.ZipFile) -> list[bool]:
    """For every cell style, whether it shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId")): bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode").lower())))
        for f in root.iter(f"{MAIN}numFmt")
    }
    styles = root.find(f"{MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in (styles if styles is not None else [])]
    return [i in DATE_STYLES or custom.get(i, False) for i in ids]


def _sheets(book: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = {link.get("Id"): link.get("Target").lstrip("/") for link in links}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        path = target[sheet.get(RELATION)]
        yield sheet.get("name"), path if path.startswith("xl/") else f"xl/{path}"


def _value(cell, texts: list[str], dates: list[bool]) -> tuple[str | None, float | None]:
    kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t")), None
    if value is None:
        return None, None
    if kind == "s":
        return texts[int(value)], None
    if kind == "b":
        return ("true" if value == "1" else "false"), None
    if kind != "n":
        return value, None
    style = int(cell.get("s", 0))
    if style < len(dates) and dates[style]:
        moment = EPOCH + dt.timedelta(days=float(value))
        return moment.isoformat(timespec="milliseconds") + "Z", None
    return None, float(value)


def workbook_cells(content: bytes) -> Iterator[tuple]:
    """``(sheet_name, row_num, col_num, str_value, num_value, sheet_no)`` of every cell with a value."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        texts, dates = _shared_texts(book), _date_formats(book)
        for nth, (name, path) in enumerate(_sheets(book)):
            with book.open(path) as part:
                for _, node in ElementTree.iterparse(part):
                    if node.tag != f"{MAIN}row":
                        continue
                    for cell in node.iter(f"{MAIN}c"):
                        text, number = _value(cell, texts, dates)
                        if text is not None or number is not None:
                            at = cell.get("r")
                            row = int(re.search(r"\d+", at).group()) - 1
                            yield name, row, _column(at), text, number, nth
                    node.clear()


def _load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in CELLS.split(", ")]
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            chunk = []
            for cell in workbook_cells(content):
                chunk.append((path, *cell))
                if len(chunk) == CHUNK_CELLS:
                    yield pd.DataFrame(chunk, columns=names)
                    chunk = []
            if chunk:
                yield pd.DataFrame(chunk, columns=names)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks under ``path``."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[xX][lL][sS][xX]")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.select("path", "content").mapInPandas(_load, CELLS)
