"""Spreadsheets (.xlsx) as a source: files are read by Spark from any file system it knows, a task a file, and their rows come out in batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS = 10_000


def column_of(ref: str) -> int:
    """The number, from 0, of a cell's column: A1 is 0, AA3 is 26."""
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def text_of(node: ElementTree.Element) -> str:
    """The text of a string item, its runs joined, without phonetic hints."""
    return "".join(t.text or "" for part in node if part.tag != MAIN + "rPh" for t in part.iter(MAIN + "t"))


def sheet_rows(content: bytes, sheet: str | None) -> Iterator[dict[int, str]]:
    """{column number: text} of each row of a sheet (the first, if none is named), read as a stream; ValueError for a sheet that the file lacks. Formulas give the value stored with them."""
    book = zipfile.ZipFile(io.BytesIO(content))
    sheets = [(s.get("name"), s.get(REL)) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet")]
    wanted = next((r for n, r in sheets if sheet is None or n == sheet), None)
    if wanted is None:
        raise ValueError(f"no sheet {sheet!r} among {[n for n, _ in sheets]}")
    target = next(r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == wanted)
    shared = [text_of(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(MAIN + "si")] if "xl/sharedStrings.xml" in book.namelist() else []
    with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
        for _, node in ElementTree.iterparse(part):
            if node.tag != MAIN + "row":
                continue
            row: dict[int, str] = {}
            for at, cell in enumerate(node.iter(MAIN + "c")):
                kind, value = cell.get("t", "n"), cell.findtext(MAIN + "v")
                inline = cell.find(MAIN + "is")
                if kind == "inlineStr" and inline is not None:
                    value = text_of(inline)
                elif kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "b" and value is not None:
                    value = "true" if value == "1" else "false"
                elif kind == "e":
                    value = None
                if value is not None:
                    row[column_of(cell.get("r")) if cell.get("r") else at] = value
            node.clear()
            yield row


def read_sheets(spark: SparkSession, path: str, schema: str, sheet: str | None = None, path_col: str | None = None) -> DataFrame:
    """The rows of a sheet of every file that path (a file, folder or glob) names; the first row names the columns.

    schema: declared columns, picked by name; one that a file's header lacks raises ValueError. Dates are the numbers that sheets store (days since 1899-12-30). Empty cells, and cells that
    hold an error, are null; rows without any cell are left out; a value that isn't of its type fails as Spark's cast does. path_col: a column for the file's path. A file is one task's, and a sheet has at most
    1,048,576 rows by its format.
    """
    kinds = StructType.fromDDL(schema)
    names = kinds.fieldNames()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = sheet_rows(content, sheet)
                header = {v.strip(): k for k, v in next(rows, {}).items()}
                if lacking := [n for n in names if n not in header]:
                    raise ValueError(f"{path} has no column {lacking}")
                held: list[list] = []
                for row in rows:
                    if row:
                        held.append([path, *[row.get(header[n]) for n in names]])
                    if len(held) == ROWS:
                        yield pd.DataFrame(held, columns=["path_", *names], dtype=object)
                        held = []
                yield pd.DataFrame(held, columns=["path_", *names], dtype=object)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    text = files.mapInPandas(parse, StructType.fromDDL("path_ string, " + ", ".join(f"`{n}` string" for n in names)))

    def typed(name: str, kind: str):
        raw = F.col(f"`{name}`")
        return (raw.cast("double").cast(kind) if kind in ("tinyint", "smallint", "int", "bigint") else raw.cast(kind)).alias(name)

    out = [typed(f.name, f.dataType.simpleString()) for f in kinds.fields]
    return text.select(*out, *([F.col("path_").alias(path_col)] if path_col else []))
