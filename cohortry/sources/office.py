"""Workbooks and word-processor tables as Spark data sources, read with the standard library alone."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PKG = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def sheet_names(path: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
    return [s.get("name") for s in book.iter(f"{_MAIN}sheet")]


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(path: str, sheet: str):
    """Rows of a sheet as lists of texts, None for empty cells, one after the other."""
    with zipfile.ZipFile(path) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        rid = next((s.get(f"{_REL}id") for s in book.iter(f"{_MAIN}sheet") if s.get("name") == sheet), None)
        if rid is None:
            raise ValueError(f"no sheet {sheet!r} in {path}")
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels.iter(f"{_PKG}Relationship") if r.get("Id") == rid)
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, el in ET.iterparse(f):
                if el.tag != f"{_MAIN}row":
                    continue
                row: list[str | None] = []
                for i, c in enumerate(el.iter(f"{_MAIN}c")):
                    at = _column(c.get("r")) if c.get("r") else i
                    row += [None] * (at + 1 - len(row))
                    v, kind = c.find(f"{_MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        row[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif v is not None and v.text is not None:
                        row[at] = shared[int(v.text)] if kind == "s" else {"0": "false", "1": "true"}.get(v.text, v.text) if kind == "b" else v.text
                yield row
                el.clear()


def document_tables(path: str):
    """(table, row, cells) of each row of a document's tables that has any text."""
    with zipfile.ZipFile(path) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    for t, tbl in enumerate(root.iter(f"{_WORD}tbl")):
        for r, tr in enumerate(tbl.iter(f"{_WORD}tr")):
            cells = [" ".join("".join(x.text or "" for x in p.iter(f"{_WORD}t")) for p in tc.iter(f"{_WORD}p")).strip() for tc in tr.iter(f"{_WORD}tc")]
            if any(cells):
                yield t, r, cells


class _Reader(DataSourceReader):
    def __init__(self, rows, width):
        self.rows, self.width = rows, width

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        for row in self.rows():
            yield tuple((row + [None] * self.width)[: self.width])


class WorkbookSource(DataSource):
    """Format ``workbook`` with options ``path`` and ``sheet``: all columns as strings, named by the first row."""

    @classmethod
    def name(cls):
        return "workbook"

    def _rows(self):
        return sheet_rows(self.options["path"], self.options.get("sheet") or sheet_names(self.options["path"])[0])

    def schema(self):
        head = next(self._rows(), [])
        return StructType([StructField(h or f"column_{i}", StringType()) for i, h in enumerate(head)])

    def reader(self, schema):
        rows = self._rows

        def body():
            it = rows()
            next(it, None)
            yield from it

        return _Reader(body, len(schema))


class DocumentTableSource(DataSource):
    """Format ``docx_tables`` with option ``path``: ``table_index``, ``row_index``, ``col_0`` and so on, all strings."""

    @classmethod
    def name(cls):
        return "docx_tables"

    def schema(self):
        width = max((len(c) for *_, c in document_tables(self.options["path"])), default=0)
        return StructType([StructField(n, StringType()) for n in ("table_index", "row_index", *(f"col_{i}" for i in range(width)))])

    def reader(self, schema):
        path = self.options["path"]
        return _Reader(lambda: ([str(t), str(r), *cells] for t, r, cells in document_tables(path)), len(schema))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
    spark.dataSource.register(DocumentTableSource)


def workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All sheets by name."""
    register(spark)
    return {s: spark.read.format("workbook").option("sheet", s).load(path) for s in sheet_names(path)}


def variable_rows(table: DataFrame, column: str = "col_0") -> DataFrame:
    """Rows of a codebook whose first column is a variable's name, each once."""
    return table.where(table[column].rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$")).dropDuplicates()
