"""Spreadsheets of review size (.xlsx: a zip of XML tables), written and read by tasks; every cell is a text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import shipped
from .arrow import opened

#: Rows of a sheet, the header included, as the format has it.
MOST_ROWS = 1 << 20
#: Fixed values of the format: name spaces and the parts that a workbook of one sheet consists of.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINK}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_LINK}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_NOT_XML = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def _column(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _cells(values: Sequence, row: int) -> str:
    cell = lambda i, v: "" if v is None else f'<c r="{_column(i)}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(_NOT_XML.sub("", str(v)))}</t></is></c>'
    return f'<row r="{row}">{"".join(cell(i, v) for i, v in enumerate(values))}</row>'


def write_sheet(df: DataFrame, path: str, order: Sequence[Column | str], rows: int | None = 200) -> int:
    """The first rows of df in an order (all with None) as one workbook at path; a null is an empty cell. Returns the rows written.

    One task writes the file as it reads the rows; more rows than a sheet holds are an error before anything is written.
    """
    shipped(df.sparkSession)
    out = df.orderBy(*order).select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    out = out.limit(MOST_ROWS if rows is None else min(rows, MOST_ROWS))
    names = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = io.BytesIO(), 0
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in _PARTS.items():
                z.writestr(name, text)
            with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
                f.write(f'<worksheet xmlns="{_MAIN}"><sheetData>{_cells(names, 1)}'.encode())
                for b in batches:
                    for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                        n += 1
                        if n >= MOST_ROWS:
                            raise ValueError(f"a sheet holds {MOST_ROWS - 1} rows")
                        f.write(_cells(row, n + 1).encode())
                f.write(b"</sheetData></worksheet>")
        fs, at = opened(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(at) as f:
            f.write(held.getbuffer())
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    done = out.coalesce(1).mapInArrow(write, "n long").first()
    if done is None:  # a plan without rows may have no task either: a workbook with the header alone
        next(write(iter(())))
    return done["n"] if done else 0


def _place(reference: str) -> int:
    at = 0
    for c in reference.rstrip("0123456789"):
        at = at * 26 + ord(c) - 64
    return at - 1


def _rows(data: bytes) -> Iterator[list[str | None]]:
    """Cells of the first sheet, row by row."""
    main = f"{{{_MAIN}}}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{main}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        with z.open(min(n for n in names if n.startswith("xl/worksheets/sheet"))) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{main}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{main}c"):
                    at = _place(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value = c.find(f"{main}v")
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{main}t"))
                    elif value is not None:
                        cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
                yield cells
                row.clear()


def read_sheet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of the first sheet of a workbook, or of each workbook that a path with wildcards meets, as texts. The first
    row names the columns; an empty cell is null; a column that is missing is an error. A workbook is one task."""
    shipped(spark)
    names = list(columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b["content"]:
                found = _rows(data.as_py())
                head = next(found, [])
                missing = [c for c in names if c not in head]
                if missing:
                    raise ValueError(f"the sheet lacks {missing}")
                at = [head.index(c) for c in names]
                held: list[list[str | None]] = []
                for row in found:
                    held.append([row[i] if i < len(row) else None for i in at])
                    if len(held) == 4096:
                        yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, T.StructType([T.StructField(c, T.StringType()) for c in names]))
