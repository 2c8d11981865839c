"""Minimal .xlsx writer (inline strings and numbers), used to build Excel
inputs for the scanner from a DataFrame: workbooks of bounded size."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CT = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
       '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
       '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
       '<Default Extension="xml" ContentType="application/xml"/>'
       '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
       '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
       '</Types>')
_RELS = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
         '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
         '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
         '</Relationships>')
_WB = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
       '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
       'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
       '<sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>')
_WB_RELS = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
            '</Relationships>')


def _col(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


#: A workbook ends at so many rows (Excel's sheets end at 1,048,576) or characters of its sheet, so that a task
#: holds a bounded piece of its partition.
BOOK_ROWS = 100_000
BOOK_CHARS = 32 << 20


class Workbook:
    """A workbook of one sheet, compressed as rows are added: the sheet is never held as text."""

    def __init__(self, columns, sheet: str = "Sheet1", comment: bytes = b""):
        self.buf = io.BytesIO()
        self.zip = zipfile.ZipFile(self.buf, "w", zipfile.ZIP_DEFLATED)
        self.zip.comment = comment
        self.zip.writestr("[Content_Types].xml", _CT)
        self.zip.writestr("_rels/.rels", _RELS)
        self.zip.writestr("xl/workbook.xml", _WB.format(name=escape(sheet)))
        self.zip.writestr("xl/_rels/workbook.xml.rels", _WB_RELS)
        self.part = io.TextIOWrapper(self.zip.open("xl/worksheets/sheet1.xml", "w"), "utf-8", newline="")
        self.part.write('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
        self.letters = [_col(c) for c in range(len(columns))]
        self.lines = self.chars = 0  # the header is the first line
        self.add(columns)

    def add(self, row) -> None:
        self.lines += 1
        r = self.lines
        out = [f'<row r="{r}">']
        for letters, v in zip(self.letters, row):
            if v is None:
                continue
            if isinstance(v, (int, float)) and not isinstance(v, bool) and r > 1:
                out.append(f'<c r="{letters}{r}"><v>{v!r}</v></c>')
            else:
                out.append(f'<c r="{letters}{r}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>')
        out.append("</row>")
        text = "".join(out)
        self.chars += len(text)
        self.part.write(text)

    def full(self) -> bool:
        return self.lines > BOOK_ROWS or self.chars >= BOOK_CHARS

    def close(self) -> bytes:
        self.part.write("</sheetData></worksheet>")
        self.part.close()
        self.zip.close()
        return self.buf.getvalue()


def _values(pdf: pd.DataFrame) -> list[list]:
    return pdf.astype(object).where(pdf.notna(), None).values.tolist()


def workbook_bytes(pdf: pd.DataFrame, sheet: str = "Sheet1", comment: bytes = b"") -> bytes:
    """All rows as one workbook."""
    book = Workbook(pdf.columns, sheet, comment)
    for row in _values(pdf):
        book.add(row)
    return book.close()


def write_xlsx(df: DataFrame, folder: str) -> str:
    """The rows of each partition as workbooks of at most ``BOOK_ROWS`` rows and about ``BOOK_CHARS`` characters (one at
    least, if it has rows) under ``folder``, in any file system that Spark writes to.  A task holds one of them, compressed.

    Spark's text writer commits them to a folder of their own: a retried task replaces its file, a lost one leaves
    none.  It ends a row with a line break, which is the archive's comment of one byte, so that each file
    is a workbook as it stands.  Then they get their names, ``part-00000.xlsx`` on, in ``folder``; a rerun replaces them,
    and removes those of an earlier run that had more."""
    from tablelens.session import ship_package
    spark = df.sparkSession
    ship_package(spark)

    def books(it):
        book = None
        for pdf in it:
            for row in _values(pdf):
                book = book or Workbook(pdf.columns, comment=b"\n")
                book.add(row)
                if book.full():
                    yield pd.DataFrame({"book": [book.close()[:-1]]})
                    book = None
        if book:
            yield pd.DataFrame({"book": [book.close()[:-1]]})

    staged = f"{folder.rstrip('/')}/_books-{uuid.uuid4().hex[:12]}"
    (df.mapInPandas(books, "book binary").select(F.col("book").cast("string").alias("value"))
     .write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(staged))
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":  # no checksum files beside the workbooks
        fs = fs.getRawFileSystem()
    parts = sorted(x.getPath().getName() for x in fs.listStatus(path(staged)) if x.getPath().getName().startswith("part-") and x.getLen())
    for i, name in enumerate(parts):
        target = path(f"{folder}/part-{i:05d}.xlsx")
        fs.delete(target, False)
        fs.rename(path(f"{staged}/{name}"), target)
    fs.delete(path(staged), True)
    for x in fs.listStatus(path(folder)):
        if (old := re.fullmatch(r"part-(\d{5,})\.xlsx", x.getPath().getName())) and int(old[1]) >= len(parts):
            fs.delete(x.getPath(), False)
    return folder
