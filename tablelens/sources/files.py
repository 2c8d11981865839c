"""File scans: CSV and Excel into DataFrames with pandas-like typing.

* CSV: every column is read as text, the pandas default missing-value
  tokens become null, then each column gets the narrowest of bigint /
  double / boolean / string that fits all its values - decided for all
  columns in one aggregate.  A file that is not valid UTF-8 is re-read as
  latin1 (Spark itself would silently substitute U+FFFD).
* Excel (.xlsx): read with the ``binaryFile`` source; each workbook is
  parsed inside a task (one task per file) with the standard library's zip
  and XML readers; cells come back as text and are typed like CSV.  Python gets
  a workbook in chunks, and keeps what is large of it in a temporary file.
* ``load`` dispatches on the file suffix.
"""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from array import array
from itertools import islice
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.text import NUMBER_RE
from tablelens.sources.csv_records import open_quote, records

# pandas' default strings read as missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
INT_RE = r"^\s*[+-]?\d+\s*$"
BOOL_TRUE = ("True", "TRUE", "true")
BOOL_FALSE = ("False", "FALSE", "false")
SUPPORTED_SUFFIXES = ("csv", "xlsx")


class SourceError(ValueError):
    """Missing, empty or unreadable input file."""


def _na_to_null(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    return df.select(*[F.when(~F.col(c).isin(list(tokens)), F.col(c)).alias(c) for c in df.columns])


def infer_types(df: DataFrame) -> DataFrame:
    """Retype all-string columns the way pandas' reader would: integer,
    float, boolean or text, decided from one aggregate over all columns."""
    cols = df.columns
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c)
        aggs += [F.count(v).alias(f"n{i}"),
                 F.count(F.when(v.rlike(INT_RE) & F.trim(v).try_cast("long").isNotNull(), 1)).alias(f"i{i}"),
                 F.count(F.when(v.rlike(NUMBER_RE), 1)).alias(f"f{i}"),
                 F.count(F.when(v.isin(list(BOOL_TRUE + BOOL_FALSE)), 1)).alias(f"b{i}")]
    r = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        n = r[f"n{i}"]
        v = F.col(c)
        if n and r[f"i{i}"] == n:
            out.append(F.trim(v).cast("long").alias(c))
        elif n and r[f"f{i}"] == n:
            out.append(F.trim(v).cast("double").alias(c))
        elif n and r[f"b{i}"] == n:
            out.append(v.isin(list(BOOL_TRUE)).alias(c))
        elif n == 0:
            out.append(v.cast("double").alias(c))  # all missing: float NaN column in pandas
        else:
            out.append(v)
    return df.select(*out)


def _by_form(spark: SparkSession, path: str, encoding: str | None, multiline: bool | None, sep: str) -> list[tuple[str, bool, list[str] | str]]:
    """(encoding, multiline, files), from one pass over the lines: the names of files with an undecodable line
    or a quoted line break are read back, nothing else."""
    if encoding and multiline is not None:
        return [(encoding, multiline, path)]
    lines = spark.read.text(path)
    bad = F.lit(False) if encoding else ~F.is_valid_utf8(F.col("value"))
    broken = open_quote(F.col("value"), sep) if multiline is None else F.lit(False)
    found = (lines.select(F.input_file_name().alias("file"), bad.alias("bad"), broken.alias("broken")).filter("bad or broken")
             .groupBy("file").agg(F.max("bad").alias("bad"), F.max("broken").alias("broken")).collect())
    plain = (encoding or "UTF-8", bool(multiline))
    if not found:
        return [(*plain, path)]
    groups = {plain: sorted(set(lines.inputFiles()) - {r.file for r in found})}  # names as URIs, so blanks are %20
    for r in sorted(found, key=lambda r: r.file):
        groups.setdefault(("ISO-8859-1" if r.bad else plain[0], r.broken or plain[1]), []).append(r.file)
    groups = {form: files for form, files in groups.items() if files}
    return [(*form, [unquote(f) for f in files] if len(groups) > 1 else path) for form, files in groups.items()]


def _by_encoding(spark: SparkSession, path: str) -> list[tuple[str, list[str] | str]]:
    """(encoding, files): the same for encodings alone."""
    return [(enc, files) for enc, _, files in _by_form(spark, path, None, False, ",")]


#: Encodings (beside the ISO-8859 and windows-125x families) that write quotes and line breaks as ASCII does.
_ASCII_LIKE = ("UTF-8", "US-ASCII")


def _parsed(spark: SparkSession, files, encoding: str, multiline: bool, sep: str) -> DataFrame:
    """Text columns named by the header."""
    whole = (spark.read.option("header", True).option("inferSchema", False).option("multiLine", multiline)
             .option("escape", '"').option("encoding", encoding).option("sep", sep)
             .option("nullValue", None).option("emptyValue", "").csv(files))
    if not multiline or not whole.columns or not encoding.upper().startswith((*_ASCII_LIKE, "ISO-8859-", "WINDOWS-125")):
        return whole
    ddl = ", ".join("`" + c.replace("`", "``") + "` string" for c in whole.columns)
    fields = F.from_csv("record", ddl, {"sep": sep, "escape": '"', "multiLine": "true", "emptyValue": ""})
    return records(spark, files, encoding, sep).select(fields.alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, multiline: bool | None = None,
             sep: str = ",", na_tokens=NA_TOKENS, typed: bool = True) -> DataFrame:
    """Scan CSV file(s) with a header row.  Missing path, empty file and
    undecodable file are distinct errors; each file that isn't UTF-8 is read
    as latin1, the others aren't.  Quoted line breaks stay in their fields (as in
    pandas): files with one are found first, and their records are put together
    from lines (``csv_records``).  ``multiline`` says it for all files instead: False
    takes every line for a row.  Files of either kind are split over tasks; only an
    ``encoding`` whose quotes and line breaks aren't ASCII bytes reads a file with
    quoted line breaks in one task."""
    try:
        groups = _by_form(spark, path, encoding, multiline, sep)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(path) from exc
        raise
    parts = [_parsed(spark, files, enc, many, sep) for enc, many, files in groups]
    parts = [x for x in parts if x.columns]
    if not parts:
        raise SourceError(f"empty CSV file: {path}")
    df = parts[0]
    for x in parts[1:]:
        df = df.unionByName(x, allowMissingColumns=True)
    df = _na_to_null(df, na_tokens)
    return infer_types(df) if typed else df


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> str:
    """CSV with a header row and RFC 4180 quoting (test fixtures, exports)."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("encoding", encoding).csv(path))
    return path


# -- Excel --------------------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "rel": "http://schemas.openxmlformats.org/package/2006/relationships"}


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _sheet_path(z: zipfile.ZipFile, sheet) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheets = wb.findall("m:sheets/m:sheet", _NS)
    if isinstance(sheet, int):
        el = sheets[sheet]
    else:
        el = next(s for s in sheets if s.get("name") == sheet)
    rid = el.get(f"{{{_NS['r']}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels.findall("rel:Relationship", _NS) if r.get("Id") == rid)
    target = target.lstrip("/")
    return target if target.startswith("xl/") else f"xl/{target}"


def _elements(z: zipfile.ZipFile, name: str, tag: str):
    """Elements of one tag of an XML part as they are read; each is dropped when the next is asked for."""
    with z.open(name) as part:
        parents: list[ET.Element] = []
        for event, el in ET.iterparse(part, events=("start", "end")):
            if event == "start":
                parents.append(el)
                continue
            parents.pop()
            if el.tag == tag:
                yield el
                if parents:
                    parents[-1].clear()  # the tree never holds more than the open path


class _Texts:
    """Strings by number.  Their bytes are in memory up to ``CHUNK``, else in a temporary file."""

    def __init__(self, texts):
        self.file = tempfile.SpooledTemporaryFile(CHUNK)
        self.ends = array("Q", [0])
        for t in texts:
            self.ends.append(self.ends[-1] + self.file.write(t.encode()))

    def __getitem__(self, i: int) -> str:
        start, end = self.ends[i], self.ends[i + 1]
        self.file.seek(start)
        return self.file.read(end - start).decode()


def iter_xlsx(content, sheet=0):
    """Rows of one sheet as lists of text cells (numbers keep their stored text), one at a time.  ``content``: a
    workbook's bytes, or a file of them."""
    z = zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content)
    ns = f"{{{_NS['m']}}}"
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = _Texts("".join(t.text or "" for t in si.iter(f"{ns}t")) for si in _elements(z, "xl/sharedStrings.xml", f"{ns}si"))
    for row in _elements(z, _sheet_path(z, sheet), f"{ns}row"):
        cells: dict[int, str | None] = {}
        for c in row.findall("m:c", _NS):
            t = c.get("t")
            if t == "inlineStr":
                val = "".join(x.text or "" for x in c.iter(f"{ns}t"))
            else:
                v = c.find("m:v", _NS)
                val = None if v is None else v.text
                if t == "s" and val is not None:
                    val = shared[int(val)]
                elif t == "b" and val is not None:
                    val = "True" if val == "1" else "False"
            cells[_col_index(c.get("r"))] = val
        if cells:
            yield [cells.get(i) for i in range(max(cells) + 1)]


def parse_xlsx(content, sheet=0, max_rows: int | None = None) -> list[list[str | None]]:
    """The sheet's rows, or the first ``max_rows``."""
    return list(islice(iter_xlsx(content, sheet), max_rows))


#: Rows of a sheet that become one batch.
EXCEL_BATCH = 10_000
#: Bytes of a workbook in a row on its way to Python; of these and of shared strings, what Python keeps in memory.
CHUNK = 4 << 20


def _chunks(files: DataFrame) -> DataFrame:
    """Each file's ``content`` as rows of at most ``CHUNK`` bytes, one after another in one partition."""
    last = F.greatest(F.ceil(F.length("content") / CHUNK).cast("int") - 1, F.lit(0))
    return (files.select("content", last.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
            .select(F.substring("content", F.col("i") * CHUNK + 1, F.lit(CHUNK)).alias("chunk"), (F.col("i") == F.col("n")).alias("last")))


def _workbooks(batches):
    """The files that ``_chunks`` cut, one at a time."""
    book = None
    for batch in batches:
        for chunk, last in zip(*batch.columns):
            book = book or tempfile.SpooledTemporaryFile(CHUNK)
            book.write(chunk.as_buffer())
            if last.as_py():
                with book:
                    yield book
                book = None


def read_excel(spark: SparkSession, path: str, sheet=0, typed: bool = True) -> DataFrame:
    """Scan .xlsx workbook(s); the first row of the sheet is the header.
    Headers are read first (one small row per file), then every workbook is
    parsed in its own task, row by row (a compressed sheet can't be split).  ``path``: a
    workbook or a folder of them."""
    from tablelens.session import ship_package
    ship_package(spark)
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    except AnalysisException as exc:
        raise FileNotFoundError(path) from exc

    def headers(it):
        for book in _workbooks(it):
            rows = parse_xlsx(book, sheet, max_rows=1)
            yield pa.RecordBatch.from_pydict({"h": ["\u0001".join("" if x is None else x for x in rows[0]) if rows else ""]})
    hs = [r["h"] for r in _chunks(files).mapInArrow(headers, "h string").distinct().collect()]
    hs = [h for h in hs if h]
    if not hs:
        raise SourceError(f"no readable sheet in {path}")
    cols = []
    for h in hs:
        for c in h.split("\u0001"):
            if c not in cols:
                cols.append(c)
    schema = ", ".join(f"`{c}` string" for c in cols)

    def body(it):
        for book in _workbooks(it):
            rows = iter_xlsx(book, sheet)
            head = ["" if x is None else x for x in next(rows, [])]
            at = [head.index(c) if c in head else None for c in cols]
            while batch := list(islice(rows, EXCEL_BATCH)):
                data = [pa.array([r[i] if i is not None and i < len(r) else None for r in batch], pa.string()) for i in at]
                yield pa.RecordBatch.from_arrays(data, cols)
    df = _chunks(files).mapInArrow(body, schema)
    df = _na_to_null(df)
    return infer_types(df) if typed else df


def load(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Dispatch on suffix: ``.csv`` or ``.xlsx``; anything else is rejected."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix == "csv":
        return read_csv(spark, path, **kw)
    if suffix == "xlsx":
        return read_excel(spark, path, **kw)
    raise SourceError(f"unsupported file type {suffix!r}; expected one of {SUPPORTED_SUFFIXES}")
