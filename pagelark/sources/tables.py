"""Tables of text columns: CSV in two encodings and workbook sheets."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from array import array
from collections.abc import Iterator, Sequence
from datetime import date, timedelta
from itertools import chain, islice
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stored import place_of

#: Rows of a sheet that are passed on at once, and those that a workbook is given.
SHEET_ROWS, SHEET_LIMIT = 10_000, 1_000_000
CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """UTF-8 with header, a byte-order mark or not, quoted line breaks; all columns are texts, blanks are "" ."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "")
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path).na.fill("")


def read_gb18030(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """GB18030 with header; rows of another length keep their text in _corrupt_record.

    Spark reads this encoding only where spark.sql.legacy.javaCharsets is on; the session's owner sets that. Cache or
    select _corrupt_record together with what is counted: column pruning would hide short rows.
    """
    if spark.conf.get("spark.sql.legacy.javaCharsets", "false").lower() != "true":
        raise ValueError("reading GB18030 needs spark.sql.legacy.javaCharsets=true")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, CORRUPT)])
    return spark.read.schema(schema).option("header", True).option("encoding", "GB18030").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
_DATE_FORMATS = {14, 15, 16, 17, 22, 30, 36, 45, 46, 47}


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


class _Texts:
    """Shared strings of a workbook, one after another in UTF-8, so that they take no more than their bytes."""

    def __init__(self):
        self.bytes, self.ends = bytearray(), array("Q", [0])

    def add(self, text: str) -> None:
        self.bytes += text.encode("utf-8", "surrogatepass")
        self.ends.append(len(self.bytes))

    def __getitem__(self, i: int) -> str:
        return self.bytes[self.ends[i] : self.ends[i + 1]].decode("utf-8", "surrogatepass")


def _elements(file: BinaryIO, tag: str, within: str) -> Iterator[ElementTree.Element]:
    """Elements of a tag as they end; what lies in the element around them is let go, so that memory stays bounded."""
    around = None
    for event, element in ElementTree.iterparse(file, ("start", "end")):
        if event == "start" and element.tag == within:
            around = element
        elif event == "end" and element.tag == tag:
            yield element
            if around is not None:
                around.clear()


def _plain(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{{{_NS['m']}}}t"))


def _date_styles(styles: ElementTree.Element) -> set[int]:
    """Cell styles that show a number as a date."""
    coded = lambda f: re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower())
    own = {int(f.get("numFmtId")) for f in styles.iterfind("m:numFmts/m:numFmt", _NS) if re.search(r"[ymd]", coded(f))}
    return {i for i, x in enumerate(styles.iterfind("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


def _cell(c: ElementTree.Element, shared: _Texts, dated: set[int]) -> str:
    kind, value = c.get("t"), c.findtext("m:v", "", _NS)
    if kind == "s":
        return shared[int(value)]
    if kind == "inlineStr":
        return _plain(c)
    if kind == "b":
        return "True" if value == "1" else "False"
    if value and kind in (None, "n") and int(c.get("s", 0)) in dated:
        return (date(1899, 12, 30) + timedelta(days=int(float(value)))).isoformat()
    return value or ""


def sheet_rows(content: bytes | BinaryIO, sheet: str) -> Iterator[list[str]]:
    """Cells of a workbook's sheet as texts, row by row; dates as ISO dates.

    The sheet is parsed as it is unpacked, so only one row is held, and the shared strings.
    """
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes | bytearray) else content) as z:
        xml = lambda name: ElementTree.fromstring(z.read(name))
        tag = lambda name: f"{{{_NS['m']}}}{name}"
        names, shared = set(z.namelist()), _Texts()
        found = next((s for s in xml("xl/workbook.xml").iterfind("m:sheets/m:sheet", _NS) if s.get("name") == sheet), None)
        if found is None:
            raise ValueError(f"no sheet {sheet}")
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as file:
                for item in _elements(file, tag("si"), tag("sst")):
                    shared.add(_plain(item))
        dated = _date_styles(xml("xl/styles.xml")) if "xl/styles.xml" in names else set()
        links = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels").iter(_PACKAGE)}
        target = links[found.get(f"{{{_NS['r']}}}id")].lstrip("/")
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as file:
            for row in _elements(file, tag("row"), tag("sheetData")):
                cells: list[str] = []
                for i, c in enumerate(row.iterfind("m:c", _NS)):
                    at = _column(c.get("r")) if c.get("r") else i
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = _cell(c, shared, dated).strip()
                yield cells


def _sheet_frames(files: Iterator[bytes | BinaryIO], sheet: str, columns: Sequence[str]) -> Iterator[pd.DataFrame]:
    for content in files:
        body = sheet_rows(content, sheet)
        header = next(body, [])
        if missing := sorted(set(columns) - set(header)):
            raise ValueError(f"sheet {sheet} lacks {missing}")
        at = [header.index(c) for c in columns]
        kept = ([r[i] if i < len(r) else "" for i in at] for r in body if any(r))
        while some := list(islice(kept, SHEET_ROWS)):
            yield pd.DataFrame(some, columns=list(columns), dtype=str)


def _text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_sheet(spark: SparkSession, path: str, sheet: str, columns: Sequence[str]) -> DataFrame:
    """A sheet's rows as texts under the names of its first row; all-blank rows go, short rows are filled with "".

    Of the header only `columns` are kept, and a header without one of them fails the read. Rows come in batches of
    SHEET_ROWS. Any store that Spark reads will do; `sheets` reads workbooks too big to be one value.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    contents = lambda batches: (c for batch in batches for c in batch["content"])
    return files.mapInPandas(lambda batches: _sheet_frames(contents(batches), sheet, columns), _text_schema(columns))


def sheets(paths: DataFrame, sheet: str, columns: Sequence[str]) -> DataFrame:
    """read_sheet of the workbooks that paths (path) lists, each opened by its task and read by seeking."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[BinaryIO]:
        for path in (p for batch in batches for p in batch["path"]):
            system, place = place_of(path)
            with system.open_input_file(place) as file:
                yield file

    return paths.where("path is not null").select("path").mapInPandas(lambda batches: _sheet_frames(opened(batches), sheet, columns), _text_schema(columns))


def write_sheets(rows: DataFrame, folder: str, sheet: str) -> DataFrame:
    """Workbooks of texts, one for each task and each SHEET_LIMIT rows of it; returns path and rows of each.

    Nulls are blank cells. Names are new with each attempt of a task: read the workbooks by the paths that are returned.
    """
    columns = rows.columns

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = place_of(folder)
        system.create_dir(root, recursive=True)
        left = (r for batch in batches for r in batch.itertuples(index=False, name=None))
        while (first := next(left, None)) is not None:
            name, n = f"{uuid.uuid4().hex}.xlsx", 0
            with system.open_output_stream(f"{root}/{name}") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="r1"/></sheets></workbook>')
                z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE[1:].partition("}")[0]}"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
                with z.open("xl/worksheets/sheet1.xml", "w") as part:
                    part.write(f'<worksheet xmlns="{_NS["m"]}"><sheetData>'.encode())
                    for cells in chain([columns, first], islice(left, SHEET_LIMIT - 1)):
                        texts = ("" if c is None else f'<is><t xml:space="preserve">{escape(c)}</t></is>' for c in cells)
                        part.write(f"<row>{''.join(f'<c t="inlineStr">{t}</c>' for t in texts)}</row>".encode())
                        n += 1
                    part.write(b"</sheetData></worksheet>")
            yield pd.DataFrame({"path": [f"{folder.rstrip('/')}/{name}"], "rows": [n - 1]})

    return rows.select(*[F.col(c).cast("string").alias(c) for c in columns]).mapInPandas(written, "path string, rows long")


def has_content(df: DataFrame) -> DataFrame:
    """Rows with a non-blank cell."""
    return df.where(F.exists(F.array(*[F.col(c).cast("string") for c in df.columns]), lambda x: F.coalesce(x, F.lit("")) != ""))
