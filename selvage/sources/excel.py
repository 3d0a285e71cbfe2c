"""Workbooks (.xlsx, .xlsm) as cells and as rows under their header; each workbook is read within one task."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = "file string, sheet string, row int, col int, text string, error string"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _place(reference: str) -> tuple[int, int]:
    """Row and column, from 0, of a reference like AB12."""
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", reference).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


def _said(node: ElementTree.Element) -> str:
    """The text of all runs of a string, without its phonetic hints."""
    return "".join(t.text or "" for child in node for t in ([child] if _local(child.tag) == "t" else child.iter() if _local(child.tag) == "r" else []) if _local(t.tag) == "t")


#: Fixed: the built-in numbers of formats that show a day, and those that show a time alone.
_DAYS = {14, 15, 16, 17, 22, *range(27, 32), 34, 35, 36, *range(50, 59)}
_TIMES = {18, 19, 20, 21, 32, 33, 45, 46, 47}


def _kind_of_format(code: str) -> str | None:
    """Whether a format shows a day or a time: its letters outside of quotes, brackets and escapes."""
    plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", code.split(";")[0].lower())
    return "day" if re.search("[yd]", plain) else "time" if re.search("[hs]", plain) else None


def _date_styles(book: zipfile.ZipFile, names: set[str]) -> list[str | None]:
    """For each cell style of the book, whether it shows a day or a time."""
    if "xl/styles.xml" not in names:
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")): _kind_of_format(x.get("formatCode") or "") for x in root.iter() if _local(x.tag) == "numFmt"}
    styles = next((x for x in root if _local(x.tag) == "cellXfs"), [])
    ids = [int(x.get("numFmtId") or 0) for x in styles if _local(x.tag) == "xf"]
    return [own[n] if n in own else "day" if n in _DAYS else "time" if n in _TIMES else None for n in ids]


def _dated(value: str, kind: str, from_1904: bool) -> str:
    """A stored number of days as ISO text; what can't be one stays as it is. The books' calendar since 1900 has a 29th of February in that year, which there wasn't."""
    try:
        days = float(value)
        if not 0 <= days < 2_958_466:
            return value
        start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30) if days >= 60 else datetime(1899, 12, 31)
        at = start + timedelta(seconds=round(days * 86400))
    except (ValueError, OverflowError):
        return value
    if kind == "time" and days < 1:
        return at.strftime("%H:%M:%S")
    return at.strftime("%Y-%m-%d") if days == int(days) else at.strftime("%Y-%m-%d %H:%M:%S")


def cells_of(data: bytes) -> list[tuple[str, int, int, str]]:
    """Sheet, row, column and text of each cell with a value; numbers as they are stored, and those whose style shows a day or a time as ISO text."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        kinds = _date_styles(book, names)
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
        from_1904 = any(_local(x.tag) == "workbookPr" and x.get("date1904") in ("1", "true") for x in workbook.iter())
        shared = [_said(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (x for x in workbook.iter() if _local(x.tag) == "sheet"):
            target = next(targets[v] for k, v in sheet.attrib.items() if _local(k) == "id").lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            if path not in names:
                continue
            with book.open(path) as stream:
                for _, cell in ElementTree.iterparse(stream):
                    if _local(cell.tag) == "row":
                        cell.clear()
                    if _local(cell.tag) != "c" or not cell.get("r"):
                        continue
                    value = next((x.text for x in cell if _local(x.tag) == "v"), None)
                    if cell.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = next((_said(x) for x in cell if _local(x.tag) == "is"), None)
                    elif value is not None and cell.get("t", "n") == "n" and int(cell.get("s") or 0) < len(kinds) and kinds[int(cell.get("s") or 0)]:
                        value = _dated(value, kinds[int(cell.get("s") or 0)], from_1904)
                    if value not in (None, ""):
                        out.append((sheet.get("name"), *_place(cell.get("r")), value))
    return out


def read_cells(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, sheet, row, col (from 0), text of all cells of the workbooks; a file that is no workbook gives one row with its error."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def work(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows = [(path, *c, None) for c in cells_of(bytes(content))]
                except Exception as e:  # a damaged or protected file doesn't stop the others; its row says why
                    rows = [(path, None, None, None, None, type(e).__name__)]
                made = pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")])
                yield made.astype({"row": "Int32", "col": "Int32"})

    return files.mapInPandas(work, CELLS)


def with_header(cells: DataFrame) -> DataFrame:
    """file, sheet, header (array) and values (array of the same length) of each row below a sheet's first row with cells."""
    cells = cells.where("error is null")
    sheet = Window.partitionBy("file", "sheet")
    rows = cells.withColumn("_top", F.min("row").over(sheet))
    header = rows.where("row = _top").groupBy("file", "sheet").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("header"))
    values = rows.where("row > _top").groupBy("file", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("_values"))
    joined = values.join(header, ["file", "sheet"])
    return joined.select("file", "sheet", "row", F.col("header.text").alias("header"), F.transform("header", lambda h: F.try_element_at("_values", h["col"])).alias("values"))
