"""Workbooks as cells and typed rows. Files are read with ``binaryFile``; a cell is one row from then on.

The reader knows the file format only: a zip of XML parts, without formulas. A file that cannot be read gives one row
with an error instead of an exception, so one bad file does not end a job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL_SCHEMA = "file_name string, sheet string, row int, col int, coord string, text string, error string"

#: The sheets of a template and the headers that each must have.
REQUIRED_HEADERS = {
    "标签主文字": ("标签项目", "客户填写原文"),
    "企业信息": ("企业角色", "企业名称原文"),
    "营养表清单": ("营养表编号", "表名/适用范围"),
    "营养项目明细": ("营养表编号", "营养项目"),
    "多内容物组合装": ("内容物编号", "内容物名称"),
    "其他标签文字": ("标签文字类型", "客户填写原文"),
}
#: Spellings of headers.
HEADER_ALIASES = {"项目": "营养项目", "每100克": "每100g/mL含量", "每100克(g)": "每100g/mL含量", "每100克（g）": "每100g/mL含量", "每100g": "每100g/mL含量", "每100ml": "每100g/mL含量", "营养素参考值%": "NRV%"}
HEADER_ROWS = 10

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _number(value: float) -> str:
    """A number as typed: no trailing zeros, ten places at most."""
    if abs(value - round(value)) < 1e-9:
        return str(round(value))
    return f"{value:.10f}".rstrip("0").rstrip(".")


def _column(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n


def parse_workbook(content: bytes) -> Iterator[tuple[str, int, int, str, str]]:
    """(sheet, row, col, coord, text) of every cell with a value, rendered as shown."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())

        def part(name):
            return ElementTree.fromstring(z.read(name)) if name in names else None

        shared_part = part("xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in shared_part.findall("m:si", _NS)] if shared_part is not None else []
        styles, kinds = part("xl/styles.xml"), []
        if styles is not None:
            custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.findall("m:numFmts/m:numFmt", _NS)}
            for xf in styles.findall("m:cellXfs/m:xf", _NS):
                n = int(xf.get("numFmtId", "0"))
                code = custom.get(n, "")
                plain = re.sub(r'"[^"]*"|\[[^\]]*\]', "", code)
                kinds.append("%" if n in (9, 10) or "%" in code else "d" if n in _DATE_FORMATS or re.search(r"[ymdhs]", plain, re.I) else "")
        rels = {r.get("Id"): r.get("Target") for r in part("xl/_rels/workbook.xml.rels")}
        for s in part("xl/workbook.xml").findall("m:sheets/m:sheet", _NS):
            target = rels[s.get(f"{{{_NS['r']}}}id")].lstrip("/")
            sheet = part(target if target.startswith("xl/") else f"xl/{target}")
            for c in sheet.iter(f"{{{_NS['m']}}}c"):
                text = _cell_text(c, shared, kinds)
                if text:
                    coord = c.get("r")
                    letters = re.match(r"[A-Z]+", coord)[0]
                    yield s.get("name"), int(coord[len(letters) :]), _column(letters), coord, text


def _cell_text(c, shared: list[str], kinds: list[str]) -> str:
    kind, v = c.get("t", "n"), c.find("m:v", _NS)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")).strip()
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return shared[int(v.text)].strip()
    if kind == "b":
        return "是" if v.text == "1" else "否"
    if kind in ("str", "e", "d"):
        return v.text.strip()
    style = int(c.get("s", "0"))
    shown = kinds[style] if style < len(kinds) else ""
    value = float(v.text)
    if shown == "%":
        return _number(value * 100) + "%"
    return (date(1899, 12, 30) + timedelta(days=int(value))).isoformat() if shown == "d" else _number(value)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, sheet, row, col, coord, text, error): the cells of all workbooks under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file_name", "sheet", "row", "col", "coord", "text", "error"]
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    out += [(path, *c, None) for c in parse_workbook(content)]
                except (zipfile.BadZipFile, KeyError, ValueError, AttributeError, ElementTree.ParseError) as x:
                    out.append((path, None, None, None, None, None, f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(out, columns=names).astype({"row": "Int32", "col": "Int32"})

    return files.mapInPandas(cells, CELL_SCHEMA)


def missing_sheets(cells: DataFrame) -> DataFrame:
    """(file_name, sheet): required sheets that a workbook lacks."""
    books = cells.select("file_name").distinct()
    required = F.explode(F.array(*[F.lit(s) for s in REQUIRED_HEADERS])).alias("sheet")
    return books.select("file_name", required).join(cells.select("file_name", "sheet").distinct(), ["file_name", "sheet"], "left_anti")


def header_cells(cells: DataFrame) -> DataFrame:
    """(file_name, sheet, header_row, col, header): the first of the first rows that has all required headers.

    A header that occurs twice keeps its first column; headers of the form 列N and blanks are no headers.
    """
    name = F.regexp_replace("text", r"\s+", "")
    for alias, header in HEADER_ALIASES.items():
        name = F.when(name == alias, header).otherwise(name)
    named = cells.where((F.col("row") <= HEADER_ROWS) & F.col("sheet").isin(*REQUIRED_HEADERS) & ~F.col("text").rlike(r"^列\d+$"))
    named = named.withColumn("header", name)
    need = F.lit(None).cast("array<string>")
    for sheet, headers in REQUIRED_HEADERS.items():
        need = F.when(F.col("sheet") == sheet, F.array(*[F.lit(h) for h in headers])).otherwise(need)
    rows = named.groupBy("file_name", "sheet", "row").agg(F.collect_set("header").alias("have"))  # one row of a sheet
    located = rows.where(F.size(F.array_except(need, "have")) == 0).groupBy("file_name", "sheet").agg(F.min("row").alias("header_row"))
    first = named.join(located, ["file_name", "sheet"]).where(F.col("row") == F.col("header_row"))
    w = Window.partitionBy("file_name", "sheet", "header").orderBy("col")
    return first.withColumn("n", F.row_number().over(w)).where("n = 1").select("file_name", "sheet", "header_row", "col", "header")


def sheet_rows(cells: DataFrame) -> DataFrame:
    """(file_name, sheet, row, header, coord, text): the cells below the header, long form; empty rows have none."""
    head = header_cells(cells)
    return cells.join(head, ["file_name", "sheet", "col"]).where((F.col("row") > F.col("header_row")) & (F.trim("text") != "")).select(
        "file_name", "sheet", "row", "header", "coord", "text"
    )


def profile(cells: DataFrame) -> DataFrame:
    """(file_name, sheet, known, header_row, columns, ignored, n_rows): what each sheet of a workbook holds.

    ``columns`` are the headers read, ``ignored`` the columns with texts that have none; a sheet that is not required or
    without a header has neither.
    """
    seen = cells.where(F.col("sheet").isNotNull())
    head = header_cells(cells)
    read = head.groupBy("file_name", "sheet").agg(F.min("header_row").alias("header_row"), F.array_sort(F.collect_list(F.struct("col", "header"))).alias("h"))
    used = seen.where(F.trim("text") != "").groupBy("file_name", "sheet").agg(F.collect_set("col").alias("cols"))
    below = sheet_rows(cells).groupBy("file_name", "sheet").agg(F.count_distinct("row").alias("n_rows"))
    by = ["file_name", "sheet"]
    return (
        seen.select(*by).distinct().join(read, by, "left").join(used, by, "left").join(below, by, "left")
        .select(
            *by, F.col("sheet").isin(*REQUIRED_HEADERS).alias("known"), "header_row", F.transform("h", lambda x: x["header"]).alias("columns"),
            F.when(F.col("h").isNotNull(), F.array_sort(F.array_except("cols", F.transform("h", lambda x: x["col"])))).alias("ignored"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        )
    )
