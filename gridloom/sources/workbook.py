"""Folders of csv files and workbooks as one bronze frame, one row for each table row.

Each file is parsed where Spark reads it (binaryFile to mapInPandas): a file is
one compressed container, so the file is the unit of work. Headers come along
as rows of kind ``header``, findings as rows of kind ``issue``.
"""

from __future__ import annotations

import codecs
import csv
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.extract import build_table
from gridloom.sources.biff import MAGIC, xls_grids
from gridloom.sources.grid import DATE_FORMATS, ERROR_TEXT, bool_text, date_text, fill_merged, is_date_format, number_text
from gridloom.sources.xlsb import xlsb_grids

EXTENSIONS = (".xlsx", ".xlsm", ".xls", ".xlsb", ".csv")
OWN_PREFIX = "汇总结果_"
CSV_SHEET = "CSV"
#: kind: header, row or issue; note: of a row its cells' kinds, of an issue its severity, type and message.
BRONZE = "file string, sheet string, sheet_ord int, kind string, row_no int, cells array<string>, note string"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def decode_csv(data: bytes) -> str:
    """BOMs first, then strict UTF-8, then Chinese encodings, then western ones."""
    for bom, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(bom):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    try:
        text = data.decode("gb18030")
        if re.search("[一-鿿]", text):
            return text
    except UnicodeDecodeError:
        pass
    for name in ("cp1252", "gb18030", "latin-1"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def csv_grid(data: bytes) -> list[list]:
    text = decode_csv(data)
    if not text.strip():
        return []
    try:
        delimiter = csv.Sniffer().sniff(text[:8192], ",\t;|").delimiter
    except csv.Error:
        first = text.splitlines()[0]
        delimiter = max(",\t;|", key=first.count)
        delimiter = delimiter if first.count(delimiter) else ","
    return [[c if c != "" else None for c in row] for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)]


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def xlsx_sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the worksheets, hidden ones too, chart sheets not."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    rels = {r.get("Id"): r for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in book.iterfind("m:sheets/m:sheet", _NS):
        r = rels.get(s.get(_REL))
        if r is not None and r.get("Type", "").endswith("/worksheet"):
            target = r.get("Target")
            out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)))
    return out


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    custom = {int(n.get("numFmtId")): is_date_format(n.get("formatCode", "")) for n in root.iterfind("m:numFmts/m:numFmt", _NS)}
    return {i for i, x in enumerate(root.iterfind("m:cellXfs/m:xf", _NS)) if custom.get(int(x.get("numFmtId", 0)), int(x.get("numFmtId", 0)) in DATE_FORMATS)}


def xlsx_grid(z: zipfile.ZipFile, part: str, strings: list[str], dates: set[int]) -> list[list]:
    """Cells as text with absolute coordinates, merged ranges filled from their first cell."""
    grid: list[list] = []
    merges: list[str] = []
    for _, el in ElementTree.iterparse(io.BytesIO(z.read(part))):
        tag = el.tag.rpartition("}")[2]
        if tag == "row":
            r = int(el.get("r", len(grid) + 1)) - 1
            grid.extend([] for _ in range(r + 1 - len(grid)))
            for c in el.iterfind("m:c", _NS):
                k = _column(c.get("r")) if c.get("r") else len(grid[r])
                grid[r].extend([None] * (k + 1 - len(grid[r])))
                grid[r][k] = _cell(c, strings, dates)
            el.clear()
        elif tag == "mergeCell":
            merges.append(el.get("ref"))
    corners = [[(int(re.sub(r"\D", "", x)) - 1, _column(x)) for x in (ref.split(":") * 2)[:2]] for ref in merges]
    fill_merged(grid, [(a[0], b[0], a[1], b[1]) for a, b in corners])
    return grid


def _cell(c, strings: list[str], dates: set[int]) -> str | None:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        text = "".join(t.text or "" for t in c.iterfind(".//m:t", _NS))
        return text or None
    v = c.find("m:v", _NS)
    if v is None or v.text is None:
        return ERROR_TEXT if kind == "e" else None
    if kind == "s":
        return strings[int(v.text)] or None
    if kind == "b":
        return bool_text(v.text == "1")
    if kind == "n" and int(c.get("s", 0)) in dates:
        return date_text(float(v.text))
    if kind == "n":
        return number_text(float(v.text))
    return v.text


def grids(name: str, data: bytes):
    """(sheet, grid) of each table of a file."""
    if name.lower().endswith(".csv"):
        yield CSV_SHEET, csv_grid(data)
        return
    if data.startswith(MAGIC):
        yield from xls_grids(data)
        return
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "xl/workbook.bin" in z.namelist():
            yield from xlsb_grids(z)
            return
        strings: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iterfind(".//m:t", _NS)) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
        dates = _date_styles(z)
        for sheet, part in xlsx_sheets(z):
            yield sheet, xlsx_grid(z, part, strings, dates)


def read_folder(spark: SparkSession, folder: str, recursive: bool = False, excluded: tuple[str, ...] = (), header_rows: dict[str, int] | None = None) -> DataFrame:
    """The bronze frame of all readable tables under ``folder``. Excluded are ``file|sheet`` or ``file|*``; header rows count from 1 by ``file|sheet``."""
    header_rows, skip = header_rows or {}, frozenset(excluded)
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "content")
    files = files.withColumn("file", F.regexp_replace("path", "^.*?" + re.escape(re.sub(r"^\w+:/*", "/", root)) + "/", ""))
    base = F.element_at(F.split("file", "/"), -1)
    wanted = F.lower(base).rlike(r"\.(xlsx|xlsm|xls|xlsb|csv)$") & ~base.rlike(r"^(~\$|\.)") & ~F.col("file").rlike(r"(^|/)\.[^/]*/") & ~base.startswith(OWN_PREFIX)

    def parse(frames):
        for frame in frames:
            for name, data in zip(frame["file"], frame["content"]):
                out = []
                if f"{name}|*" in skip:
                    continue
                if not len(data):
                    out.append((name, "", 0, "issue", None, None, "警告|空文件/空Sheet|文件为空"))
                else:
                    try:
                        for k, (sheet, grid) in enumerate(grids(name, bytes(data))):
                            if f"{name}|{sheet}" not in skip:
                                out += [(name, sheet, k, kind, row, cells, note) for kind, row, cells, note in build_table(grid, header_rows.get(f"{name}|{sheet}"))]
                    except Exception as e:  # a broken file is a finding, not a failure
                        out.append((name, "", 0, "issue", None, None, f"错误|文件读取失败|{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=["file", "sheet", "sheet_ord", "kind", "row_no", "cells", "note"]).astype({"row_no": "Int32", "sheet_ord": "int32"})

    bronze = files.where(wanted).select("file", "content").mapInPandas(parse, BRONZE)
    empty = [(name, "", 0, "issue", None, None, "警告|空文件/空Sheet|文件为空") for name in _empty_files(spark, root, recursive) if f"{name}|*" not in skip]
    return bronze.unionByName(spark.createDataFrame(empty, BRONZE)) if empty else bronze


def count_files(spark: SparkSession, folder: str, recursive: bool = False) -> int:
    """Tables that a run would read, broken and empty ones too; from the listing alone."""
    return len(_listed(spark, folder.rstrip("/"), recursive))


def folder_exists(spark: SparkSession, folder: str) -> bool:
    if not folder:
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(path) and fs.getFileStatus(path).isDirectory()


def _empty_files(spark: SparkSession, root: str, recursive: bool) -> list[str]:
    """Names of 0-byte tables, which Spark's readers leave out."""
    return [name for name, size in _listed(spark, root, recursive) if not size]


def _listed(spark: SparkSession, root: str, recursive: bool) -> list[tuple[str, int]]:
    """Names and sizes of the tables under ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    base, out = fs.makeQualified(path).toUri().getPath().rstrip("/") + "/", []
    found = fs.listFiles(path, recursive)
    while found.hasNext():
        f = found.next()
        name = f.getPath().toUri().getPath().removeprefix(base)
        last = name.rpartition("/")[2]
        if last.lower().endswith(EXTENSIONS) and not last.startswith(("~$", ".", OWN_PREFIX)) and not re.search(r"(^|/)\.[^/]*/", name):
            out.append((name, f.getLen()))
    return sorted(out)
