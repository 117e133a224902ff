"""xlsx files from frames: tasks render the rows, and the driver numbers them and writes each file as one stream."""

from __future__ import annotations

import datetime as dt
import math
import os
import re
import tempfile
import unicodedata
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS, MAX_TEXT = 1_048_575, 32_767
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")
#: In rendered rows: where the row number goes, what ends a row; neither is legal in a cell. Rows that a task renders at a time.
NUMBER, END, CHUNK = "\x01", "\x02", 500
_EPOCH = dt.datetime(1899, 12, 30)
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_STYLES = (
    _HEAD + '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/><numFmt numFmtId="165" formatCode="yyyy-mm-dd hh:mm:ss"/></numFmts>'
    '<fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts>'
    '<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFD9E1F2"/></patternFill></fill></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="6"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/>'
    '<xf numFmtId="3" applyNumberFormat="1"/><xf numFmtId="4" applyNumberFormat="1"/><xf numFmtId="164" applyNumberFormat="1"/><xf numFmtId="165" applyNumberFormat="1"/></cellXfs></styleSheet>'
)


def safe_sheet_title(title: str, taken: set[str]) -> str:
    """No characters that sheets can't have, 31 at most, unique whatever the case; ``taken`` gets it."""
    base = re.sub(r"[\[\]:*?/\\]", "_", title).strip("'")[:31] or "Sheet"
    name, k = base, 2
    while name.lower() in taken:
        tail = f"_{k}"
        name, k = base[: 31 - len(tail)] + tail, k + 1
    taken.add(name.lower())
    return name


def safe_filename(name: str, taken: set[str]) -> str:
    base = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", name).strip(" .")[:100] or "_"
    base = "_" + base if re.fullmatch(r"(?i)(con|prn|aux|nul|com\d|lpt\d)", base) else base
    out, k = base, 2
    while out.lower() in taken:
        out, k = f"{base}_{k}", k + 1
    taken.add(out.lower())
    return out


def display_width(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def column_ref(i: int) -> str:
    s = ""
    while i >= 0:
        s, i = chr(65 + i % 26) + s, i // 26 - 1
    return s


def cell_xml(ref: str, v) -> str:
    """Texts as inline strings, never formulas; dates before March 1900 as text."""
    if v is None or (isinstance(v, float) and not math.isfinite(v)):
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int):
        return f'<c r="{ref}" s="2"><v>{v}</v></c>'
    if isinstance(v, float):
        whole = v.is_integer() and abs(v) < 1e15
        return f'<c r="{ref}" s="{2 if whole else 3}"><v>{int(v) if whole else repr(v)}</v></c>'
    if isinstance(v, dt.date):
        t = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
        midnight = t.time() == dt.time()
        if t >= dt.datetime(1900, 3, 1):
            serial = (t.replace(tzinfo=None) - _EPOCH) / dt.timedelta(days=1)
            return f'<c r="{ref}" s="{4 if midnight else 5}"><v>{int(serial) if midnight else repr(serial)}</v></c>'
        v = t.strftime("%Y-%m-%d" if midnight else "%Y-%m-%d %H:%M:%S")
    text = _ILLEGAL.sub("", str(v))[:MAX_TEXT]
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def row_xml(refs: list[str], row: Iterable, number: str) -> str:
    return "".join(cell_xml(c + number, v) for c, v in zip(refs, row))


def write_xlsx(path: str, sheets: list[tuple[str, list[str], Iterable]]) -> None:
    """(title, header, rows) of each sheet, a row being its values or rendered text; long ones go on in ``title_2`` and so on. The file appears only when it is whole."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    os.close(fd)
    titles: list[str] = []
    taken: set[str] = set()
    try:
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
            for title, header, rows in sheets:
                it, more, part = iter(rows), True, 1
                held = None
                while more:
                    titles.append(safe_sheet_title(title if part == 1 else f"{title}_{part}", taken))
                    more = False
                    with z.open(f"xl/worksheets/sheet{len(titles)}.xml", "w", force_zip64=True) as f:
                        widths = "".join(f'<col min="{i}" max="{i}" width="{min(60, max(6, display_width(h) + 4))}" customWidth="1"/>' for i, h in enumerate(header, 1))
                        f.write((_HEAD + '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' + (f"<cols>{widths}</cols>" if widths else "") + "<sheetData>").encode())
                        f.write(("<row r=\"1\">" + "".join(f'<c r="{column_ref(i)}1" t="inlineStr" s="1"><is><t xml:space="preserve">{escape(_ILLEGAL.sub("", h))}</t></is></c>' for i, h in enumerate(header)) + "</row>").encode())
                        refs, n, lines = [column_ref(i) for i in range(len(header))], 1, []
                        while True:
                            row = held if held is not None else next(it, None)
                            held = None
                            if row is None:
                                break
                            if n > MAX_ROWS:
                                held, more, part = row, True, part + 1
                                break
                            n += 1
                            cells = row.replace(NUMBER, str(n)) if isinstance(row, str) else row_xml(refs, row, str(n))
                            lines.append(f'<row r="{n}">{cells}</row>')
                            if len(lines) == 2000:
                                f.write("".join(lines).encode())
                                lines = []
                        f.write(("".join(lines) + "</sheetData></worksheet>").encode())
            ids = range(1, len(titles) + 1)
            z.writestr("[Content_Types].xml", _HEAD + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in ids) + "</Types>")
            rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
            z.writestr("_rels/.rels", _HEAD + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/_rels/workbook.xml.rels", _HEAD + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + f'<Relationship Id="rId{len(titles) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", _HEAD + f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, t in zip(ids, titles)) + "</sheets></workbook>")
            z.writestr("xl/styles.xml", _STYLES)
        os.replace(tmp, path)
    finally:
        if os.path.exists(tmp):
            os.remove(tmp)


def rendered(df: DataFrame) -> Iterator[str]:
    """The rows of a frame as cells without their row number, in order; they stream partition by partition."""
    refs = [column_ref(i) for i in range(len(df.columns))]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                rows = zip(*(c.slice(at, CHUNK).to_pylist() for c in b.columns))
                yield pa.RecordBatch.from_arrays([pa.array([END.join(row_xml(refs, row, NUMBER) for row in rows)])], names=["rows"])

    # Session time first: Arrow would hand out UTC.
    cells = df.toDF(*refs).select(*(F.col(c).cast("timestamp_ntz") if kind == "timestamp" else F.col(c) for c, (_, kind) in zip(refs, df.dtypes)))
    chunks = cells.mapInArrow(run, "rows string").persist()
    try:
        chunks.count()  # renders all partitions at once; the iterator asks for one after the other
        for chunk in chunks.toLocalIterator(prefetchPartitions=True):
            yield from chunk[0].split(END)
    finally:
        chunks.unpersist()


def sheet(title: str, df: DataFrame) -> tuple[str, list[str], Iterable]:
    """A frame as a sheet."""
    return title, df.columns, rendered(df)
