"""Workbooks of the binary package format: records of variable length in a zip file."""

from __future__ import annotations

import posixpath
import struct
import zipfile
from xml.etree import ElementTree

from gridloom.sources.biff import rk_number
from gridloom.sources.grid import DATE_FORMATS, ERROR_CODES, ERROR_TEXT, bool_text, date_text, fill_merged, is_date_format, number_text, put


def records(data: bytes):
    """(id, body); ids take one or two bytes, lengths up to four, seven bits each."""
    at = 0
    while at < len(data):
        kind = data[at]
        at += 1
        if kind & 0x80:
            kind, at = (kind & 0x7F) | (data[at] & 0x7F) << 7, at + 1
        size = shift = 0
        while True:
            size |= (data[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if not data[at - 1] & 0x80 or shift == 28:
                break
        yield kind, data[at : at + size]
        at += size


def _wide(body: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", body, at)[0]
    if n == 0xFFFFFFFF:
        return "", at + 4
    return body[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


def _part(z: zipfile.ZipFile, name: str) -> bytes:
    return z.read(name) if name in z.namelist() else b""


def xlsb_grids(z: zipfile.ZipFile):
    """(sheet, grid) of the worksheets, hidden ones too."""
    rels = {r.get("Id"): r for r in ElementTree.fromstring(z.read("xl/_rels/workbook.bin.rels"))}
    sheets, base_1904 = [], False
    for kind, body in records(z.read("xl/workbook.bin")):
        if kind == 153:
            base_1904 = bool(body[0] & 1)
        elif kind == 156:
            rel, at = _wide(body, 8)
            r = rels.get(rel)
            if r is not None and r.get("Type", "").endswith("/worksheet"):
                target = r.get("Target")
                sheets.append((_wide(body, at)[0], target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)))
    strings = [_wide(body, 1)[0] for kind, body in records(_part(z, "xl/sharedStrings.bin")) if kind == 19]
    dates = _date_styles(_part(z, "xl/styles.bin"))
    for name, part in sheets:
        yield name, _sheet(z.read(part), strings, dates, base_1904)


def _date_styles(data: bytes) -> set[int]:
    formats, styles, inside = {}, [], False
    for kind, body in records(data):
        if kind == 44:
            formats[struct.unpack_from("<H", body)[0]] = _wide(body, 2)[0]
        elif kind in (617, 618):
            inside = kind == 617
        elif kind == 47 and inside:
            styles.append(struct.unpack_from("<H", body, 2)[0])
    return {i for i, f in enumerate(styles) if (is_date_format(formats[f]) if f in formats else f in DATE_FORMATS)}


def _sheet(data: bytes, strings: list[str], dates: set[int], base_1904: bool) -> list[list]:
    grid: list[list] = []
    ranges, row = [], 0
    for kind, body in records(data):
        if kind == 0:
            row = struct.unpack_from("<I", body)[0]
        elif kind == 176:
            ranges.append(struct.unpack_from("<4I", body))
        elif 1 <= kind <= 11:
            col, style = struct.unpack_from("<II", body)
            style &= 0xFFFFFF
            value = None
            if kind in (2, 5, 9):
                x = rk_number(struct.unpack_from("<I", body, 8)[0]) if kind == 2 else struct.unpack_from("<d", body, 8)[0]
                value = date_text(x, base_1904) if style in dates else number_text(x)
            elif kind in (3, 11):
                value = ERROR_CODES.get(body[8], ERROR_TEXT)
            elif kind in (4, 10):
                value = bool_text(bool(body[8]))
            elif kind in (6, 8):
                value = _wide(body, 8)[0] or None
            elif kind == 7:
                value = strings[struct.unpack_from("<I", body, 8)[0]] or None
            put(grid, row, col, value)
    fill_merged(grid, ranges)
    return grid
