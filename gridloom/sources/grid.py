"""What the readers of all workbook formats share: cells as text, merged ranges, date formats."""

from __future__ import annotations

import re

import pandas as pd

#: Built-in number formats that are dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
# Error codes of the binary formats.
ERROR_CODES = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A", 0x2B: "#GETTING_DATA"}
ERROR_TEXT = "#错误"


def is_date_format(code: str) -> bool:
    """True if a number format shows a date or a time: its letters outside quotes, brackets and escapes."""
    return bool(re.search("[ymdhs年月日]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code or ""), re.I))


class Cell(str):
    """A cell's text and its kind: t text, n number, d date, m time of day, b boolean; plain strings are text."""

    kind = "t"

    @classmethod
    def of(cls, text: str, kind: str) -> "Cell":
        cell = cls(text)
        cell.kind = kind
        return cell


def cell_kinds(cells: list) -> str:
    """One letter a cell."""
    return "".join(getattr(v, "kind", "t") for v in cells)


def bool_text(x: bool) -> Cell:
    return Cell.of("True" if x else "False", "b")


def number_text(x: float) -> Cell:
    return Cell.of(str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x), "n")


def date_text(serial: float, base_1904: bool = False) -> Cell:
    """A date cell as ISO text; under one day, the time alone."""
    if 0 <= serial < 1:
        seconds = round(serial * 86400)
        return Cell.of(f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}", "m")
    t = pd.Timestamp("1904-01-01" if base_1904 else "1899-12-30") + pd.to_timedelta(round(serial * 86400), unit="s")
    return Cell.of(t.strftime("%Y-%m-%d") if t == t.normalize() else t.strftime("%Y-%m-%d %H:%M:%S"), "d")


def put(grid: list[list], row: int, column: int, value: str | None) -> None:
    """Set one cell by absolute coordinates; the grid grows as needed."""
    grid.extend([] for _ in range(row + 1 - len(grid)))
    grid[row].extend([None] * (column + 1 - len(grid[row])))
    grid[row][column] = value


def fill_merged(grid: list[list], ranges: list[tuple[int, int, int, int]]) -> None:
    """Copy the first cell of each (top, bottom, left, right) to the whole range; no new rows."""
    for top, bottom, left, right in ranges:
        first = grid[top][left] if top < len(grid) and left < len(grid[top]) else None
        if first is None:
            continue
        for r in range(top, min(bottom + 1, len(grid))):
            grid[r].extend([None] * (right + 1 - len(grid[r])))
            grid[r][left : right + 1] = [first] * (right - left + 1)
