"""Workbooks of the older binary format: BIFF8 records in a compound file."""

from __future__ import annotations

import struct

from gridloom.sources.grid import DATE_FORMATS, ERROR_CODES, ERROR_TEXT, bool_text, date_text, fill_merged, is_date_format, number_text, put

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_LAST = 0xFFFFFFFA  # sector numbers from here on are marks


def workbook_stream(data: bytes) -> bytes:
    """The ``Workbook`` stream of a compound file."""
    if data[:8] != MAGIC:
        raise ValueError("not a compound file")
    size, mini_size = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    dir_start, cutoff, mini_start, difat = (struct.unpack_from("<I", data, at)[0] for at in (48, 56, 60, 68))
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    words = lambda b: struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4])
    fat_sectors, seen = list(struct.unpack_from("<109I", data, 76)), 0
    while difat < _LAST and seen <= len(data) // size:
        *more, difat = words(sector(difat))
        fat_sectors += more
        seen += 1
    fat = [x for n in fat_sectors if n < _LAST for x in words(sector(n))]

    def chain(start: int, table: list[int], read) -> bytes:
        out, n = [], start
        while n < len(table) and len(out) <= len(table):
            out.append(read(n))
            n = table[n]
        return b"".join(out)

    directory = chain(dir_start, fat, sector)
    entries = []
    for at in range(0, len(directory) - 127, 128):
        n = struct.unpack_from("<H", directory, at + 64)[0]
        if directory[at + 66]:
            entries.append((directory[at : at + max(0, n - 2)].decode("utf-16-le", "replace"), *struct.unpack_from("<IQ", directory, at + 116)))
    found = next((e for name in ("Workbook", "Book") for e in entries if e[0] == name), None)
    if found is None:
        raise ValueError("no workbook stream")
    _, start, length = found
    length &= 0xFFFFFFFF
    if length >= cutoff:
        return chain(start, fat, sector)[:length]
    mini = chain(entries[0][1], fat, sector)
    table = list(words(chain(mini_start, fat, sector)))
    return chain(start, table, lambda n: mini[n * mini_size : (n + 1) * mini_size])[:length]


def records(stream: bytes, at: int = 0):
    """(id, body, continuation bodies) from ``at`` to the end of the substream."""
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        body, at = stream[at + 4 : at + 4 + n], at + 4 + n
        more = []
        while at + 4 <= len(stream) and (nxt := struct.unpack_from("<HH", stream, at))[0] == 0x3C:
            more.append(stream[at + 4 : at + 4 + nxt[1]])
            at += 4 + nxt[1]
        yield kind, body, more
        if kind == 0x0A:
            return


def _text(b: bytes, at: int, n: int) -> str:
    wide = b[at] & 1
    return b[at + 1 : at + 1 + (n << wide)].decode("utf-16-le" if wide else "latin-1", "replace")


def shared_strings(body: bytes, more: list[bytes]) -> list[str]:
    """Strings of the shared table; a string that goes on in the next record states its width again there."""
    parts, k, at = [body, *more], 0, 8
    count, out = struct.unpack_from("<I", body, 4)[0], []

    def take(n: int) -> bytes:
        nonlocal k, at
        got = b""
        while len(got) < n:
            if at >= len(parts[k]):
                k, at = k + 1, 0
            step = parts[k][at : at + n - len(got)]
            got, at = got + step, at + len(step)
        return got

    for _ in range(count):
        n, flags = struct.unpack("<HB", take(3))
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        text, wide = "", flags & 1
        while n:
            if at >= len(parts[k]):
                k, at = k + 1, 1
                wide = parts[k][0] & 1
            fit = min(n, (len(parts[k]) - at) >> wide)
            text += parts[k][at : at + (fit << wide)].decode("utf-16-le" if wide else "latin-1", "replace")
            at, n = at + (fit << wide), n - fit
        take(4 * runs + extra)
        out.append(text)
    return out


def rk_number(rk: int) -> float:
    """A packed number: 30 bits of an integer or of a double's top, divided by 100 if so marked."""
    x = float((rk - (1 << 32) if rk & 0x80000000 else rk) >> 2) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & 0xFFFFFFFC) << 32))[0]
    return x / 100 if rk & 1 else x


def xls_grids(data: bytes):
    """(sheet, grid) of the worksheets, hidden ones too."""
    stream = workbook_stream(data)
    sheets, strings, formats, styles, base_1904 = [], [], {}, [], False
    for kind, body, more in records(stream):
        if kind == 0x2F:
            raise ValueError("the workbook is encrypted")
        if kind == 0x85 and body[5] == 0:
            sheets.append((_text(body, 7, body[6]), struct.unpack_from("<I", body)[0]))
        elif kind == 0xFC:
            strings = shared_strings(body, more)
        elif kind == 0x041E:
            i, n = struct.unpack_from("<HH", body)
            formats[i] = _text(body, 4, n)
        elif kind == 0xE0:
            styles.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == 0x22:
            base_1904 = body[0] == 1
    dates = {i for i, f in enumerate(styles) if (is_date_format(formats[f]) if f in formats else f in DATE_FORMATS)}
    for name, at in sheets:
        yield name, _sheet(stream, at, strings, dates, base_1904)


def _sheet(stream: bytes, at: int, strings: list[str], dates: set[int], base_1904: bool) -> list[list]:
    grid: list[list] = []
    ranges, pending = [], None
    number = lambda x, xf: date_text(x, base_1904) if xf in dates else number_text(x)
    for kind, body, _ in records(stream, at):
        if kind == 0xE5:
            ranges += [struct.unpack_from("<4H", body, 2 + 8 * i) for i in range(struct.unpack_from("<H", body)[0])]
        elif kind == 0xBD:
            row, col = struct.unpack_from("<HH", body)
            for i in range((len(body) - 6) // 6):
                xf, rk = struct.unpack_from("<HI", body, 4 + 6 * i)
                put(grid, row, col + i, number(rk_number(rk), xf))
        elif kind == 0x0207 and pending:
            put(grid, *pending, _text(body, 2, struct.unpack_from("<H", body)[0]) or None)
            pending = None
        elif kind in (0x0203, 0x027E, 0xFD, 0x0204, 0x0205, 0x0006):
            row, col, xf = struct.unpack_from("<3H", body)
            value = None
            if kind == 0x0203:
                value = number(struct.unpack_from("<d", body, 6)[0], xf)
            elif kind == 0x027E:
                value = number(rk_number(struct.unpack_from("<I", body, 6)[0]), xf)
            elif kind == 0xFD:
                value = strings[struct.unpack_from("<I", body, 6)[0]] or None
            elif kind == 0x0204:
                value = _text(body, 8, struct.unpack_from("<H", body, 6)[0]) or None
            elif kind == 0x0205:
                value = ERROR_CODES.get(body[6], ERROR_TEXT) if body[7] else bool_text(bool(body[6]))
            elif body[12:14] != b"\xff\xff":
                value = number(struct.unpack_from("<d", body, 6)[0], xf)
            elif body[6] == 0:
                pending = (row, col)
            elif body[6] < 3:
                value = bool_text(bool(body[8])) if body[6] == 1 else ERROR_CODES.get(body[8], ERROR_TEXT)
            put(grid, row, col, value)
    fill_merged(grid, ranges)
    return grid
