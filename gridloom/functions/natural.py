"""Natural order: digit runs and Chinese numerals compare as numbers, before text; NULL last."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Chinese digits and units.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
_RUN = re.compile(f"([0-9]+|[{''.join(DIGITS)}{''.join(UNITS)}]+)")


def chinese_number(s: str) -> int:
    """Up to thousands; of consecutive digits the last counts; a bare unit means one of it."""
    total, digit = 0, None
    for ch in s:
        if ch in DIGITS:
            digit = DIGITS[ch]
        else:
            total, digit = total + UNITS[ch] * (1 if digit is None else digit), None
    return total + (digit or 0)


def natural_key(text: str) -> str:
    """A string whose plain order is the natural order."""
    out = []
    for k, part in enumerate(_RUN.split(text)):
        if k % 2:
            n = str(int(part) if part[0].isdigit() and part.isascii() else chinese_number(part))
            out.append(f"0{len(n):04d}{n}")
        elif part:
            out.append(f"1{part}\0")
    return "".join(out)


def _keys(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else natural_key(x))


def natural_key_udf(c) -> Column:
    return F.pandas_udf(_keys, "string")(c)


def sort_columns(name: str, kind: str) -> list[Column]:
    """Order-by columns for one key: typed for numbers and dates, natural for text; meant for summaries, not for details."""
    c = F.col(f"`{name}`")
    return [c.isNull().asc(), (natural_key_udf(c) if kind == "string" else c).asc_nulls_last()]
