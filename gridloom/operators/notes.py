"""What the details lack: columns of single sheets, values of measures, whole measures."""

from __future__ import annotations

from collections.abc import Hashable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_columns(sheets: dict[Hashable, set[str]], with_rows: set[Hashable], standard: list[str]) -> dict[Hashable, list[str]]:
    """By sheet, the standard columns it lacks of those that more than half of the sheets with rows have."""
    have = [own for k, own in sheets.items() if k in with_rows]
    common = [c for c in standard if 2 * sum(c in own for own in have) > len(have)]
    return {k: gone for k, own in sheets.items() if (gone := [c for c in common if c not in own])}


def count_cells(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """``by``, column, n: in how many rows each flag holds, where it holds at all; one aggregation for all flags."""
    counts = [F.count_if(flag).alias(f"_n{i}") for i, flag in enumerate(flags.values())]
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n")) for i, c in enumerate(flags)))
    return df.groupBy(*(f"`{b}`" for b in by)).agg(*counts).select(*(f"`{b}`" for b in by), F.inline(each)).where("n > 0")


def empty_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Which of ``columns`` hold nothing although there are rows; one job."""
    columns = [c for c in dict.fromkeys(columns) if c in df.columns]
    if not columns:
        return []
    r = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns))).first()
    return [c for i, c in enumerate(columns) if r["rows"] and not r[f"n{i}"]]
