"""Duplicate rows: mark with the first one's place, or drop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.aggregate import normalized_key

# Lineage columns.
LINEAGE = ("来源文件", "来源Sheet", "原始行号")
MODES = ("off", "mark", "drop")


def key_columns(df: DataFrame, keys: list[str], order: list[str], issues=None) -> list[str]:
    """The given keys that exist, else all business columns."""
    for k in keys:
        if k not in df.columns and issues is not None:
            issues.add("警告", kind="汇总设置", column=k, message=f"去重列“{k}”不存在，已忽略")
    return [k for k in keys if k in df.columns] or [c for c in df.columns if c not in LINEAGE and c not in order]


def deduplicate(df: DataFrame, mode: str, keys: list[str], order: list[str], issues=None) -> DataFrame:
    """``mark``: every row plus is_duplicate and first_place (struct of the order columns of the first row with its key). ``drop``: first rows only.

    NULL equals NULL; ``order`` must order rows totally. The first row of each
    key is an aggregate that combines before the shuffle, so a key that holds
    many rows costs one row a task; nothing gathers a key's rows.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "off":
        return df
    kinds = dict(df.dtypes)
    keys = key_columns(df, keys, order, issues)
    norm = [normalized_key(F.col(f"`{k}`"), kinds[k]).alias(f"_k{i}") for i, k in enumerate(keys)]
    place = F.struct(*(F.col(f"`{o}`") for o in order))
    if mode == "drop":
        others = [c for c in df.columns if c not in order]
        first = df.groupBy(*norm).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in others)), place).alias("_row"), F.min(place).alias("_place")) if others else df.groupBy(*norm).agg(F.min(place).alias("_place"))
        return first.select(*(F.col(f"_place.`{c}`") if c in order else F.col(f"_row.`{c}`") for c in df.columns))
    keyed = df.withColumns({f"_k{i}": n for i, n in enumerate(norm)})
    first = df.groupBy(*norm).agg(F.min(place).alias("first_place"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    first = first.select(*(F.col(f"_k{i}").alias(f"_f{i}") for i in range(len(keys))), "first_place")
    on = reduce(lambda a, b: a & b, [F.col(f"_k{i}").eqNullSafe(F.col(f"_f{i}")) for i in range(len(keys))])
    marked = keyed.join(first, on, "left").withColumn("is_duplicate", F.coalesce(F.col("first_place") != place, F.lit(False)))
    return marked.select(*(f"`{c}`" for c in df.columns), "is_duplicate", F.when(F.col("is_duplicate"), F.col("first_place")).alias("first_place"))
