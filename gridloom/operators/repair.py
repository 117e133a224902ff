"""Repairs that look across rows: the dominant year, leading zeros of codes, names that contradict their file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns whose value may be a file's own name.
FILE_NAMED = ("门店", "仓库", "部门", "客户", "供应商")


def dominant_year(df: DataFrame, date_column: str, by: list[str], order: list[str]) -> DataFrame:
    """``by`` columns and year: the most frequent year of full dates, first seen on ties."""
    place = F.struct(*(F.col(f"`{o}`") for o in order))
    votes = df.where(F.col(f"`{date_column}`").isNotNull()).groupBy(*by, F.year(f"`{date_column}`").alias("_y")).agg((-F.count(F.lit(1))).alias("_c"), F.min(place).alias("_p"))
    return votes.groupBy(*by).agg(F.min_by("_y", F.struct("_c", "_p")).alias("year"))


def code_width(df: DataFrame, code: str, is_number: str, order: list[str]) -> int | None:
    """The most frequent length of all-digit codes that were text, if any of them begins with 0."""
    text = df.where(f"NOT `{is_number}`").where(F.col(f"`{code}`").rlike("^[0-9]+$"))
    place = F.struct(*(F.col(f"`{o}`") for o in order))
    votes = text.groupBy(F.length(f"`{code}`").alias("w")).agg((-F.count(F.lit(1))).alias("c"), F.min(place).alias("p"), F.max(F.col(f"`{code}`").startswith("0")).alias("z"))
    r = votes.agg(F.min_by("w", F.struct("c", "p")).alias("w"), F.max("z").alias("z")).first()
    return r["w"] if r["z"] else None


def pad_codes(df: DataFrame, code: str, is_number: str, order: list[str]) -> DataFrame:
    """Codes that came as numbers get back their leading zeros; ``padded`` tells which."""
    width = code_width(df, code, is_number, order)
    short = F.lit(False) if width is None else F.col(f"`{is_number}`") & F.col(f"`{code}`").rlike("^[0-9]+$") & (F.length(f"`{code}`") < width)
    return df.withColumn("padded", F.coalesce(short, F.lit(False))).withColumn(code, F.when(F.col("padded"), F.lpad(F.col(f"`{code}`"), width or 1, "0")).otherwise(F.col(f"`{code}`")))


def rename_by_file(df: DataFrame, column: str, stem: str, fix: bool = True) -> DataFrame:
    """Where a file holds one value of ``column`` throughout and that is another file's stem, its own stem replaces it; ``renamed`` tells where.

    The per-file table is one row a file and is broadcast by Spark only if small.
    """
    c = F.col(f"`{column}`")
    files = df.where(c.isNotNull()).groupBy(f"`{stem}`").agg(F.count_distinct(c).alias("_n"), F.min(c).alias("_only"))
    stems = files.select(F.col(f"`{stem}`").alias("_other"))
    wrong = files.where(f"_n = 1 AND _only != `{stem}`").join(stems, F.col("_only") == F.col("_other"), "left_semi").select(F.col(f"`{stem}`").alias("_stem"))
    out = df.join(wrong, F.col(f"`{stem}`") == F.col("_stem"), "left")
    renamed = F.col("_stem").isNotNull() & c.isNotNull()
    return out.withColumn("renamed", renamed).withColumn(column, F.when(F.col("renamed") & F.lit(fix), F.col("_stem")).otherwise(c)).drop("_stem")
