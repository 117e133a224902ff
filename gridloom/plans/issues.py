"""The issue log: rows found on the driver and rows found in the data, one fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns and severities.
COLUMNS = ("严重程度", "文件", "Sheet", "行号", "列名", "问题类型", "原始值", "说明")
ERROR, WARNING, INFO = "错误", "警告", "提示"
SCHEMA = ", ".join(f"`{c}` {'int' if c == '行号' else 'string'}" for c in COLUMNS)


def in_order(log: DataFrame) -> DataFrame:
    rank = F.expr(f"array_position(array('{ERROR}', '{WARNING}', '{INFO}'), `严重程度`)")
    return log.orderBy(rank, "文件", "Sheet", F.coalesce("行号", F.lit(-1)), "列名")


class Issues:
    def __init__(self):
        self.rows: list[tuple] = []
        self.frames: list[DataFrame] = []

    def add(self, severity: str, file: str = "", sheet: str = "", row: int | None = None, column: str = "", kind: str = "", value: str | None = None, message: str = "") -> None:
        self.rows.append((severity, file, sheet, row, column, kind, value, message))

    def add_frame(self, df: DataFrame) -> None:
        """A frame with the issue columns, evaluated only when the log is read."""
        self.frames.append(df.select(*(F.col(c).cast("int" if c == "行号" else "string").alias(c) for c in COLUMNS)))

    def frame(self, spark: SparkSession, ordered: bool = True) -> DataFrame:
        out = spark.createDataFrame(self.rows, SCHEMA)
        for f in self.frames:
            out = out.unionByName(f)
        return in_order(out) if ordered else out

    def counts(self, spark: SparkSession) -> DataFrame:
        return self.frame(spark, False).groupBy("严重程度").agg(F.count(F.lit(1)).alias("n"))
