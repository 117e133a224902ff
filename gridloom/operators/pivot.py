"""Cross-tabs whose margins are computed from the details, and splits by value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.natural import sort_columns
from gridloom.operators.aggregate import ITEM, TOTAL, aggregate_column, check_aggs, check_groups, grouped, key_label, normalized_key, present, summarize

MARGIN = "合计"
#: A cross-tab has a column for each value; beyond this the value list is an error, never cut.
MAX_COLUMNS = 10_000
MAX_SPLIT_SHEETS = 200


def distinct_values(df: DataFrame, column: str, limit: int) -> list | None:
    """Sorted distinct values with their labels, NULL last; None if there are more than ``limit``."""
    kind = dict(df.dtypes)[column]
    values = df.select(normalized_key(F.col(f"`{column}`"), kind).alias(column)).distinct().limit(limit + 1)
    rows = values.orderBy(*sort_columns(column, kind)).select(column, key_label(F.col(f"`{column}`"), kind).alias("label")).collect()
    return None if len(rows) > limit else [(r[0], r["label"]) for r in rows]


def _unique(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        k, m = 2, n
        while m in out:
            m, k = f"{n}_{k}", k + 1
        out.append(m)
    return out


def pivot_summarize(df: DataFrame, group_by: list[str], pivot: str, aggs: list[tuple[str, str]], issues=None, ordered: bool = True) -> DataFrame:
    """Rows: groups; columns: values of ``pivot`` and 合计; last row 总计. A cell without rows is NULL."""
    if pivot not in df.columns:
        issues is not None and issues.add("错误", kind="汇总设置", column=pivot, message=f"交叉列“{pivot}”不存在，改为普通汇总")
        return summarize(df, group_by, aggs, issues, ordered=ordered)
    values = distinct_values(df, pivot, MAX_COLUMNS)
    if values is None:
        raise ValueError(f"{pivot} has more than {MAX_COLUMNS} values")
    groups = [g for g in check_groups(df, group_by, issues) if g != pivot]
    aggs = check_aggs(df, aggs, issues)
    kind = dict(df.dtypes)[pivot]
    cell = normalized_key(F.col(f"`{pivot}`"), kind)
    flagged = df.withColumns({f"_p{k}": cell.eqNullSafe(F.lit(v)) for k, (v, _) in enumerate(values)})
    columns, labels = [], []
    for k, label in [*((k, x) for k, (_, x) in enumerate(values)), (None, MARGIN)]:
        for c, f in aggs or [(None, None)]:
            labels.append(f"{label}·{c}({f})" if len(aggs) > 1 else label)
            if k is None:
                columns.append(aggregate_column(df, c, f) if c else F.count(F.lit(1)))
            else:
                on = F.col(f"_p{k}")
                measure = aggregate_column(df, c, f, on) if c else F.count_if(on)
                columns.append(F.when(F.count_if(on) > 0, measure))
    labels = _unique(labels)
    out = grouped(flagged, groups, [m.alias(n) for m, n in zip(columns, labels)])
    return present(out, groups, labels, ordered) if groups else out.select(F.lit(TOTAL).alias(ITEM), *(f"`{n}`" for n in labels))


def split_values(df: DataFrame, column: str, issues=None) -> list | None:
    """Values to split into sheets; None (and a warning) for more than MAX_SPLIT_SHEETS or a missing column."""
    if column not in df.columns:
        issues is not None and issues.add("错误", kind="汇总设置", column=column, message=f"拆分列“{column}”不存在")
        return None
    values = distinct_values(df, column, MAX_SPLIT_SHEETS)
    if values is None and issues is not None:
        issues.add("警告", kind="汇总设置", column=column, message=f"拆分列“{column}”超过 {MAX_SPLIT_SHEETS} 个值，不拆分")
    return values

