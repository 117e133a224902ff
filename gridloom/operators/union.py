"""UNION ALL of differently headed frames under their canonical names; missing columns are NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.schema import AliasStore, column_order, resolve, suggest_for_columns


def union_mapped(frames: list[DataFrame], store: AliasStore, overrides: dict[str, str] | None = None, accept_pending: bool = True, keep_unmatched: bool = True) -> DataFrame:
    named = []
    for df in frames:
        targets = resolve(suggest_for_columns(df.columns, store, overrides)[0], accept_pending, keep_unmatched)
        named.append(df.select(*(F.col(f"`{c}`").alias(t) for c, t in zip(df.columns, targets) if t)))
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select(*(f"`{c}`" for c in column_order([c for df in named for c in df.columns], store)))
