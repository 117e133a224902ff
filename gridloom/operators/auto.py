"""The automatic summary: a plan from column roles, then one row for each key."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.natural import sort_columns
from gridloom.operators.aggregate import COUNT, ITEM, TOTAL, agg_column_name, aggregate_column, grouped, is_numeric, key_label, normalized_key

# Words by which a header is a rate, and words that overrule them.
RATE_WORDS = ("价", "率", "%", "％", "占比", "比例")
AMOUNT_WORDS = ("金额", "总价", "价税", "价值", "价款", "合计", "总额")


def looks_like_rate(header: str) -> bool:
    return any(w in header for w in RATE_WORDS) and not any(w in header for w in AMOUNT_WORDS)


@dataclass
class AutoPlan:
    key: str | None = None
    names: list[str] = field(default_factory=list)
    entities: list[str] = field(default_factory=list)
    measures: list[tuple[str, str]] = field(default_factory=list)

    def describe(self) -> str:
        if self.key is None:
            return "不分组，只出总计"
        bits = [f"按“{self.key}”汇总"]
        bits += [f"带出{'、'.join(self.names)}"] if self.names else []
        bits += ["统计" + "、".join(f"出现{e}数" for e in self.entities)] if self.entities else []
        bits += ["合计" + "、".join(c for c, _ in self.measures)] if self.measures else []
        return "，".join(bits)


def make_plan(df: DataFrame, roles: dict[str, str], types: dict[str, str], aggs: list[tuple[str, str]] = (), sources: dict[str, list[str]] | None = None) -> AutoPlan:
    """Choose key, names, entities and measures; one job counts what each column holds."""
    columns = [c for c in df.columns if c in types or c in roles]
    kinds, sources = dict(df.dtypes), sources or {}
    stats = df.agg(*(x for i, c in enumerate(columns) for x in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), (F.count(F.col(f"`{c}`").try_cast("double")) if kinds[c] == "string" else F.count(F.col(f"`{c}`"))).alias(f"d{i}")))).first()
    present = [c for i, c in enumerate(columns) if stats[f"n{i}"]]
    all_numbers = {c for i, c in enumerate(columns) if stats[f"n{i}"] and stats[f"n{i}"] == stats[f"d{i}"] and (kinds[c] == "string" or is_numeric(kinds[c]))}
    by_role = lambda r: [c for c in present if roles.get(c) == r]
    coded = by_role("key") or [c for c in present if types.get(c) == "code"]
    names, entities = by_role("name"), by_role("entity")
    key = (coded or names or entities or [None])[0]
    names = [n for n in names if n != key] if coded else []
    entities = [e for e in entities if e != key]
    if aggs:
        return AutoPlan(key, names, entities, list(aggs))
    taken = {key, *names, *entities}
    rate = lambda c: roles.get(c) == "rate" or (not roles.get(c) and any(looks_like_rate(h) for h in [c, *sources.get(c, [])]))
    numbers = [c for c in present if c not in taken and not rate(c) and (types.get(c) == "number" or (types.get(c, "auto") == "auto" and c in all_numbers))]
    return AutoPlan(key, names, entities, [(c, "求和") for c in numbers])


def summarize_auto(df: DataFrame, plan: AutoPlan, order: list[str]) -> DataFrame:
    """Key, the most frequent spelling of each name (first seen wins ties), distinct entities, measures; total row last."""
    kinds = dict(df.dtypes)
    title = lambda c, f: c if f == "求和" else agg_column_name(c, f)
    measures = [aggregate_column(df, c, f).alias(title(c, f)) for c, f in plan.measures if c in df.columns]
    names = [title(c, f) for c, f in plan.measures if c in df.columns]
    if plan.key is None:
        return df.agg(*measures, F.count(F.lit(1)).alias(COUNT)).select(F.lit(TOTAL).alias(ITEM), *(f"`{n}`" for n in names), COUNT)
    counts = [F.count_distinct(normalized_key(F.col(f"`{e}`"), kinds[e])).alias(f"出现{e}数") for e in plan.entities]
    base = grouped(df, [plan.key], [*counts, *measures, F.count(F.lit(1)).alias("_rows")])
    place = F.struct(*(F.col(f"`{o}`") for o in order))
    for i, name in enumerate(plan.names):
        votes = df.where(F.col(f"`{name}`").isNotNull()).groupBy(normalized_key(F.col(f"`{plan.key}`"), kinds[plan.key]).alias("_k"), F.col(f"`{name}`").alias("_v")).agg((-F.count(F.lit(1))).alias("_c"), F.min(place).alias("_p"))
        best = votes.groupBy("_k").agg(F.min_by("_v", F.struct("_c", "_p")).alias(f"_name{i}"))
        base = base.join(best, base[plan.key].eqNullSafe(best["_k"]) & (base["_total"] == 0), "left").drop("_k")
    label = F.when(F.col("_total") == 1, TOTAL).otherwise(key_label(F.col(f"`{plan.key}`"), kinds[plan.key]))
    base = base.orderBy("_total", *sort_columns(plan.key, kinds[plan.key]))
    return base.select(label.alias(plan.key), *(F.col(f"_name{i}").alias(n) for i, n in enumerate(plan.names)), *(f"`出现{e}数`" for e in plan.entities), *(f"`{n}`" for n in names))
