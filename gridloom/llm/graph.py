"""Connected components over edge tables, all in DataFrame joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.sparkkit import Table


def _forest(batches):
    """A spanning forest of each partition's edges, every vertex linked to the least one it is joined with there; fewer edges go into the shuffles."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > _FOREST:
            yield _edges(parent, find)
            parent.clear()
    if parent:
        yield _edges(parent, find)


_FOREST = 1 << 19


def _edges(parent, find) -> pa.RecordBatch:
    pairs = [(v, r) for v in list(parent) if (r := find(v)) != v]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star (link larger neighbours to the least) or small-star step; edges have a > b."""
    if large:
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b").where("a > b")
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a")
    return linked.selectExpr("a", "m AS b").unionByName(linked.selectExpr("b AS a", "m AS b")).where("a > b").distinct()


#: So many edges, forests of single tasks already, fit in one task of bounded size.
FEW_EDGES = 1 << 14


def components(spark: SparkSession, edges: DataFrame) -> Table:
    """(a, b): every vertex with edges but the least of its component, and that least one. Alternating stars until every vertex has one edge, to a vertex without one: logarithmically many rounds, each a written table. What is left of few edges takes one task."""

    def forests(now: Table, df: DataFrame) -> Table:
        out = Table(spark, df.mapInArrow(_forest, "a long, b long"), "edges")
        now.drop()
        return out

    now = Table(spark, edges.select("a", "b"), "edges")  # stored first: Python that makes the edges would hold a second worker in each of the forests' tasks
    if now.df.count() > FEW_EDGES:
        now = forests(now, now.df)
    if now.df.count() <= FEW_EDGES:
        return forests(now, now.df.coalesce(1))
    while True:
        big = Table(spark, _star(now.df, True), "large-star")
        now.drop()
        now = Table(spark, _star(big.df, False), "small-star")
        big.drop()
        ends = now.df.selectExpr("a AS v", "1L AS up", "0L AS down").unionByName(now.df.selectExpr("b AS v", "0L AS up", "1L AS down"))
        if ends.groupBy("v").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty():
            return now
