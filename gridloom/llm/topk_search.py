"""Exact top-k inner-product search by columnar branch and bound.

Candidates lie dimension-major in blocks of bounded size. Scores accumulate
one block of dimensions at a time; after each, a candidate whose partial score
plus the largest possible rest (product of the remaining norms) cannot reach
the k-th best guaranteed score is dropped and the survivors are compacted. A
first block of candidates gives every query a score that k candidates reach;
all other blocks begin with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.sparkkit import blocks_for, shuffle_partitions

CANDIDATES_PER_BLOCK = 1 << 12
QUERIES_PER_BLOCK = 1 << 12
DIMS_PER_STEP = 16
OUT_SCHEMA = "query_id long, vec_id long, score long"


def quantise(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 * x) of each component. Rows with a null id, a null vector or null or non-finite components take no part, nor do vectors with a component of 2**22 or more, whose scores could leave the range of a long."""
    ok = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 4194304D)"
    return vectors.where(ok).selectExpr("vec_id", "transform(embedding, x -> cast(floor(256D * cast(x as double)) as bigint)) AS v")


def _matrix(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """ids, and a dimension-major matrix; shorter vectors are padded with zeros."""
    ids = table.column("vec_id").to_numpy()
    lists = table.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, offs = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets) - (lists.offsets[0].as_py() if len(lists) else 0)
    lens = np.diff(offs)
    out = np.zeros((dims, len(ids)), np.int64)
    col = np.repeat(np.arange(len(ids)), lens)
    out[np.arange(len(flat)) - np.repeat(offs[:-1], lens), col] = flat
    return ids, out


def search_block(q_ids, q, c_ids, c, k: int, step: int = DIMS_PER_STEP, reached=None):
    """Rows (query_id, vec_id, score) of each query's k best in the block; all with ties kept exactly. ``reached``: for each query a score that k candidates are known to reach; lower ones are left out."""
    dims, n = c.shape
    top = max(1, int(np.abs(c).max(initial=0))) * max(1, int(np.abs(q).max(initial=0))) * max(1, dims)
    kind = np.float64 if top < 1 << 53 else object
    cf, qf = c.astype(kind), q.astype(kind)
    edges = [*range(0, dims, step), dims]
    rest_c = [np.sqrt((c[e:].astype(np.float64) ** 2).sum(axis=0)) for e in edges]
    rest_q = [np.sqrt((q[e:].astype(np.float64) ** 2).sum(axis=0)) for e in edges]
    rows = []
    for j in range(q.shape[1]):
        alive = np.flatnonzero(c_ids != q_ids[j])
        score = np.zeros(len(alive), kind)
        for b in range(len(edges) - 1):
            lo, hi = edges[b], edges[b + 1]
            part = cf[lo:hi] if len(alive) == n else cf[lo:hi, alive]
            score = score + qf[lo:hi, j] @ part
            known = -np.inf if reached is None else reached[j]
            if hi == dims or len(alive) <= k and known == -np.inf:
                continue
            bound = rest_c[b + 1][alive] * rest_q[b + 1][j] + 1.0
            low = (score - bound).astype(np.float64)
            floor = max(known, np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf)
            keep = (score + bound).astype(np.float64) >= floor
            alive, score = alive[keep], score[keep]
        order = np.lexsort((c_ids[alive], -score.astype(np.int64)))[:k]
        rows.append((np.full(len(order), q_ids[j]), c_ids[alive][order], score[order].astype(np.int64)))
    return [np.concatenate(x) for x in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 3


def top_k(vectors: DataFrame, query_filter: str, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k best partners of every row that meets ``query_filter``.

    Every other row is a candidate. Repeated query ids count once (their
    smallest vector); repeated candidate rows count each. Queries are blocked
    against candidate blocks, so neither side has to fit in one task.
    """
    v = quantise(vectors)
    n, dims = v.agg(F.count("*"), F.max(F.size("v"))).first()
    queries = v.where(query_filter).groupBy("vec_id").agg(F.min("v").alias("v")).selectExpr("vec_id + 0L AS vec_id", "v")
    n_c, n_q = max(shuffle_partitions(vectors.sparkSession), blocks_for(n, CANDIDATES_PER_BLOCK)), blocks_for(queries.count(), QUERIES_PER_BLOCK)
    dims = max(0, dims or 0)
    left = v.selectExpr("vec_id", "v", f"pmod(xxhash64(vec_id, v), {n_c}) AS cb").selectExpr("*", f"explode(sequence(0L, {n_q - 1}L)) AS qb")
    right = queries.selectExpr("vec_id", "v", f"pmod(xxhash64(vec_id), {n_q}) AS qb")

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        if c.num_rows and q.num_rows:
            ids, m = _matrix(c, dims)
            q_ids, qm = _matrix(q, dims)
            found = search_block(q_ids, qm, ids, m, k, reached=q.column("reached").to_numpy())
        else:
            found = [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    def search(c: DataFrame, q: DataFrame) -> DataFrame:
        return c.groupBy("cb", "qb").cogroup(q.groupBy("cb", "qb")).applyInArrow(run, OUT_SCHEMA)

    first = search(left.where("cb = 0"), right.selectExpr("*", "double('-Infinity') AS reached", "explode(array(0L)) AS cb"))
    reached = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("m")).where(f"m = {k}").select("query_id", "least")
    known = right.join(reached, F.expr("vec_id = query_id"), "left").selectExpr("vec_id + 0L AS vec_id", "v", "qb", "coalesce(cast(least as double), double('-Infinity')) AS reached")
    part = search(left, known.selectExpr("*", f"explode(sequence(0L, {n_c - 1}L)) AS cb"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
