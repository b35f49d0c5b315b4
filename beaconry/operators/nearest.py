"""Exact nearest vectors in blocks: query blocks meet vector blocks as matrix products.

Queries and vectors are dealt into blocks by a hash of their id; each block of one
side meets each block of the other once, in a task of its own, so there is no cross
join and no side has to fit a broadcast. A meeting keeps each query's best few: by
the product form of the distance with a margin for its rounding, then exactly, as a
sum of squared differences. The best of all meetings are ranked per query.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and vectors of a block; a meeting holds 256 x VECTORS distances at a time.
QUERIES, VECTORS = 4096, 16384
_TILE = 256
_OUT = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])


def best_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, fetch: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, squared distances) of each query's ``fetch`` nearest, ties by id."""
    v_norm = (v * v).sum(axis=1)
    for at in range(0, len(q), _TILE):
        part = q[at : at + _TILE]
        q_norm = (part * part).sum(axis=1)
        rough = q_norm[:, None] + v_norm[None, :] - 2 * part @ v.T
        margin = 1e-12 * max(1, v.shape[1]) * (q_norm[:, None] + v_norm.max(initial=0))[:, 0]
        for i in range(len(part)):
            near = np.arange(len(v))
            if len(v) > fetch:
                near = np.flatnonzero(rough[i] <= np.partition(rough[i], fetch - 1)[fetch - 1] + 2 * margin[i])
            exact = ((part[i][None, :] - v[near]) ** 2).sum(axis=1)
            order = np.lexsort((ids[near], exact))[:fetch]
            yield int(q_ids[at + i]), ids[near][order], exact[order]


def _meeting(fetch: int):
    def run(group: pa.Table) -> pa.Table:
        asked = np.array(group.column("asked").to_pylist(), bool)
        ids = group.column("id").to_numpy()
        vectors = group.column("vector").to_pylist()
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if asked.any() and not asked.all():
            at_q, at_v = np.flatnonzero(asked), np.flatnonzero(~asked)
            q, v = (np.array([vectors[i] for i in at], np.float64) for at in (at_q, at_v))
            out = list(best_of(ids[at_q], q, ids[at_v], v, fetch))
        return pa.table([
            np.concatenate([np.full(len(found), query) for query, found, _ in out] or [np.zeros(0, np.int64)]).astype(np.int64),
            np.concatenate([found for _, found, _ in out] or [np.zeros(0, np.int64)]),
            np.concatenate([far for *_, far in out] or [np.zeros(0)]),
        ], schema=_OUT)

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, where: Column | None = None, metric: str = "sql2",
            query_block: int = QUERIES, vector_block: int = VECTORS) -> DataFrame:
    """query_id, id, rank, similarity 1 / (1 + d) of each query's ``k`` nearest vectors.

    ``queries``: query_id, embedding; ``vectors``: id, embedding and what ``where`` reads: a
    condition on the vectors that may be returned (applied before the search, so k rows
    come back whatever it drops). ``metric``: squared L2, or ``l2``. Null vectors and vectors
    that hold a null or have another length than the query take no part; ids are unique.
    """
    vectors = vectors.where(where) if where is not None else vectors
    whole = lambda df, name: df.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())).select(
        F.col(name).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.size("embedding").alias("dims"))
    asked, told = whole(queries, "query_id"), whole(vectors, "id")
    blocks = lambda df, n: max(1, -(-df.count() // n))
    n_q, n_v = blocks(asked, query_block), blocks(told, vector_block)
    by_hash = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    meetings = asked.select("*", F.lit(True).alias("asked"), by_hash(n_q).alias("_q"), every(n_v).alias("_v")).union(
        told.select("*", F.lit(False), every(n_q), by_hash(n_v))
    )
    found = meetings.groupBy("dims", "_q", "_v").applyInArrow(_meeting(k), "query_id long, id long, distance double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)
    distance = F.sqrt("distance") if metric == "l2" else F.col("distance")
    return ranked.select("query_id", "id", "rank", F.round(1 / (1 + distance), 3).alias("similarity"))
