"""Operator 8: embedding near-duplicates by an exact metric range join.

On unit vectors a cosine of at least c means a distance of at most
r = sqrt(2 - 2c). Pivots drawn from the data partition the vectors: each vector's
home is the cell of its nearest pivot. A vector y can have a partner whose home is
cell i only if it lies no further than r beyond the border between its own cell h
and cell i; the triangle inequality gives d(y, i) - d(y, h) <= 2 r, and on the
sphere the sharper form d(y, i)^2 - d(y, h)^2 <= 2 r d(i, h). y is replicated to
just these cells. Cells then join independently: each home vector meets its home
cell's residents and guests, so its number of links comes from one cell alone.
Cells are cut into blocks, which meet as matrix products in double precision;
tasks return counts and a spanning set of links, never pairs.

Equal vectors are one class from the start. Defined results: null labels, null or
zero vectors and vectors with null or non-finite components link with nothing and
are kept; vectors of different lengths do not link; repeated rows are vectors of
their own (n_links counts them); an empty table gives an empty table. Only vec_id,
embedding and label are read.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm.common import components, cut, group_labels, map_groups, map_rows, table

COSINE = 0.98
#: One pivot for so many distinct vectors, at most PIVOTS of them (they are sent to every task: PIVOTS * dimensions * 8 bytes).
PER_PIVOT = 4096
PIVOTS = 1024
BLOCK = 512


def _read(dtype: str):
    def each(rows: dict) -> dict:
        keys, vectors, sizes = [], [], []
        for vector, label in zip(rows["embedding"], rows["label"]):
            key = data = None
            if vector and label is not None and None not in vector:
                values = np.array(vector, np.float64)
                if np.isfinite(values).all() and values.any():
                    data = values.astype(dtype).tobytes()
                    key = hashlib.blake2b(data, digest_size=16).digest()
            keys.append(key)
            vectors.append(data)
            sizes.append(len(vector) if data else None)
        return {"vec_id": rows["vec_id"], "label": rows["label"], "key": keys, "vec": vectors, "dims": sizes}

    return each


def _units(blobs: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(pivots: dict[int, np.ndarray], dtype: str, radius: float):
    """Home and guest cells of each vector."""
    between = {d: np.sqrt(np.maximum(0, 2 - 2 * p @ p.T)) for d, p in pivots.items()}

    def each(rows: dict) -> dict:
        out: dict[str, list] = {"rep": [], "n": [], "label": [], "vec": [], "cell": [], "home": []}

        def put(i: int, cell: int, home: bool) -> None:
            for name in ("rep", "n", "label", "vec"):
                out[name].append(rows[name][i])
            out["cell"].append(cell)
            out["home"].append(home)

        dims = np.array(rows["dims"])
        for d in np.unique(dims):
            which = np.flatnonzero(dims == d)
            if int(d) not in pivots:
                for i in which:
                    put(i, -int(d), True)
                continue
            p = pivots[int(d)]
            far = 2 - 2 * _units([rows["vec"][i] for i in which], dtype) @ p.T
            home = far.argmin(axis=1)
            near = far - far[np.arange(len(which)), home][:, None] <= 2 * radius * between[int(d)][home] + 1e-9
            near[np.arange(len(which)), home] = True
            for row, cell in zip(*np.nonzero(near)):
                put(which[row], int(d) << 20 | int(cell), bool(home[row] == cell))
        return out

    return each


def _joined(dtype: str, cosine: float):
    def each(group: pa.Table) -> dict | None:
        ask = np.array(group.column("ask").to_pylist(), bool)
        ids = np.array(group.column("rep").to_pylist(), np.int64)
        weight = np.array(group.column("n").to_pylist(), np.int64)
        if not ask.any() or ask.all():
            return None
        units = _units(group.column("vec").to_pylist(), dtype)
        x, y = np.flatnonzero(ask), np.flatnonzero(~ask)
        hit = (units[x] @ units[y].T >= cosine) & (ids[x][:, None] != ids[y][None, :])
        links = (hit * weight[y][None, :]).sum(axis=1)
        some = np.flatnonzero(links)
        if not len(some):
            return None
        names, place = np.unique(ids, return_inverse=True)
        a, b = np.nonzero(hit)
        label = group_labels(len(names), place[x][a], place[y][b])
        moved = np.flatnonzero(label != np.arange(len(names)))
        return {
            "rep": ids[x][some].tolist() + names[moved].tolist(),
            "links": links[some].tolist() + [0] * len(moved),
            "b": [None] * len(some) + names[label[moved]].tolist(),
        }

    return each


def range_join(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    dtype = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    radius = math.sqrt(2 - 2 * cosine)
    told = cut(map_rows(
        vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("string")),
        "vec_id long, label string, key binary, vec binary, dims int", _read(dtype), rows=2048,
    ))
    classes = cut(told.where("key is not null and vec_id is not null").groupBy("label", "key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"), F.first("dims").alias("dims")
    ))
    count = classes.count()
    drawn = classes.orderBy(F.xxhash64("rep"), "rep").limit(min(PIVOTS, math.ceil(count / PER_PIVOT))).select("dims", "vec").collect()
    pivots = {d: _units([r.vec for r in drawn if r.dims == d], dtype) for d in {r.dims for r in drawn}}
    placed = cut(map_rows(classes, "rep long, n long, label string, vec binary, cell long, home boolean", _cells(pivots, dtype, radius), rows=2048))
    key = ["label", "cell"]
    sizes = placed.groupBy(*key).agg(
        F.ceil(F.count_if("home") / BLOCK).cast("int").alias("_asks"), F.ceil(F.count("*") / BLOCK).cast("int").alias("_all"), F.count("*").alias("_n")
    ).where("_asks > 0 and _n > 1").drop("_n")
    block = F.xxhash64(F.lit("block"), "rep")
    dealt = placed.join(sizes, key)
    asks = dealt.where("home").select(*key, F.pmod(block, F.col("_asks")).cast("int").alias("_i"), F.explode(F.expr("sequence(0, _all - 1)")).alias("_j"),
                                      "rep", "n", "vec", F.lit(True).alias("ask"))
    told_to = dealt.select(*key, F.explode(F.expr("sequence(0, _asks - 1)")).alias("_i"), F.pmod(block, F.col("_all")).cast("int").alias("_j"),
                           "rep", "n", "vec", F.lit(False).alias("ask"))
    found = cut(map_groups(asks.union(told_to), [*key, "_i", "_j"], "rep long, links long, b long", _joined(dtype, cosine)))
    joined = components(found.where("b is not null").select(F.col("rep").alias("a"), "b"))
    per = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = (
        classes.select("label", "key", "rep", "n").join(per, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    out = told.select("vec_id", "label", "key").join(of_class, ["label", "key"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(table(spark, sf_dir, "embeddings"))


ORACLE = """
with recursive good as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as u, b.vec_id as v from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(u, v) as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u),
low as (select u, min(v) as m from reach group by u),
degree as (select u, count(*) as n from links group by u)
select e.vec_id, coalesce(d.n, 0)::bigint as n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(l.m, e.vec_id)) as kept
from embeddings e left join degree d on e.vec_id = d.u left join low l on e.vec_id = l.u
"""
