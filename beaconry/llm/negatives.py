"""Operator 12: hard-negative mining by a secondary-sort shuffle.

Anchors are a stated set of rows. They and all rows are cut into blocks; a block of
anchors meets a block of rows as one matrix product of whole numbers. Two passes:

1. Each meeting yields the anchor's first rows of its own label; the first of all
   meetings are its positives, and every positive's score opens a window of scores.
2. Each meeting yields the first rows of other labels inside each window. Nothing
   beyond these can be among the first of the whole table, so a meeting sends a
   bounded number of pairs an anchor, not a row's pair with every anchor.

The pairs, positives included, are packed into byte keys (anchor, falling score,
kind, id) whose byte order is their sort order, dealt by anchor with
repartitionAndSortWithinPartitions, and read as one stream: a positive opens its
window, the negatives that follow are emitted into every open window, and a full
or passed window closes. A task holds the windows of one anchor, never its pairs.

Defined results: rows with a null vec_id, label or vector, or with a null or
non-finite component take no part; vectors of different lengths are not compared;
repeated rows and repeated ids are rows of their own (ties by id, then by label
and vector); a positive score below 0 has no negatives; a score beyond 64 bits is
an error; an empty table gives an empty table. Only vec_id, embedding and label
are read.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beaconry.llm.common import cut, map_groups, map_rows, table

POSITIVES = 5
NEGATIVES = 5
#: Scores of negatives from SHARE percent of the positive's score up to all of it.
SHARE = 80
SCALE = 256
#: Rows and anchors of a block, and anchors scored at once (TILE * ROWS scores are held).
ROWS = 8192
ANCHORS = 4096
TILE = 128

_SIGN = 1 << 63


def pack(anchor: tuple[int, int], score: int, negative: bool, row: tuple[int, int]) -> bytes:
    """Key whose byte order is: anchor, falling score, positives before negatives, row."""
    return struct.pack(">QIQBQI", anchor[0] + _SIGN, anchor[1], _SIGN - 1 - score, negative, row[0] + _SIGN, row[1])


def unpack(key: bytes) -> tuple[tuple[int, int], int, bool, tuple[int, int]]:
    a, a_copy, score, negative, r, r_copy = struct.unpack(">QIQBQI", key)
    return (a - _SIGN, a_copy), _SIGN - 1 - score, bool(negative), (r - _SIGN, r_copy)


def _whole(rows: dict) -> dict:
    """Components as whole numbers in the narrowest width that holds them; rows that take no part are left out."""
    out: dict[str, list] = {"id": [], "label": [], "vec": [], "dims": [], "width": []}
    for id_, label, vector in zip(rows["vec_id"], rows["label"], rows["embedding"]):
        if id_ is None or label is None or vector is None or None in vector:
            continue
        values = np.array(vector, np.float64)
        if not np.isfinite(values).all():
            continue
        values = np.floor(SCALE * values)
        top = float(np.abs(values).max(initial=0))
        if top >= float(1 << 62):
            raise OverflowError(f"vec_id {id_}: components beyond 64 bits")
        width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
        for name, value in zip(out, (id_, label, values.astype(f"<i{width}").tobytes(), len(values), width)):
            out[name].append(value)
    return out


def _matrix(blobs: list[bytes], widths: list[int], dims: int) -> np.ndarray:
    made = np.zeros((len(blobs), dims), np.int64)
    width = np.array(widths)
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        made[which] = np.frombuffer(b"".join(blobs[i] for i in which), f"<i{w}").reshape(len(which), dims)
    return made


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where these hold every partial sum, else in 64 bits, else in Python's integers."""
    bound = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if bound < 1 << 53:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return x @ y.T
    exact = x.astype(object) @ y.T.astype(object)
    if max(abs(v) for v in exact.ravel()) >= 1 << 63:
        raise OverflowError("a score is beyond 64 bits")
    return exact.astype(np.int64)


def _meetings(group: pa.Table):
    """(anchor columns, row columns, scores of some anchors) of one meeting of blocks, rows in order of id."""
    columns = {name: group.column(name).to_pylist() for name in group.column_names}
    ask = np.array(columns["ask"], bool)
    if not ask.any() or ask.all():
        return
    dims = columns["dims"][0]
    place = np.flatnonzero(~ask)
    ids, copies = np.array(columns["id"], np.int64), np.array(columns["copy"], np.int64)
    place = place[np.lexsort((copies[place], ids[place]))]
    anchors = np.flatnonzero(ask)
    labels = np.array(columns["label"], np.int64)
    rows = _matrix([columns["vec"][i] for i in place], [columns["width"][i] for i in place], dims)
    asks = _matrix([columns["vec"][i] for i in anchors], [columns["width"][i] for i in anchors], dims)
    for at in range(0, len(anchors), TILE):
        score = products(asks[at : at + TILE], rows)
        for i, a in enumerate(anchors[at : at + TILE]):
            same = labels[place] == labels[a]
            own = (ids[place] == ids[a]) & (copies[place] == copies[a])
            yield columns, a, place, score[i], same, own


def _first(score: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """The first n of ``which``, a selection of rows in order of id, by falling score."""
    if len(which) > n:
        own = score[which]
        which = which[own >= np.partition(own, len(which) - n)[len(which) - n]]
    return which[np.argsort(-score[which], kind="stable")][:n]


def _positives(n: int):
    def each(group: pa.Table) -> dict | None:
        out: dict[str, list] = {"id": [], "copy": [], "score": [], "other": [], "other_copy": []}
        for columns, a, place, score, same, own in _meetings(group):
            best = _first(score, np.flatnonzero(same & ~own), n)
            out["id"] += [columns["id"][a]] * len(best)
            out["copy"] += [columns["copy"][a]] * len(best)
            out["score"] += score[best].tolist()
            out["other"] += [columns["id"][i] for i in place[best]]
            out["other_copy"] += [columns["copy"][i] for i in place[best]]
        return out if out["id"] else None

    return each


def _negatives(n: int, share: int):
    def each(group: pa.Table) -> dict | None:
        keys = []
        for columns, a, place, score, same, _ in _meetings(group):
            found: set[int] = set()
            for top in set(columns["windows"][a]):
                # 100 * score >= share * top without a product beyond 64 bits
                found.update(_first(score, np.flatnonzero(~same & (score <= top) & (score >= -(-share * top // 100))), n).tolist() if top >= 0 else [])
            anchor = (columns["id"][a], columns["copy"][a])
            keys += [pack(anchor, int(score[i]), True, (columns["id"][place[i]], columns["copy"][place[i]])) for i in found]
        return {"key": keys} if keys else None

    return each


def windows(keys: Iterator[bytes], n: int = NEGATIVES, share: int = SHARE) -> Iterator[tuple]:
    """Streams sorted keys; yields (anchor, positive, rank, negative, positive score, negative score)."""
    anchor, opened = None, []
    for key in keys:
        own, score, negative, row = unpack(key)
        if own != anchor:
            anchor, opened = own, []
        if not negative:
            opened.append([row[0], score, 0])
            continue
        opened = [w for w in opened if w[2] < n and 100 * score >= share * w[1]]
        for window in opened:
            window[2] += 1
            yield anchor[0], window[0], window[2], row[0], window[1], score


def _blocks(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Every block of anchors beside every block of rows: columns dims, _a, _r, ask and the rest."""
    by_hash = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id", "copy"), F.lit(n)).cast("int")
    n_r, n_a = max(1, -(-n_rows // ROWS)), max(1, -(-n_anchors // ANCHORS))
    asked = anchors.select("*", F.lit(True).alias("ask"), by_hash("a", n_a).alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))).alias("_r"))
    told = rows.select("*", F.lit(False).alias("ask"), F.explode(F.sequence(F.lit(0), F.lit(n_a - 1))).alias("_a"), by_hash("r", n_r).alias("_r"))
    return asked.unionByName(told, allowMissingColumns=True)


def mine(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = SHARE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    ``anchors`` is a condition on the column id; labels are whole numbers."""
    spark = vectors.sparkSession
    told = map_rows(
        vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding"),
        "id long, label long, vec binary, dims int, width int", _whole, rows=4096,
    )
    # repeated ids are told apart by a number of their own
    rows = cut(told.withColumn("copy", F.row_number().over(W.partitionBy("id").orderBy("label", "dims", "vec"))))
    asked = rows.where(anchors)
    n_rows, n_anchors = rows.count(), asked.count()
    meeting = ["dims", "_a", "_r"]
    near = map_groups(
        _blocks(rows, asked, n_rows, n_anchors), meeting, "id long, copy int, score long, other long, other_copy int", _positives(positives),
    )
    first = W.partitionBy("id", "copy").orderBy(F.desc("score"), "other", "other_copy")
    chosen = cut(near.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= positives).drop("_n"))
    opened = asked.join(chosen.groupBy("id", "copy").agg(F.collect_list("score").alias("windows")), ["id", "copy"])
    far = map_groups(_blocks(rows, opened, n_rows, n_anchors), meeting, "key binary", _negatives(negatives, share))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = chosen.rdd.map(lambda r: (pack((r.id, r.copy), r.score, False, (r.other, r.other_copy)), None)).union(
        far.rdd.map(lambda r: (bytes(r.key), None))
    )
    sorted_keys = keys.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:12]))
    found = sorted_keys.mapPartitions(lambda pairs: windows((key for key, _ in pairs), negatives, share))
    return spark.createDataFrame(
        found, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are ids divisible by 100; labels of ids divisible by 7 are moved on by one first."""
    label = F.expr("if(vec_id % 7 = 0, (cast(label as long) + 1) % 10, cast(label as long))")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return mine(vectors, F.col("id") % 100 == 0)


ORACLE = f"""
with good as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
    list_transform(embedding, lambda x: floor({SCALE} * x::double)) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.r as anchor, a.vec_id as anchor_id, b.r as other, b.vec_id as other_id, a.label = b.label as same,
    list_inner_product(a.e, b.e)::bigint as score
  from good a join good b on a.r <> b.r and len(a.e) = len(b.e) where a.vec_id % 100 = 0),
positive as (
  select * from (select *, row_number() over (partition by anchor order by score desc, other_id, other) as n from pairs where same) where n <= {POSITIVES}),
ranked as (
  select p.anchor_id, p.other_id as positive_id, row_number() over (partition by p.anchor, p.n order by q.score desc, q.other_id, q.other) as rank,
    q.other_id as negative_id, p.score as positive_score, q.score as negative_score
  from positive p join pairs q on p.anchor = q.anchor and not q.same
    and {SHARE} * p.score <= 100 * q.score and 100 * q.score <= 100 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from ranked where rank <= {NEGATIVES}
"""
