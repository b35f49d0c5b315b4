"""Operator 7: MinHash near-duplicates by a signature-coordinate inverted join.

Each document's set of word shingles gets a signature of ``COORDINATES`` minima.
Documents are posted under each coordinate-value pair. Coordinates that no other
document shares are skipped; of the m that are left, a pair with at least
``MATCHES`` equal coordinates must meet on one of the m - MATCHES + 1 rarest (the
prefix), so only those postings are merged. Collisions are then counted on the
whole signatures, pairs below the threshold are dropped, and what is left is
confirmed on the full shingle sets.

Groups are never expanded into pairs of rows. Equal sets are one class from the
start. Long posting lists and large candidate groups are cut into blocks; a task
compares two blocks as matrices and returns a spanning set of links. The exact
intersections come from a product of the blocks' shingle incidence matrices.

Defined results: null, empty and white-space texts have an empty set, link with
nothing and are kept; texts with fewer than five words have one shingle, the whole
sequence; rows with a null doc_id keep null ids and are never linked by it;
repeated doc_ids are one document of the class of each of their texts; an empty
table gives an empty table. Only doc_id and text are read.
"""
from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm.common import FILTER_BITS, bit_filter, block_pairs, components, cut, group_labels, map_groups, map_rows, mix64, shingle_hashes, table, text_chunks, word_hashes

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: With 64 coordinates a pair at similarity .85 matches 54.4 on average with deviation 2.9;
#: fewer than 42 matches happen to it about thirty times in a million.
COORDINATES = 64
MATCHES = 42
#: The stage links at .80: 51.2 matches on average with deviation 3.2; fewer than 36 happen to it about four times in a million.
STAGE_PERCENT, STAGE_MATCHES = 80, 36
#: Members in a block: two blocks of signatures or sets are all that a task holds.
BLOCK = 512

U64 = np.uint64
_FACTORS = mix64(np.arange(1, COORDINATES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for part in text_chunks(texts):
        hashes, per = shingle_hashes(*word_hashes(texts[part]), k)
        at = 0
        for n in per:
            out.append(np.unique(hashes[at : at + n]))
            at += n
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each coordinate's hash over a set, as int32."""
    low = np.full(COORDINATES, np.iinfo(U64).max, U64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        low = np.minimum(low, np.array([(part * f).min() for f in _FACTORS]))
    return (low >> U64(32)).astype(np.uint32).view(np.int32)


def _describe(rows: dict) -> dict:
    sets = shingle_sets(rows["text"])
    return {
        "doc_id": rows["doc_id"],
        "n_shingles": [len(s) for s in sets],
        "set_key": [_key(s) if len(s) else None for s in sets],
        "sig": [signature(s) if len(s) else None for s in sets],
    }


def _key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    a = int(mix64(shingles).sum(dtype=U64))
    b = int(mix64(shingles ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64))
    return a.to_bytes(8, "little") + b.to_bytes(8, "little")


def _candidates(group: pa.Table, matches: int) -> dict | None:
    """Links of two blocks of a posting list whose signatures agree on ``matches`` coordinates."""
    ids = np.array(group.column("rep").to_pylist(), np.int64)
    sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.int32).reshape(len(ids), COORDINATES)
    if len(ids) < 2:
        return None
    if len(ids) == 2:
        if (sigs[0] == sigs[1]).sum() < matches:
            return None
        return {"a": [int(ids[0])], "b": [int(ids[1])]}
    order = np.argsort(ids)
    ids, sigs = ids[order], sigs[order]
    left, right = [], []
    for at in range(0, len(ids), 64):
        same = np.zeros((min(64, len(ids) - at), len(ids)), np.int16)
        for c in range(COORDINATES):
            same += sigs[at : at + 64, c, None] == sigs[None, :, c]
        x, y = np.nonzero(same >= matches)
        left.append(x + at)
        right.append(y)
    return _links(ids, np.concatenate(left), np.concatenate(right))


def _links(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> dict | None:
    """One link for each member that is not the smallest of its component."""
    label = group_labels(len(ids), left, right)
    moved = np.flatnonzero(label != np.arange(len(ids)))
    if not len(moved):
        return None
    return {"a": ids[moved].tolist(), "b": ids[label[moved]].tolist()}


def _confirmed(group: pa.Table, percent: int) -> dict | None:
    """Links of two blocks of a candidate group, from exact intersections of full sets."""
    ids = np.array(group.column("rep").to_pylist(), np.int64)
    if len(ids) < 2:
        return None
    order = np.argsort(ids)
    blobs = group.column("shingles").to_pylist()
    sets = [np.frombuffer(blobs[i], U64) for i in order]
    ids = ids[order]
    sizes = np.array([len(s) for s in sets], np.int64)
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(len(ids)), sizes)
    _, column, count = np.unique(everything, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    dense = np.cumsum(count > 1) - 1
    column, owner = dense[column[shared]], owner[shared]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    both = np.zeros((len(ids), len(ids)), np.float64)
    width = max(1, (1 << 22) // len(ids))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        part = np.zeros((len(ids), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    union = sizes[:, None] + sizes[None, :] - both
    return _links(ids, *np.nonzero(100 * both >= percent * union))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key, sig of every document."""
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n_shingles long, set_key binary, sig array<int>", _describe)


def candidate_groups(reps: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(id, root) of the distinct sets (rep, sig) that some chain of signature matches ties together."""
    posted = reps.select("rep", F.posexplode("sig").alias("c", "v")).select(
        "rep", F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("post")
    )
    met = posted.groupBy("post").agg(F.count("*").alias("n")).where("n > 1")
    shared = posted.join(met, "post").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "post"))).alias("posts"))
    prefix = shared.where(F.size("posts") >= matches).select(
        "rep", F.explode(F.expr(f"slice(posts, 1, size(posts) - {matches} + 1).post")).alias("post")
    )
    packed = reps.select("rep", F.col("sig"))
    full = cut(prefix.join(packed, "rep"))
    pack = map_rows(full, "post long, rep long, sig binary", _pack, rows=4096)
    pairs = block_pairs(pack, "post", "rep", None, BLOCK)
    return components(map_groups(pairs, ["post", "_i", "_j"], "a long, b long", partial(_candidates, matches=matches)))


def _pack(rows: dict) -> dict:
    return {"post": rows["post"], "rep": rows["rep"], "sig": [np.array(s, np.int32).tobytes() for s in rows["sig"]]}


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, shingles (sorted 64-bit hashes) of the documents named in ``wanted`` (id).

    The sets are made again from the texts, so neither sets nor texts of all
    documents are stored or shuffled: a bit filter of fixed size tells each task
    which texts may be needed, and a join on the id removes its false hits.
    """
    passes = bit_filter(wanted)

    def pick(rows: dict) -> dict | None:
        hit = passes(rows["bit"])
        if not hit:
            return None
        sets = shingle_sets([rows["text"][i] for i in hit])
        return {
            "id": [rows["doc_id"][i] for i in hit], "shingles": [s.tobytes() for s in sets],
            "bytes": [8 * len(s) for s in sets], "set_key": [_key(s) for s in sets],
        }

    read = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS)).alias("bit"))
    return map_rows(read, "id long, shingles binary, bytes long, set_key binary", pick)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document. Links need ``percent`` of
    the union in common; ``matches`` is the number of equal coordinates that makes a candidate."""
    told = cut(described(docs))
    classes = told.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("sig").alias("sig")
    )
    classes = cut(classes)
    groups = candidate_groups(classes.select("rep", "sig"), matches)
    # a doc_id that stands for more than one set keeps the sets of all its rows apart by their key
    wanted = groups.join(classes.select(F.col("rep").alias("id"), "set_key"), "id")
    members = wanted.join(full_sets(docs, groups.select("id")), ["id", "set_key"]).select(
        F.col("id").alias("rep"), "root", "bytes", "shingles", "set_key"
    ).dropDuplicates(["rep", "set_key"]).drop("set_key")
    blocks = block_pairs(cut(members), "root", "rep", "bytes", BLOCK)
    links = map_groups(blocks.drop("bytes"), ["root", "_i", "_j"], "a long, b long", partial(_confirmed, percent=percent))
    joined = components(links).select(F.col("id").alias("rep"), "root")
    of_class = classes.select("set_key", "rep").join(joined, "rep", "left").select("set_key", F.coalesce("root", "rep").alias("component_id"))
    out = told.join(of_class, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are the smallest of their group; rows with a null doc_id stay."""
    found = near_duplicates(docs, STAGE_PERCENT, STAGE_MATCHES).where("not kept").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti")
