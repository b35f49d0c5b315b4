"""Operator 5: token-id output with Re-Pair grammar compression.

Texts are encoded, an end id is appended, and documents are dealt to range
partitions of doc_id, so files follow each other in ascending order. Within a
partition documents are packed into shards of about ``SHARD`` ids. In each shard,
round after round, frequent pairs of neighbouring symbols become nonterminals: the
pairs of a round are taken by falling frequency, an occurrence is replaced where
no better pair overlaps it, and pairs that end up with too few uses are dropped.
Rules never cross the end of a document.

File format: parquet files (so tasks commit atomically and any store that Spark
writes to will do), one row per shard: ``part`` and ``shard`` (order), ``doc_ids``,
``symbols`` per document, ``tokens`` per document, the symbol ``sequence``, the two
sides of each rule and the ``lengths`` of the rules' expansions. With the lengths a
reader finds any document, or any id within it, without decoding the others.

Defined results: a null text is an empty one, so each document has at least the end
id; null doc_ids come first; equal doc_ids are ordered by text; an empty table
gives no shard and an empty result; further columns are not read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beaconry.llm.common import U64, fresh_folder, map_rows, table
from beaconry.llm.encode import default_path, encoder

END = 2
SHARD = 1 << 21
#: A rule must be used so often; pairs per round; rounds end when a round finds too little.
LEAST_USES = 16
PER_ROUND = 1 << 15
#: Rounds end when one replaces less than this part of the symbols.
STOP = 50
#: Values of the pairs' hash.
BUCKETS = 1 << 22
#: Symbols below this are ids of the vocabulary.
TERMINALS = 1 << 16

SHARD_SCHEMA = (
    "part int, shard int, n_docs int, n_tokens long, doc_ids array<long>, symbols binary, tokens binary, "
    "sequence binary, left binary, right binary, lengths binary"
)


def compress(sequence: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, ends, left, right): ``ends`` marks the last symbol of each document.

    Pairs are found by a hash of ``BUCKETS`` values: those in rare buckets cannot be
    frequent, and a pair is looked up by its bucket. Of two frequent pairs that share
    a bucket the better one is replaced first, the other in a later round.
    """
    sequence, ends = sequence.astype(np.uint32), ends.astype(bool)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    names = TERMINALS
    ranks = np.full(BUCKETS, -1, np.int32)
    while len(sequence) > 1:
        a, b = sequence[:-1], sequence[1:]
        bucket = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))) & np.uint32(BUCKETS - 1)
        often = np.bincount(bucket, minlength=BUCKETS) >= LEAST_USES
        hot = np.flatnonzero(often[bucket] & ~ends[:-1])
        codes = a[hot].astype(U64) << U64(32) | b[hot]
        ordered = np.sort(codes)
        if not len(ordered):
            break
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(first, len(ordered)))
        best = np.flatnonzero(counts >= LEAST_USES)
        if not len(best):
            break
        pairs = ordered[first[best[np.argsort(-counts[best], kind="stable")[:PER_ROUND]]]]
        one, two = (pairs >> U64(32)).astype(np.uint32), pairs.astype(np.uint32)
        places = ((one * np.uint32(0x9E3779B1)) ^ (two * np.uint32(0x85EBCA77))) & np.uint32(BUCKETS - 1)
        ranks[places[::-1]] = np.arange(len(pairs) - 1, -1, -1, dtype=np.int32)
        found = ranks[bucket[hot]]
        known = np.flatnonzero(found >= 0)
        known = known[pairs[found[known]] == codes[known]]
        ranks[places] = -1
        at, mine = hot[known], found[known]
        rank = np.full(len(sequence) + 1, 1 << 30, np.int32)
        rank[at + 1] = mine  # shifted by one: rank[i + 1] belongs to position i
        won = (mine < rank[at]) & (mine <= rank[at + 2])
        wins, taken = at[won], mine[won]
        good = np.bincount(taken, minlength=len(pairs)) >= LEAST_USES
        if not good.any():
            break
        kept = good[taken]
        wins, taken = wins[kept], taken[kept]
        left.append(one[good].astype(np.int64))
        right.append(two[good].astype(np.int64))
        sequence[wins] = (np.cumsum(good) - 1 + names)[taken]
        names += int(good.sum())
        ends[wins] = ends[wins + 1]
        keep = np.ones(len(sequence), bool)
        keep[wins + 1] = False
        sequence, ends = sequence[keep], ends[keep]
        if len(wins) < len(sequence) // STOP:
            break
    none = np.zeros(0, np.int64)
    return sequence, ends, np.concatenate([none, *left]), np.concatenate([none, *right])


def expansion_lengths(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids that each rule stands for; a rule names only earlier symbols."""
    lengths = np.zeros(len(left), np.int64)
    open_ = np.ones(len(left), bool)
    while open_.any():
        a = np.where(left < TERMINALS, 1, lengths[np.maximum(left - TERMINALS, 0)])
        b = np.where(right < TERMINALS, 1, lengths[np.maximum(right - TERMINALS, 0)])
        done = open_ & (a > 0) & (b > 0)
        lengths[done] = (a + b)[done]
        open_ &= ~done
    return lengths


def expand(sequence: np.ndarray, left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids of a run of symbols. Each step writes a symbol's left side in place and its
    right side behind it, all symbols at once; the lengths give the places."""
    if not len(left):
        return sequence
    size = np.where(sequence < TERMINALS, 1, lengths[np.maximum(sequence - TERMINALS, 0)])
    out = np.zeros(int(size.sum()), np.int64)
    at = np.cumsum(size) - size
    while len(sequence):
        plain = sequence < TERMINALS
        out[at[plain]] = sequence[plain]
        sequence, at = sequence[~plain] - TERMINALS, at[~plain]
        a, b = left[sequence], right[sequence]
        skip = np.where(a < TERMINALS, 1, lengths[np.maximum(a - TERMINALS, 0)])
        sequence, at = np.concatenate([a, b]), np.concatenate([at, at + skip])
    return out


def _pack(part: int, shard: int, doc_ids: list, blobs: list[bytes]) -> dict:
    tokens = np.array([len(b) // 2 for b in blobs], np.int64)
    ids = np.frombuffer(b"".join(blobs), "<u2")
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(tokens) - 1] = True
    sequence, marks, left, right = compress(ids, ends)
    symbols = np.diff(np.concatenate(([-1], np.flatnonzero(marks))))
    blob = lambda x: x.astype("<u4").tobytes()
    return {
        "part": [part], "shard": [shard], "n_docs": [len(doc_ids)], "n_tokens": [int(tokens.sum())], "doc_ids": [doc_ids],
        "symbols": [blob(symbols)], "tokens": [blob(tokens)], "sequence": [blob(sequence)],
        "left": [blob(left)], "right": [blob(right)], "lengths": [blob(expansion_lengths(left, right))],
    }


def shards(docs: DataFrame, path: str, size: int = SHARD) -> DataFrame:
    """One row per shard, in range partitions of doc_id."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(SHARD_SCHEMA))
    end = np.array([END], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, held, doc_ids, blobs = TaskContext.get().partitionId(), 0, 0, [], []
        encode = encoder(path)

        def made() -> pa.RecordBatch:
            row = _pack(part, shard, doc_ids, blobs)
            return pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in out], schema=out)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = encode.ids(text.as_py()) + end
                doc_ids.append(doc_id.as_py())
                blobs.append(ids)
                held += len(ids) // 2
                if held >= size:
                    yield made()
                    shard, held, doc_ids, blobs = shard + 1, 0, [], []
        if doc_ids:
            yield made()

    read = docs.select(F.col("doc_id").cast("long"), "text")
    return read.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARD_SCHEMA)


def write(docs: DataFrame, folder: str, path: str | None = None) -> None:
    shards(docs, path or default_path()).write.option("compression", "zstd").parquet(folder)


def _numbers(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u4").astype(np.int64)


def document(row: dict, number: int) -> np.ndarray:
    """Ids of one document of a shard; only its own symbols are expanded."""
    symbols = _numbers(row["symbols"])
    first = int(symbols[:number].sum())
    sequence = _numbers(row["sequence"])[first : first + symbols[number]]
    return expand(sequence, _numbers(row["left"]), _numbers(row["right"]), _numbers(row["lengths"]))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids of every document in the files."""

    def each(rows: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("part", "shard", "doc_id", "offset", "n_tokens", "ids_crc32")}
        for i, doc_ids in enumerate(rows["doc_ids"]):
            left, right, lengths, sequence = (_numbers(rows[k][i]) for k in ("left", "right", "lengths", "sequence"))
            ids = expand(sequence, left, right, lengths)
            tokens = _numbers(rows["tokens"][i])
            starts = np.cumsum(tokens) - tokens
            data = memoryview(ids.astype("<u4").tobytes())
            out["part"] += [rows["part"][i]] * len(doc_ids)
            out["shard"] += [rows["shard"][i]] * len(doc_ids)
            out["doc_id"] += doc_ids
            out["offset"] += starts.tolist()
            out["n_tokens"] += tokens.tolist()
            out["ids_crc32"] += [zlib.crc32(data[4 * s : 4 * (s + n)]) for s, n in zip(starts, tokens)]
        return out

    stored = spark.read.parquet(folder)
    schema = "part int, shard int, doc_id long, offset long, n_tokens long, ids_crc32 long"
    decoded = map_rows(stored.drop("n_docs", "n_tokens", "symbols"), schema, each, rows=1)
    sizes = stored.select("part", "shard", F.col("n_tokens").alias("_n"))
    parts = sizes.groupBy("part").agg(F.sum("_n").alias("_sum")).select(
        F.col("part").alias("_part"), (F.sum("_sum").over(W.orderBy("part")) - F.col("_sum")).alias("_before")
    )
    within = F.sum("_n").over(W.partitionBy("part").orderBy("shard")) - F.col("_n")
    starts = sizes.withColumn("_within", within).join(parts, F.col("part") == F.col("_part")).select(
        "part", "shard", (F.col("_before") + F.col("_within")).alias("_start")
    )
    return decoded.join(starts, ["part", "shard"]).select("doc_id", (F.col("_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def stored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    folder = fresh_folder(spark)
    write(docs, folder)
    return read(spark, folder)


def op5_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stored(spark, docs)
