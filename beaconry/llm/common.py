"""Helpers shared by the training-data operators."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. ``spark.checkpoint.dir`` names
    it; a temporary folder is used only where that is unset (local tests)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = context.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialize on shared storage and forget the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write to shared storage and read back, for loops: a checkpoint would keep the size
    estimate of its plan, which joins multiply from round to round without end."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed_sample(df: DataFrame, key: str, salt: str, rows: int) -> DataFrame:
    """About ``rows`` rows by a hash of the key (all where there are fewer), without a sort or a common task."""
    found = df.count()
    if found <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30)) < int(rows / found * (1 << 30)))


def map_rows(df: DataFrame, schema: str, each: Callable[[dict[str, list]], dict[str, list] | None], rows: int = 512) -> DataFrame:
    """``each`` turns column lists of at most ``rows`` input rows into column lists of output rows."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                made = each(batch.slice(at, rows).to_pydict())
                if made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def map_groups(
    df: DataFrame, keys: list[str], schema: str, each: Callable[[pa.Table], dict[str, list] | None], parts: int | None = None
) -> DataFrame:
    """``each`` sees all rows of one key at a time. Rows are dealt by key and sorted
    within the partition, so many small groups stream through one Python call
    without a call per group; a group must be bounded by the caller."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_pylist() for k in keys]
            marks = list(zip(*columns))
            start = 0
            for i, mark in enumerate(marks):
                if mark != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield pa.Table.from_batches(held)
                    held, start, last = [], i, mark
            held.append(batch.slice(start))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, list] = {f.name: [] for f in out}
        for group in groups(batches):
            got = each(group)
            if got is not None:
                for name, values in got.items():
                    made[name].extend(values)
                if len(made[out[0].name]) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)
                    made = {f.name: [] for f in out}
        if made[out[0].name]:
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = U64(0xD6E8FEB86659FD93)
_POWERS = _INVERSE = np.ones(1, U64)
_SEGMENT = 1 << 17


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2^64."""
    global _POWERS, _INVERSE
    if n > len(_POWERS):
        made = []
        for base in (_BASE, U64(pow(int(_BASE), -1, 1 << 64))):
            grown = np.full(max(2 * n, 4096), base)
            grown[0] = U64(1)
            made.append(np.multiply.accumulate(grown))
        _POWERS, _INVERSE = made
    return _POWERS, _INVERSE


def word_hashes(texts: list[str | bytes | None], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every ASCII-lower-cased word in order, words per text); bytes are taken as they are.
    ``space`` marks the byte values that part words; blanks and line ends must be among them.

    All texts of the call are hashed at once over their bytes: a word's hash is the
    mixed sum of per-byte random numbers times powers by position, taken from running
    sums over segments that begin with a word.
    """
    raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    space = space.take(data)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(raw), np.int64)
    sums = np.empty(len(starts), U64)
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data), _SEGMENT)))
    for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(starts)]):
        if low == high:
            continue
        at, end = int(starts[low]), int(ends[high - 1])
        powers, inverse = _powers(end - at)
        running = np.zeros(end - at + 1, U64)
        np.cumsum(_BYTE.take(data[at:end]) * powers[: end - at], out=running[1:])
        begin = starts[low:high] - at
        sums[low:high] = (running.take(ends[low:high] - at) - running.take(begin)) * inverse.take(begin)
    hashes = mix64(sums + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.diff(np.searchsorted(starts, text_ends, side="right"), prepend=0)


class Lookup:
    """Rows of distinct 64-bit keys. A key lies in the first of a few tables in which no other took its slot,
    so whole arrays of keys are found without a search."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels = keys, []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            shift = U64(63 - len(left).bit_length())
            slots = self._slots(keys[left], len(self.levels), shift)
            rows = np.full(1 << (64 - int(shift)), -1, np.int32)
            rows[slots] = left
            self.levels.append((shift, rows))
            left = left[rows[slots] != left]

    @staticmethod
    def _slots(keys: np.ndarray, level: int, shift: np.uint64) -> np.ndarray:
        return ((keys * (U64(0x9E3779B97F4A7C15) + U64(2 * level))) >> shift).view(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int32)
        left = None
        for level, (shift, rows) in enumerate(self.levels):
            asked = keys if left is None else keys[left]
            found = rows[self._slots(asked, level, shift)]
            hit = (self.keys[found] == asked) & (found >= 0)
            at = np.flatnonzero(hit)
            out[at if left is None else left[at]] = found[at]
            left = np.flatnonzero(~hit) if left is None else left[~hit]
            if not len(left):
                break
        return out


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``k`` words, runs per text); a text with 1 to k-1 words
    gives one run, its whole sequence."""
    n = len(hashes)
    if not n:
        return np.zeros(0, U64), np.zeros(len(counts), np.int64)
    ends = np.cumsum(counts)
    starts = ends - counts
    total = np.zeros(n, U64)
    for j in range(min(k, n)):
        total[: n - j] = total[: n - j] * U64(0xC2B2AE3D27D4EB4F) + hashes[j:]
    owner_end = np.repeat(ends, counts)
    whole = np.arange(n) + k <= owner_end
    short = np.flatnonzero((counts > 0) & (counts < k))
    for t in short:
        s = U64(0)
        with np.errstate(over="ignore"):
            for h in hashes[starts[t] : ends[t]]:
                s = s * U64(0xC2B2AE3D27D4EB4F) + h
            total[starts[t]] = s + U64(0x51ED270B) * U64(counts[t])
        whole[starts[t]] = True
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return mix64(total[whole]), per


def text_chunks(texts: list[str | None], most: int = 1 << 21) -> Iterator[slice]:
    """Slices of about ``most`` characters (one text at least), so that the arrays of a call stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))




def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): for each id in ``links`` (a, b) the smallest id reachable.

    Alternating large-star and small-star steps link nodes to ever smaller
    representatives until each component is a star. A hub meets only minimum
    aggregates, which combine before the shuffle, and equi-joins, which adaptive
    execution splits. Raises when it has not settled, never returns half a result.
    """
    now = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    check = None
    for _ in range(rounds):
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if row == check or not row[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            )
        check = row
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        base = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(base, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(base.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def group_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member index of each of ``n`` nodes' component, for links inside one bounded group."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, left, label[right])
        np.minimum.at(low, right, label[left])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def block_pairs(members: DataFrame, key: str, id_col: str, weight: str | None, rows: int, size: int = 1 << 25) -> DataFrame:
    """Deal each group's members into blocks and return them once per pair of blocks:
    columns ``key``, ``_i``, ``_j``, ``_side`` and the rest.

    A group of n members becomes b = ceil(n / rows) blocks (more where ``weight``
    bytes ask for it) by a hash of the id, and each member meets all b blocks, so
    no task ever holds more than two blocks, however large the group.
    """
    volume = F.ceil(F.sum(F.col(weight)) / F.lit(size)) if weight else F.lit(1)
    sizes = members.groupBy(key).agg(F.count("*").alias("_n"), volume.alias("_v")).where("_n > 1")
    sizes = sizes.select(key, F.greatest(F.ceil(F.col("_n") / rows), F.col("_v"), F.lit(1)).cast("int").alias("_blocks"))
    dealt = members.join(sizes, key).withColumn("_b", F.pmod(F.xxhash64(F.lit("block"), id_col), F.col("_blocks")).cast("int"))
    others = F.expr("transform(sequence(0, _blocks - 1), o -> struct(least(_b, o) as _i, greatest(_b, o) as _j))")
    pairs = dealt.withColumn("_p", F.explode(others))
    return pairs.select(key, F.col("_p._i").alias("_i"), F.col("_p._j").alias("_j"), F.col("_b").alias("_side"),
                        *[c for c in members.columns if c != key])


#: Bits of the filter that spares reading the texts of documents without candidates (2 MB, whatever the input).
FILTER_BITS = 1 << 24


def bit_filter(wanted: DataFrame) -> Callable[[list], list[int]]:
    """A function from rows' ``bit`` values (pmod(xxhash64(id), FILTER_BITS)) to the row numbers
    that may be in ``wanted`` (id). It has false hits, which a join on the id removes."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1
    found = (
        wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    )
    bits = np.zeros((FILTER_BITS // 32768 + 1, 4096), np.uint8)
    for row in found:
        bits[row.bucket] = np.frombuffer(row.bits, np.uint8)
    sent = wanted.sparkSession.sparkContext.broadcast(bits.tobytes())

    def passes(values: list) -> list[int]:
        table_ = np.frombuffer(sent.value, np.uint8)
        at = np.array(values, np.int64)
        return np.flatnonzero((table_[(at // 32768 + 1) * 4096 + at % 32768 // 8] >> (at % 8).astype(np.uint8)) & 1).tolist()

    return passes
