"""Operator 6: language-model scoring by logistic context mixing.

A token is spelled as bytes and an end mark, each byte as the bits of a Huffman
code. Every bit is predicted in several contexts at once: the running document
class alone, with the last byte, the last two, three and four bytes of the word,
and the class with the word so far. Contexts are hashed into tables of fixed size
that hold how often the bit was 0 or 1 in training. A mixer adds the predictions in
the logistic domain; its weights are gated by how much each context has seen and by
the place in the word, and are learned online from all training tokens, whose own
occurrence is first taken out of the counts: each task learns from its share of the
(class, word) pairs, and the tasks' weights are averaged. An adaptive map, counted on
the way, refines the result.
Half of a word's probability comes from these bits, half from the exact counts of
the word in its class and in all classes, which grow with the corpus and know no
collisions. The sum of log10 probabilities is the score; bits per byte follow from it.

The document class is the component of a small mixture model over the most frequent
words of all training documents, fitted to the counts of all of them, that explains the document so far, looked at again after 8, 16, 32, 64, ... words, so a
prediction depends on earlier words of the same document only. Given class and word
it is a fixed number, so each distinct (class, word) of all documents is scored once.

Scores and counts are joins, not broadcasts: only the ``HEAD`` most frequent (class,
word) are sent to the tasks, and all others meet their scores by a shuffle. Both go by
a 64-bit hash of class and word.

Defined results: null and empty texts are one end token; a null doc_id counts as
trained on; repeated rows are scored and counted each; without training documents
N and V are 0 and all bits are even; an empty table gives an empty table. Only
doc_id and text are read.
"""
from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm.common import U64, Lookup, cut, map_groups, map_rows, mix64, table, text_chunks, word_hashes

#: (class, word) pairs whose scores are sent to every task (about 14 MB there).
HEAD = 1 << 18
#: Document classes, the frequent words that tell them apart, and the words before the first look at the class.
CLASSES, CLASS_WORDS, STRETCH = 8, 256, 8
#: Bits of the slot numbers of each context's table; all tables together have 14.7 million slots of two bytes.
SLOT_BITS = (15, 20, 20, 21, 21, 22, 22)
INPUTS = len(SLOT_BITS)
#: Documents whose class words the classes' fit starts from, and its rounds over all training documents after that.
START_DOCS, FIT_ROUNDS = 2_000, 6
#: Occurrences from which a task tells of a word, as long as the class words are certain without the others.
TOLD = 16
#: Units of the classes' log shares: sums of integers are the same in any order.
LOG_UNIT = 4096
#: Weight of the exact counts beside the bits, and of the counts over all classes beside those of one.
EXACT, PRIOR = 0.5, 2_000.0
#: Distinct (class, word) pairs that one counting or one scoring task gets, and pairs a worker gathers before it hands them on.
PAIRS_A_TASK, SCORED_A_TASK, GATHERED = 2_000_000, 200_000, 400_000
#: Pairs that one task of the mixer learns from.
LEARNED_A_TASK = 200_000
BATCH = 8_000
#: Words of a step of the mixer.
STEP = 1000
BLOCK_BITS = 16
END_OF_WORD, END_OF_TEXT, SYMBOLS = 256, 257, 258
SPACES = [bytes([b]) for b in b" \t\n\v\f\r"]
LEVELS = np.array([0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 512, 2048, 16384], np.int64)
#: Weight sets: how much the word so far has been seen, and whether it has begun.
GATES = 32
CELLS = 24

_SLOT = U64(0x9E3779B97F4A7C15)
_SPREAD = mix64(np.arange(1, 4097, dtype=U64) * U64(0x9E3779B97F4A7C15))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def gathered(df: DataFrame, parts_of) -> DataFrame:
    """class, word, n: training occurrences of all (class, word) of ``df`` (text, held_out), 0 for those
    of held-out texts only; summed within a task up to a bounded number of pairs, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Counter] = [Counter() for _ in range(CLASSES + 1)]

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(found)), [len(c) for c in found]), pa.int32()),
                pa.array([w for c in found for w in c], pa.binary()), pa.array([n for c in found for n in c.values()], pa.int64()),
            ], names=["class", "word", "n"])

        for batch in batches:
            for text, held in zip(batch.column("text"), batch.column("held_out")):
                for kind, words in parts_of(words_of(text.as_py())):
                    found[kind].update(dict.fromkeys(words, 0) if held.as_py() else words)
                if sum(map(len, found)) >= GATHERED:
                    yield made()
                    for c in found:
                        c.clear()
        if any(found):
            yield made()

    pairs = df.select("text", "held_out").mapInArrow(run, "class int, word binary, n long")
    return pairs.groupBy("class", "word").agg(F.sum("n").alias("n"))


def hashes_of(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word, 0 for the end of a text."""
    out = np.zeros(len(words), U64)
    out[[i for i, w in enumerate(words) if w]] = word_hashes(words)[0]
    return out


def keys_of(classes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes + (classes.astype(U64) + U64(1)) * U64(0xC2B2AE3D27D4EB4F))


def stretch_sizes(words: int) -> Iterator[int]:
    """Sizes of the stretches of a text, up to ``words`` at least."""
    at, size = 0, STRETCH
    while at < words:
        yield size
        at, size = at + size, min(2 * size, 512) if at else size


class Classes:
    """Running class of a document: the component of a mixture of multinomials over the
    frequent words that explains best what was read so far, 0 before any. Stretches
    double in length, so the class follows short texts closely and long ones cheaply."""

    def __init__(self, words: list[bytes], logs: np.ndarray):
        self.rank = {w: i for i, w in enumerate(words)}
        self.logs = np.round(logs * LOG_UNIT).astype(np.int64)  # word by component
        self.known = Lookup(hashes_of(words))

    @staticmethod
    def start(counts: np.ndarray, components: int, rounds: int = 25, restarts: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Log shares of words and log priors to start from: expectation maximization over the words' counts in some texts."""
        x = counts[np.lexsort(counts.T[::-1])].astype(float)
        share = x / x.sum(axis=1, keepdims=True)
        likely = np.flatnonzero(x.sum(axis=1) >= min(10, x.sum(axis=1).max()))
        rng, best = np.random.default_rng(11), (-np.inf, None, None)
        for _ in range(restarts):  # from texts drawn at random; the likeliest fit counts
            start = share[rng.choice(likely, min(components, len(likely)), replace=False)]
            logs, prior = np.log(start * 0.7 + 0.3 * share.mean(axis=0) + 1e-4).T, np.zeros(len(start))
            for _ in range(rounds):
                z = x @ logs + prior
                top = z.max(axis=1, keepdims=True)
                p = np.exp(z - top)
                total = p.sum(axis=1, keepdims=True)
                p /= total
                mass = x.T @ p + 0.1
                logs = np.log(mass / mass.sum(axis=0))
                prior = np.log((p.sum(axis=0) + 1) / (len(x) + len(prior)))
            found = float((top + np.log(total)).sum())
            if found > best[0]:
                best = found, logs, prior
        return best[1:]

    def of_words(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each word of texts of ``counts`` words, and of each text's end, as ``stretches`` has them."""
        begins = np.cumsum(counts) - counts
        top = int(counts.max(initial=0))
        steps = np.array([0, *accumulate(stretch_sizes(top))])  # up to the first beyond the longest text
        per = np.searchsorted(steps, counts)  # stretches with words
        text = np.repeat(np.arange(len(counts)), per)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        rank = self.known.rows(hashes)
        hit = np.flatnonzero(rank >= 0)
        sizes = np.minimum(steps[turn + 1], counts[text]) - steps[turn]
        of = np.repeat(np.arange(len(text)), sizes)[hit]
        sums = np.zeros((len(text), self.logs.shape[1]), np.int64)
        if len(hit):
            cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            sums[of[cuts]] = np.add.reduceat(self.logs[rank[hit]], cuts, axis=0)
        seen = np.bincount(of, minlength=len(text)) > 0
        first = np.cumsum(per) - per
        total, met = np.cumsum(sums, axis=0), np.cumsum(seen)
        before = np.concatenate((np.zeros((1, sums.shape[1]), np.int64), total))
        met = np.concatenate(([0], met))
        after = np.where(met[1:] > met[first[text]], (total - before[first[text]]).argmax(axis=1) + 1, 0) if len(text) else np.zeros(0, np.int64)
        stretch = np.where(turn > 0, np.concatenate(([0], after[:-1])), 0) if len(text) else after
        ends = np.zeros(len(counts), np.int64)
        ends[per > 0] = after[(first + per - 1)[per > 0]]
        return np.repeat(stretch, sizes), ends

    def stretches(self, words: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
        """(class, words) in order; a last stretch without words gives the class at the end."""
        at, size, total = 0, STRETCH, None
        while True:
            part = words[at : at + size]
            yield 0 if total is None else int(total.argmax()) + 1, part
            if not part:
                return
            ranks = [r for r in map(self.rank.get, part) if r is not None]
            if ranks:
                more = self.logs[ranks].sum(axis=0)
                total = more if total is None else total + more
            at, size = at + size, min(2 * size, 512) if at else size


class Code:
    """A Huffman code over the symbols: the nodes and bits on the way to each."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        children: dict[int, tuple[int, int]] = {}
        number = SYMBOLS
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[number] = a[2], b[2]
            heapq.heappush(heap, (a[0] + b[0], number, number))
            number += 1
        paths: list[list[tuple[int, int]]] = [[] for _ in range(SYMBOLS)]
        todo: list[tuple[int, list]] = [(number - 1, [])]
        while todo:
            node, path = todo.pop()
            if node < SYMBOLS:
                paths[node] = path
                continue
            for bit, child in enumerate(children[node]):
                todo.append((child, [*path, (node - SYMBOLS, bit)]))
        self.size = np.array([len(p) for p in paths], np.int64)
        self.first = np.cumsum(self.size) - self.size
        flat = [x for p in paths for x in p]
        self.spread = np.array([n + 1 for n, _ in flat], U64) * U64(0xC2B2AE3D27D4EB4F) * _SLOT
        self.bit = np.array([b for _, b in flat], np.int8)


def spelled(code: Code, classes: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(word number, bit, whether the word has begun, slot of each input) of all bits of the words; an empty word is the end of the text."""
    lengths = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(w + b"\0" for w in words), np.uint8).astype(np.int64)
    start = np.cumsum(lengths + 1) - lengths - 1
    data[start + lengths] = np.where(lengths > 0, END_OF_WORD, END_OF_TEXT)
    word = np.repeat(np.arange(len(words)), lengths + 1)
    place = np.arange(len(data)) - start[word]
    mixed = _SPREAD[data] * _SPREAD[np.minimum(place, 3000) + 300]
    so_far = np.cumsum(mixed) - mixed
    so_far -= so_far[start][word]
    kind = _SPREAD[classes[word] + 3400]
    last = []
    for k in range(1, 7):
        before = np.zeros(len(data), np.int64)
        before[k:] = data[:-k] + 1
        before[place < k] = 0
        last.append(before.astype(U64))
    two = last[0] | last[1] << U64(9)
    three = two | last[2] << U64(18)
    four = three | last[3] << U64(27)
    contexts = [kind, kind + last[0] * U64(0xFF51AFD7ED558CCD), mix64(two + kind), mix64(three + kind), mix64(four + U64(2)),
                mix64(four + (last[4] << U64(36)) + (last[5] << U64(45)) + kind), mix64(so_far + kind)]
    size = code.size[data]
    at = np.repeat(code.first[data] - np.cumsum(size) + size, size)
    at += np.arange(len(at))
    node = code.spread[at]
    slots = []
    for context, bits in zip(contexts, SLOT_BITS):
        slot = np.repeat(context * _SLOT, size)
        slot += node
        slot >>= U64(64 - bits)
        slots.append(slot.view(np.int64))
    return np.repeat(word, size), code.bit[at], np.repeat((place > 0).astype(np.int64), size), slots


_P = (np.arange(65536) >> 4) / 4095.0
_N = LEVELS[np.arange(65536) & 15].astype(float)


def stretch_table() -> np.ndarray:
    """Logit of each stored (share, level), drawn to even by few observations."""
    p = (_P * _N + 0.4) / (_N + 0.8)
    return np.log(p / (1 - p)).astype(np.float32)


def without_own() -> tuple[np.ndarray, np.ndarray]:
    """Logit and level of each (stored share and level, bit) once that bit is taken out of the counts."""
    n = np.maximum(_N - 1, 0)[:, None]
    p = (np.clip((_P * _N)[:, None] - np.array([0, 1]), 0, n) + 0.4) / (n + 0.8)
    level = np.searchsorted(LEVELS, n[:, 0], side="right") - 1
    return np.log(p / (1 - p)).astype(np.float32).ravel(), np.repeat(level, 2)


def pack(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Twelve bits of the share of ones, four of how many observations there were."""
    n = zeros.astype(np.int64) + ones
    share = np.round(4095.0 * ones / np.maximum(n, 1)).astype(np.int64)
    level = np.searchsorted(LEVELS, n, side="right") - 1
    return (share << 4 | level).astype(np.uint16)


class Model:
    def __init__(self, code: Code, tables: list[np.ndarray]):
        self.code, self.tables = code, tables
        self.weights = np.full((INPUTS, 16, GATES), 0.3, np.float32)
        self.weights[:, 0] = 0.0
        self.refined = np.tile(np.linspace(-12, 12, CELLS + 1), (GATES, 1))
        self.stretch = stretch_table()

    def _mixed(self, begun: np.ndarray, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Gate and mixed logit of each bit."""
        seen = [table_.take(slot) for table_, slot in zip(self.tables, slots)]
        gate = (seen[-1] & 15).astype(np.int64) * 2 + begun
        z = np.zeros(len(gate), np.float32)
        for i, values in enumerate(seen):
            place = (values & 15).astype(np.int64)
            place *= GATES
            place += gate
            z += self.stretch.take(values) * self.weights[i].reshape(-1).take(place)
        return gate, np.clip(z, -11.9, 11.9, out=z)

    def _refine(self, gate: np.ndarray, z: np.ndarray) -> np.ndarray:
        x = (z + 12) * (CELLS / 24)
        low = x.astype(np.int64)
        part = x - low
        flat = self.refined.reshape(-1)
        at = gate * (CELLS + 1) + low
        return 0.5 * z + 0.5 * (flat[at] * (1 - part) + flat[at + 1] * part)

    def log10(self, classes: np.ndarray, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word in its class."""
        out = []
        for at in range(0, len(words), BATCH):
            word, bit, begun, slots = spelled(self.code, classes[at : at + BATCH], words[at : at + BATCH])
            z = self._refine(*self._mixed(begun, slots))
            signed = np.where(bit == 1, z, -z)
            out.append(np.bincount(word, -np.log1p(np.exp(-signed)), minlength=len(words[at : at + BATCH])))
        return np.concatenate(out) / math.log(10) if out else np.zeros(0)

    def learn(self, classes: np.ndarray, words: list[bytes], counts: np.ndarray, rate: float = 0.3) -> np.ndarray:
        """Online steps for the mixer over training tokens, in the order of their hashes; the (bit, gate, cell) sums for the map.

        A token's own occurrence leaves the counts first: a context seen once, by
        the token itself, then counts as unseen. The first eighth of the steps moves the weights only.
        """
        order = np.argsort(mix64(keys_of(classes, hashes_of(words))), kind="stable")
        logit, level_of = without_own()
        square = np.full(self.weights.shape, 1e-3)
        size = GATES * (CELLS + 1)
        sums = np.zeros((2, size))
        for start in range(0, len(order), STEP):
            group = order[start : start + STEP]
            word, bit, begun, slots = spelled(self.code, classes[group], [words[i] for i in group])
            weight = np.minimum(counts[group], 1000).astype(float)[word]
            inputs, places, z = [], [], np.zeros(len(bit))
            for table_, slot in zip(self.tables, slots):
                seen = table_.take(slot) * np.int64(2) + bit
                inputs.append(logit.take(seen))
                places.append(level_of.take(seen))
            gate = places[-1] * 2 + begun
            for i in range(INPUTS):
                places[i] = places[i] * GATES + gate
                z += inputs[i] * self.weights[i].reshape(-1).take(places[i])
            z = np.clip(z, -11.9, 11.9)
            if 8 * (start + STEP) > len(order):
                cell = gate * (CELLS + 1) + np.round((z + 12) * (CELLS / 24)).astype(np.int64)
                ones = np.bincount(cell, weight * bit, minlength=size)
                sums[1] += ones
                sums[0] += np.bincount(cell, weight, minlength=size) - ones
            error = weight * (bit - 1 / (1 + np.exp(-z))) / weight.sum() * 100
            for i in range(INPUTS):
                slope = np.bincount(places[i], error * inputs[i], minlength=16 * GATES).reshape(16, GATES)
                square[i] += slope * slope
                self.weights[i] += (rate * slope / np.sqrt(square[i])).astype(np.float32)
        return sums.reshape(2, GATES, CELLS + 1)

    def refine_by(self, sums: np.ndarray) -> None:
        base = np.linspace(-12, 12, CELLS + 1)
        p = 1 / (1 + np.exp(-base))
        mean = (sums[1] + 20 * p) / (sums[0] + sums[1] + 20)
        self.refined = np.clip(np.log(mean / (1 - mean)), -12, 12)


def learned(pairs: DataFrame, code: Code, tables: list[np.ndarray]) -> Model:
    """The model whose mixer has learned from all ``pairs``: the tasks' weights, averaged by their numbers of pairs, and their map's sums."""
    model = Model(code, tables)
    sent = pairs.sparkSession.sparkContext.broadcast(model)
    tasks = max(1, math.ceil(pairs.count() / LEARNED_A_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        rows = pa.Table.from_batches(held)
        own = Model(sent.value.code, sent.value.tables)
        sums = own.learn(rows.column("class").to_numpy(), rows.column("word").to_pylist(), rows.column("n").to_numpy())
        yield pa.RecordBatch.from_arrays([
            pa.array([rows.num_rows]), pa.array([own.weights.astype(float).tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary()),
        ], names=["pairs", "weights", "sums"])

    found = pairs.select("class", "word", "n").repartition(tasks, "class", "word").mapInArrow(run, "pairs long, weights binary, sums binary").collect()
    if found:
        found.sort(key=lambda r: (r.pairs, bytes(r.weights)))
        total = sum(r.pairs for r in found)
        model.weights = sum(np.frombuffer(r.weights) * (r.pairs / total) for r in found).reshape(model.weights.shape).astype(np.float32)
        model.refine_by(sum(np.frombuffer(r.sums) for r in found).reshape(2, GATES, CELLS + 1))
    return model


def symbol_counts(pairs: DataFrame) -> np.ndarray:
    """Occurrences of each byte and end mark in all training tokens."""

    def each(rows: dict) -> dict:
        lengths = np.array([len(w) for w in rows["word"]], np.int64)
        n = np.array(rows["n"], np.int64)
        out = np.zeros(SYMBOLS)
        out[:256] = np.bincount(np.frombuffer(b"".join(rows["word"]), np.uint8), np.repeat(n, lengths), minlength=256)
        out[END_OF_WORD], out[END_OF_TEXT] = n[lengths > 0].sum(), n[lengths == 0].sum()
        return {"symbol": list(range(SYMBOLS)), "n": out.astype(np.int64).tolist()}

    counted = map_rows(pairs.select("word", "n"), "symbol int, n long", each, rows=1 << 16).groupBy("symbol").agg(F.sum("n").alias("n"))
    out = np.zeros(SYMBOLS, np.int64)
    for row in counted.collect():
        out[row.symbol] = row.n
    return out


def trained_tables(pairs: DataFrame, code: Code) -> list[np.ndarray]:
    """The hashed count tables of all training tokens, from the counts of (class, word)."""
    spark = pairs.sparkSession
    tasks = max(1, math.ceil(pairs.count() / PAIRS_A_TASK))
    sent = spark.sparkContext.broadcast(code)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tables = [np.zeros(2 << bits, np.uint32) for bits in SLOT_BITS]
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                word, bit, _, slots = spelled(sent.value, part.column("class").to_numpy(), part.column("word").to_pylist())
                n = np.minimum(part.column("n").to_numpy(), 1 << 30).astype(np.uint32)[word]
                for table_, slot in zip(tables, slots):
                    np.add.at(table_, 2 * slot + bit, n)
        for i, table_ in enumerate(tables):
            width = 2 << min(BLOCK_BITS, SLOT_BITS[i])
            for b in range(len(table_) // width):
                yield pa.RecordBatch.from_pydict(
                    {"input": [i], "block": [b], "task": [TaskContext.get().partitionId() // 32], "counts": [table_[b * width : (b + 1) * width].tobytes()]},
                    schema=pa.schema([("input", pa.int32()), ("block", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())]),
                )

    def total(group: pa.Table) -> np.ndarray:
        out = None
        for blob in group.column("counts"):
            counts = np.frombuffer(blob.as_buffer(), np.uint32)
            out = counts.astype(np.uint64) if out is None else out + counts
        return np.minimum(out, (1 << 32) - 1).astype(np.uint32)

    def added(group: pa.Table) -> dict:
        return {k: [group.column(k)[0].as_py()] for k in ("input", "block")} | {"task": [0], "counts": [total(group).tobytes()]}

    def packed(group: pa.Table) -> dict:
        sums = total(group)
        return {k: [group.column(k)[0].as_py()] for k in ("input", "block")} | {"slots": [pack(sums[::2], sums[1::2]).tobytes()]}

    schema = "input int, block int, task int, counts binary"
    counted = pairs.repartition(tasks).mapInArrow(count, schema)
    few = map_groups(counted, ["input", "block", "task"], schema, added) if tasks > 32 else counted
    rows = map_groups(few, ["input", "block"], "input int, block int, slots binary", packed).collect()
    tables = [np.zeros(1 << bits, np.uint16) for bits in SLOT_BITS]
    for row in rows:
        width = 1 << min(BLOCK_BITS, SLOT_BITS[row.input])
        tables[row.input][row.block * width : (row.block + 1) * width] = np.frombuffer(row.slots, np.uint16)
    return tables


def frequent(counts: DataFrame, most: int) -> pa.Table:
    """The rows of the highest ``n``, at most ``most`` of them. The limit comes from a
    histogram over sixteenths of powers of two, so nothing is sorted as a whole."""
    step = F.floor(F.log2("n") * 16).cast("int")
    seen = counts.where("n > 0")
    sizes = {r.step: r.words for r in seen.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()}
    least, held = 1 << 30, 0
    for s in sorted(sizes, reverse=True):
        if held + sizes[s] > most:
            break
        least, held = s, held + sizes[s]
    return seen.where(step >= least).toArrow()


def class_words(train: DataFrame) -> list[bytes]:
    """The most frequent words of all texts, by falling count, then by their bytes.

    Tasks tell of words they met TOLD times. What they keep to themselves bounds how much a
    count can be short; where that leaves the choice open, all words are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def made() -> pa.RecordBatch:
            told = {w: n for w, n in found.items() if n >= TOLD}
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([None, *told], pa.binary()), pa.array([1, *told.values()], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                found.update(words_of(text.as_py()))
                if len(found) >= GATHERED:
                    yield made()
        if found:
            yield made()

    counts = cut(train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("told")))
    parts = counts.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    order = [F.desc("n"), "word"]
    top = counts.where("word is not null").orderBy(*order).limit(CLASS_WORDS).toArrow()
    words = top.column("word").to_pylist()
    short = (F.lit(parts) - F.col("told")) * (TOLD - 1)
    least = min(top.column("n").to_pylist(), default=0)
    if len(words) == CLASS_WORDS and least > parts * (TOLD - 1):
        doubt = counts.where("word is not null").where((short > 0) & (F.col("n") + short >= least)).select("word").limit(CLASS_WORDS + 1).collect()
        if all(bytes(r.word) in words for r in doubt):
            return words
    every = gathered(train.select("text", F.lit(False).alias("held_out")), lambda words: [(0, words)])
    return every.orderBy(*order).limit(CLASS_WORDS).toArrow().column("word").to_pylist()


def fitted_classes(train: DataFrame) -> Classes:
    """Classes of the frequent words, by expectation maximization over all texts; some texts, picked by
    their counts, say where it starts."""
    words = class_words(train)
    if not words:
        return Classes(words, np.zeros((0, 1)))
    known = Lookup(hashes_of(words))

    def counted(rows: dict) -> dict:
        out = []
        for part in text_chunks(rows["text"]):
            hashes, counts = word_hashes(rows["text"][part])
            rank = known.rows(hashes)
            hit = rank >= 0
            at = np.repeat(np.arange(len(counts)), counts)[hit] * len(words) + rank[hit]
            x = np.minimum(np.bincount(at, minlength=len(counts) * len(words)), 20).astype(np.uint8).reshape(len(counts), len(words))
            out.append(x[x.any(axis=1)].tobytes())
        return {"docs": [len(x) // len(words) for x in out], "counts": out}

    blocks = cut(map_rows(train.select("text"), "docs int, counts binary", counted))
    docs = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    if not docs:
        return Classes(words, np.zeros((len(words), 1)))
    spread = mix64(np.arange(1, len(words) + 1, dtype=U64))
    least = U64(min((1 << 64) - 1, int((1 << 64) * min(1.0, START_DOCS / docs))))

    def read(blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, np.uint8).reshape(-1, len(words))

    def picked(rows: dict) -> dict:
        out = []
        for blob in rows["counts"]:
            x = read(blob)
            out.append(x[mix64(x.astype(U64) @ spread) <= least].tobytes())
        return {"counts": out}

    some = b"".join(r.counts for r in map_rows(blocks, "counts binary", picked, rows=16).collect()) or bytes(blocks.where("docs > 0").first().counts)
    logs, prior = Classes.start(read(some), CLASSES)
    last = -np.inf
    for _ in range(FIT_ROUNDS):

        def each(rows: dict) -> dict:
            mass, share, found = np.zeros(logs.shape), np.zeros(len(prior)), 0.0
            for blob in rows["counts"]:
                x = read(blob).astype(float)
                z = x @ logs + prior
                top = z.max(axis=1, keepdims=True)
                p = np.exp(z - top)
                total = p.sum(axis=1, keepdims=True)
                p /= total
                mass += x.T @ p
                share += p.sum(axis=0)
                found += float((top + np.log(total)).sum())
            return {"sums": [[*mass.ravel().tolist(), *share.tolist(), found]]}

        sums = np.sum(sorted(r.sums for r in map_rows(blocks.where("docs > 0"), "sums array<double>", each).collect()), axis=0)
        mass, share, found = sums[: logs.size].reshape(logs.shape) + 0.1, sums[logs.size : -1], sums[-1]
        logs, prior = np.log(mass / mass.sum(axis=0)), np.log((share + 1) / (docs + len(prior)))
        if found - last < 1e-5 * abs(found):
            break
        last = found
    return Classes(words, logs)


def word_scores(pairs: DataFrame, model: Model, total: int) -> DataFrame:
    """class, word, n, c (training occurrences in all classes), key, score (log10 probability) of every pair, scored once."""
    spark = pairs.sparkSession
    sizes = dict(pairs.groupBy("class").agg(F.sum("n")).collect())
    sent = spark.sparkContext.broadcast(model)

    def each(rows: dict) -> dict:
        kinds, n, c = (np.array(rows[k], np.int64) for k in ("class", "n", "c"))
        exact = (n + PRIOR * c / max(total, 1)) / (np.array([sizes.get(k, 0) for k in rows["class"]]) + PRIOR)
        share = EXACT if total else 0.0
        with np.errstate(divide="ignore"):
            both = np.logaddexp(np.log(share * exact), math.log(1 - share) + sent.value.log10(kinds, rows["word"]) * math.log(10))
        keys = keys_of(kinds, hashes_of(rows["word"])).view(np.int64)
        return {**rows, "key": keys.tolist(), "score": (both / math.log(10)).tolist()}

    in_all = pairs.groupBy("word").agg(F.sum("n").alias("c"))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(pairs.count() / SCORED_A_TASK))
    rows = pairs.join(in_all, "word").select("class", "word", "n", "c").repartition(tasks, "class", "word")
    return map_rows(rows, "class int, word binary, n long, c long, key long, score double", each, rows=BATCH)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document."""
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out"))
    train = read.where("not held_out")
    classes = fitted_classes(train)

    def parts_of(words: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
        return ((kind, part or [b""]) for kind, part in classes.stretches(words))

    pairs = cut(gathered(read, parts_of))
    total = pairs.groupBy("word").agg(F.sum("n").alias("c")).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.count_if(F.col("c") > 0), F.lit(0)).alias("v")
    ).first()
    trained = pairs.where("n > 0")
    code = Code(symbol_counts(trained))
    model = learned(trained, code, trained_tables(trained, code))
    scores = cut(word_scores(pairs, model, total.n).select("n", "c", "key", "score"))
    head = frequent(scores, HEAD)
    # Equal keys are equal pairs but for one chance in 2^64 for any two.
    keys, first = np.unique(head.column("key").to_numpy().view(U64), return_index=True)
    c = head.column("c").to_numpy()[first]
    sent = spark.sparkContext.broadcast((Lookup(keys), head.column("score").to_numpy()[first], np.log10(c + 1.0)))

    def each(rows: dict) -> dict:
        known, scores_, logs = sent.value
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_bytes", "head_score", "head_known", "head_log", "keys", "times")}
        for part in text_chunks(rows["text"]):
            texts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in rows["text"][part]]
            hashes, counts = word_hashes(texts)
            kinds, ends = classes.of_words(hashes, counts)
            size = len(counts)
            owner = np.concatenate((np.repeat(np.arange(size), counts), np.arange(size)))
            asked = keys_of(np.concatenate((kinds, ends)), np.concatenate((hashes, np.zeros(size, U64))))
            row = known.rows(asked)
            met = row >= 0
            at, row = owner[met], row[met]
            out["n_tokens"] += (counts + 1).tolist()
            letters = np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64)
            out["n_bytes"] += (letters + counts + 1).tolist()
            out["head_score"] += np.bincount(at, scores_[row], minlength=size).tolist()
            out["head_known"] += np.bincount(at, minlength=size).tolist()
            out["head_log"] += np.bincount(at, logs[row], minlength=size).tolist()
            at, tail = owner[~met], asked[~met]
            order = np.lexsort((tail, at))
            at, tail = at[order], tail[order].view(np.int64)
            new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (tail[1:] != tail[:-1])))) if len(at) else np.zeros(0, np.int64)
            times, tail = np.diff(np.append(new, len(at))), tail[new]
            cuts = np.searchsorted(at[new], np.arange(1, size))
            out["keys"] += [k.tolist() for k in np.split(tail, cuts)]
            out["times"] += [k.tolist() for k in np.split(times, cuts)]
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], **out}

    told = cut(map_rows(
        read, "doc_id long, held_out boolean, n_tokens long, n_bytes long, head_score double, head_known long, head_log double, "
        "keys array<long>, times array<int>", each, rows=512,
    )).withColumn("_row", F.monotonically_increasing_id())
    rare = told.select("_row", F.explode(F.arrays_zip("keys", "times")).alias("w"))
    rare = rare.select("_row", F.col("w.keys").alias("key"), F.col("w.times").alias("times"))
    met = rare.join(scores.select("key", "c", "score"), "key").groupBy("_row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("_known"),
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("_log"), F.sum(F.col("times") * F.col("score")).alias("_score"),
    )
    known_tokens = F.col("head_known") + F.coalesce("_known", F.lit(0))
    logs = F.col("head_log") + F.coalesce("_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(total.n + total.v + 1))
    score = F.col("head_score") + F.coalesce("_score", F.lit(0.0))
    return told.drop("keys", "times").join(met, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", known_tokens.cast("long").alias("n_known"), F.lit(total.n).cast("long").alias("train_tokens"),
        logs.alias("base_score"), score.alias("score"), (score * F.lit(-math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
