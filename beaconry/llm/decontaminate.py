"""Operator 2: benchmark decontamination by BM25 with block-max WAND.

The test items are the indexed side: an inverted index with postings in item
order, cut into blocks with their largest impact. Every passage of every training
text (windows of ``WINDOW`` words, half overlapping, to the end of the text) is a
query. Impacts are divided by the item's own score (in proportion for items that no
window can hold), so one threshold ``SHARE`` holds for all items, and everything at or above it is retrieved. Three bounds work
in turn, none of which can drop a hit: the sum of a passage's largest impacts, for
all passages of a batch at once; the block-max WAND pivot walk over postings; the
exact score. A hit counts as a leak when the text around it holds both the item's
question and its answer: at least ``OVERLAP`` of the distinct word triples of each
(the answer is the last sentence of five words or more, else the last third).

The index is built per shard of at most ``SHARD_WORDS`` item words, so what is sent
to the tasks is bounded; further shards are further passes over the texts. The number
of items, their mean length and the document frequencies are those of all items, so
scores do not depend on where the items are cut.

Defined results: null and empty texts and items without words match nothing; a
null doc_id is reported as null; repeated rows or items each give their rows once
(rows are distinct); an empty table gives an empty table. Of the items item_id and
text are read, of the documents doc_id and text.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beaconry.llm.common import U64, cut, map_rows, shingle_hashes, table, text_chunks, word_hashes

K1, B = 1.2, 0.75
WINDOW = 64
SHARE = 0.65
OVERLAP = 0.5
BLOCK = 4
#: Terms in more blocks than this are bounded by their largest impact alone.
WIDE = 16
#: Items are ordered by length; the largest impacts are also kept for each of so many length classes.
CLASSES = 8
#: An index of so many words takes about 40 MB; a longer item is a shard of its own.
SHARD_WORDS = 1_000_000
TRIPLE = 3

_PUNCTUATION = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¿¡«»„“”‘’…–—"})
_SENTENCE = re.compile(r"[.!?]+\s+")


def folded(text: str | None) -> str:
    """Lower case without punctuation."""
    return (text or "").lower().translate(_PUNCTUATION)


def triples(hashes: np.ndarray) -> np.ndarray:
    return np.unique(shingle_hashes(hashes, np.array([len(hashes)]), TRIPLE)[0])


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence, or as many last sentences as hold five words, is the answer;
    a text without such a cut is divided at two thirds of its words."""
    for cut_at in reversed([m.end() for m in _SENTENCE.finditer(text)]):
        if len(folded(text[cut_at:]).split()) >= 5:
            if len(folded(text[:cut_at]).split()) >= 5:
                return text[:cut_at], text[cut_at:]
            break
    words = text.split()
    at = max(1, len(words) * 2 // 3)
    return " ".join(words[:at]), " ".join(words[at:] or words)


@dataclass
class Statistics:
    """Of all items with words: how many, their mean length, and in how many of them each term of a shard occurs."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


class Index:
    """Inverted index of one shard of items, with block maxima; without statistics the shard is all there is."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        kept = [(i, t, word_hashes([folded(t)])[0]) for i, t in items]
        kept = sorted((x for x in kept if len(x[2])), key=lambda x: len(x[2]))
        self.ids = [i for i, _, _ in kept]
        self.parts = [tuple(triples(word_hashes([folded(p)])[0]) for p in question_and_answer(t)) for _, t, _ in kept]
        self.lengths = np.array([len(h) for _, _, h in kept], np.int64)
        n = len(kept)
        mean = statistics.mean if statistics else self.lengths.mean() if n else 1.0
        counted = [np.unique(h, return_counts=True) for _, _, h in kept]
        term = np.concatenate([c[0] for c in counted]) if n else np.zeros(0, U64)
        tf = np.concatenate([c[1] for c in counted]).astype(float) if n else np.zeros(0)
        item = np.repeat(np.arange(n), [len(c[0]) for c in counted])
        order = np.lexsort((item, term))
        term, tf, item = term[order], tf[order], item[order]
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        total, everywhere = n, df
        if statistics:
            total, everywhere = statistics.n, statistics.df[np.searchsorted(statistics.terms, self.terms)]
        idf = np.log(1 + (total - everywhere + 0.5) / (everywhere + 0.5))
        weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.lengths[item] / mean)) if n else tf
        # a window is sure to hold three quarters of its length of any item that goes through it
        own = np.bincount(item, weight, minlength=n) * np.minimum(1.0, 0.75 * WINDOW / np.maximum(self.lengths, 1))
        impact = weight / own[item] if n else weight
        self.top = np.maximum.reduceat(impact, first) if n else impact
        ends = np.append(first[1:], len(item))
        self.items = [item[a:b].tolist() for a, b in zip(first, ends)]
        self.impacts = [impact[a:b].tolist() for a, b in zip(first, ends)]
        self.block_top = []
        for items_, impacts in zip(self.items, self.impacts):
            tops: dict[int, float] = {}
            for i, x in zip(items_, impacts):
                tops[i // BLOCK] = max(tops.get(i // BLOCK, 0.0), x)
            self.block_top.append(tops)
        self.n_blocks = n // BLOCK + 1
        self.class_of = np.arange(self.n_blocks) * CLASSES // self.n_blocks
        self.class_top = np.zeros((CLASSES, len(self.terms)))
        for t, tops in enumerate(self.block_top):
            for block, x in tops.items():
                c = self.class_of[block]
                self.class_top[c, t] = max(self.class_top[c, t], x)
        self.blocks_of = np.array([len(t) for t in self.block_top], np.int64)
        self.block_first = np.cumsum(self.blocks_of) - self.blocks_of
        self.block_id = np.array([b for t in self.block_top for b in t], np.int64)
        self.block_value = np.array([x for t in self.block_top for x in t.values()], float)

    def wand(self, query: list[int], least: float) -> Iterator[tuple[int, float]]:
        """(item, score) of all items scoring at least ``least`` for the distinct terms of a passage.

        Cursors stand in item order. The pivot is the first item that the list
        maxima up to it could lift to the threshold; the maxima of the blocks it
        lies in decide whether it is scored or its whole block is skipped.
        """
        slack = least - 1e-9
        lists = [[self.items[t][0], t, 0] for t in query]  # item under the cursor, term, position
        while True:
            lists.sort()
            bound, pivot = 0.0, None
            for k, (item, t, _) in enumerate(lists):
                bound += self.top[t]
                if bound >= slack:
                    pivot = k
                    break
            if pivot is None:
                return
            at = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == at:
                pivot += 1
            block = at // BLOCK
            if sum(self.block_top[t].get(block, 0.0) for _, t, _ in lists[: pivot + 1]) >= slack:
                if lists[0][0] == at:
                    score = sum(self.impacts[t][p] for _, t, p in lists[: pivot + 1])
                    if score >= slack:
                        yield at, score
                    goal = at + 1
                else:
                    goal = at
            else:
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    goal = max(at + 1, min(goal, lists[pivot + 1][0]))
            kept = lists[pivot + 1 :]
            for item, t, p in lists[: pivot + 1]:
                items = self.items[t]
                while p < len(items) and items[p] < goal:
                    p += 1
                if p < len(items):
                    kept.append([items[p], t, p])
            lists = kept

    def _possible(self, segment: np.ndarray, term: np.ndarray, n: int, last: np.ndarray, least: float) -> np.ndarray:
        """Windows (two half-overlapping segments, the second absent after a text's last) in which
        some block of items can reach ``least``: block maxima are summed per window and block, but
        for the terms of most blocks, which add the largest impact of the block's length class."""
        wide = self.blocks_of[term] > WIDE
        both = np.zeros((CLASSES, n))
        for c in range(CLASSES):
            common = np.bincount(segment[wide], self.class_top[c, term[wide]], minlength=n)
            both[c] = common + np.where(last, 0.0, np.append(common[1:], 0.0))
        rare_segment, rare = segment[~wide], term[~wide]
        spread = self.blocks_of[rare]
        at = np.repeat(self.block_first[rare] - (np.cumsum(spread) - spread), spread) + np.arange(int(spread.sum()))
        cell, place = np.unique(np.repeat(rare_segment, spread) * self.n_blocks + self.block_id[at], return_inverse=True)
        value = np.bincount(place, self.block_value[at], minlength=len(cell))
        own, kind = cell // self.n_blocks, self.class_of[cell % self.n_blocks]
        following = np.minimum(np.searchsorted(cell, cell + self.n_blocks), max(0, len(cell) - 1))
        met = (cell[following] == cell + self.n_blocks) & ~last[own]
        first = own[value + np.where(met, value[following], 0.0) + both[kind, own] >= least]
        before = np.maximum(own - 1, 0)  # windows whose first segment misses the block
        back = before[(own > 0) & ~last[before] & (value + both[kind, before] >= least)]
        return np.unique(np.concatenate([first, back, np.flatnonzero((both >= least).any(axis=0))]))

    def search(self, texts: list[str | None], least: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
        """(text number, item number, score, question share, answer share) of the leaks."""
        hashes, counts = word_hashes([folded(t) for t in texts])
        if not len(self.terms) or not len(hashes):
            return []
        starts = np.cumsum(counts) - counts
        half = WINDOW // 2
        place = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[place] == hashes)
        owner = np.repeat(np.arange(len(counts)), counts)
        segments = np.maximum(1, -(-counts // half))
        first_segment = np.cumsum(segments) - segments
        segment = first_segment[owner[known]] + (known - starts[owner[known]]) // half
        pair = np.unique(segment * len(self.terms) + place[known])
        segment, term = pair // len(self.terms), pair % len(self.terms)
        n = int(segments.sum()) + 1
        last = np.zeros(n, bool)
        last[first_segment + segments - 1] = True
        windows = self._possible(segment, term, n, last, least - 1e-9)
        edge = np.searchsorted(segment, np.arange(n + 1))
        found: dict[tuple[int, int], list] = {}
        longest = int(self.lengths.max())
        for s in windows:
            text = int(np.searchsorted(first_segment, s, side="right") - 1)
            end = edge[s + 1] if last[s] else edge[min(s + 2, len(edge) - 1)]
            query = np.unique(term[edge[s] : end])
            middle = starts[text] + (s - first_segment[text]) * half
            around = None
            for item, score in self.wand(query.tolist(), least):
                if around is None:
                    around = triples(hashes[max(starts[text], middle - longest) : min(starts[text] + counts[text], middle + WINDOW + longest)])
                shares = [float(np.isin(p, around, assume_unique=True).mean()) for p in self.parts[item]]
                if min(shares) >= overlap:
                    old = found.get((text, item), [0.0, 0.0, 0.0])
                    found[text, item] = [max(a, b) for a, b in zip(old, [score, *shares])]
        return [(t, i, *values) for (t, i), values in found.items()]


def numbered(items: DataFrame, words: int = SHARD_WORDS) -> DataFrame:
    """item_id, text, _shard: distinct items in shards of a bounded number of words. Sizes are
    summed over ids in two levels (ranges of a thousand, then within a range)."""
    sized = cut(items.where("text is not null").select(F.col("item_id").cast("long"), "text").distinct().withColumn(
        "_words", F.greatest(F.lit(1), F.length("text") / 4).cast("long")
    ).withColumn("_range", F.floor(F.coalesce("item_id", F.lit(0)) / 1000)))
    before = sized.groupBy("_range").agg(F.sum("_words").alias("_sum")).select(
        "_range", (F.sum("_sum").over(W.orderBy("_range")) - F.col("_sum")).alias("_before")
    )
    within = F.sum("_words").over(W.partitionBy("_range").orderBy("item_id", "text")) - F.col("_words")
    return cut(sized.withColumn("_within", within).join(before, "_range").select(
        "item_id", "text", F.floor((F.col("_before") + F.col("_within")) / words).alias("_shard")
    ))


def item_terms(items: DataFrame) -> DataFrame:
    """_shard, length and the distinct term hashes of every item with words."""

    def each(rows: dict) -> dict | None:
        hashes, counts = word_hashes([folded(t) for t in rows["text"]])
        parts = np.split(hashes, np.cumsum(counts)[:-1]) if len(counts) else []
        kept = [(s, len(h), np.unique(h).view(np.int64).tolist()) for s, h in zip(rows["_shard"], parts) if len(h)]
        return dict(zip(("_shard", "length", "terms"), map(list, zip(*kept)))) if kept else None

    return cut(map_rows(items.select("_shard", "text"), "_shard long, length long, terms array<long>", each))


def indexes(items: DataFrame, words: int = SHARD_WORDS) -> Iterator[Index]:
    """One index per shard, one shard at a time on the driver: its items, and the frequencies of its terms."""
    dealt = numbered(items, words)
    counted = item_terms(dealt)
    n, mean = counted.agg(F.count("*"), F.avg("length")).first()
    terms = counted.select("_shard", F.explode("terms").alias("term"))
    per = cut(terms.groupBy("term", "_shard").agg(F.count("*").alias("here")))
    df = per.groupBy("term").agg(F.sum("here").alias("df"))
    frequencies = cut(per.select("_shard", "term").join(df, "term"))
    for row in counted.select("_shard").distinct().orderBy("_shard").toLocalIterator():
        mine = F.col("_shard") == row._shard
        found = frequencies.where(mine).select("term", "df").toPandas()
        hashes = found["term"].to_numpy(np.int64).view(U64)
        order = np.argsort(hashes)
        statistics = Statistics(n, mean, hashes[order], found["df"].to_numpy(np.int64)[order])
        yield Index([(r.item_id, r.text) for r in dealt.where(mine).orderBy("item_id", "text").collect()], statistics)


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, overlap: float = OVERLAP, words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of all leaks."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    read = docs.select(F.col("doc_id").cast("long"), "text")
    out = docs.sparkSession.createDataFrame([], schema)
    for built in indexes(items, words):
        sent = docs.sparkSession.sparkContext.broadcast(built)

        def each(rows: dict, sent=sent) -> dict | None:
            index = sent.value
            made: dict[str, list] = {name: [] for name in ("doc_id", "item_id", "score", "question_overlap", "answer_overlap")}
            for part in text_chunks(rows["text"]):
                for text, item, *values in index.search(rows["text"][part], share, overlap):
                    row = [rows["doc_id"][part.start + text], index.ids[item], *(round(v, 9) for v in values)]
                    for name, value in zip(made, row):
                        made[name].append(value)
            return made if made["doc_id"] else None

        out = out.union(map_rows(read, schema, each))
    return out.distinct()


def op2_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leak; rows with a null doc_id stay."""
    found = leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti")
