"""Operator 11: ranked lexical search by the Best Position Algorithm.

For every item the highest-scoring documents are found over impact lists: for each
term the documents holding it, by falling impact. Sorted accesses go down the
item's lists; a document met in one of them is looked up in all others by direct
access, which gives its whole score and marks its position in each list as seen.
The best position of a list is the end of its unbroken run of seen positions. It
lies at or beyond the last position read, because direct accesses fill the run, so
the impacts just behind the best positions bound every unseen document more
tightly. Search stops when that bound is strictly below the k-th score (a document
that ties with the k-th may have the smaller id), or nothing.

On Spark: one pass over the texts writes, for a block of items, the frequencies of
the items' terms in every document as packed chunks, in place (no text and no
posting is shuffled). Document frequencies and sizes are summed from the chunks.
Then each task takes its chunks in shards of documents, builds the shard's impact
lists and runs the algorithm per item; the k-th score found in earlier shards of
the task is the start for the next. Tasks return at most k rows an item, which are
ranked in two levels. Item blocks have a bounded number of terms, since they are
sent to every task; further blocks are further passes.

Terms are compared by 64-bit hashes. Defined results: null and empty texts and
texts without a term are no documents and match nothing; items without a known
term have no rows; equal documents and equal items are rows of their own; ties go
by ascending doc_id, null doc_ids last; an empty table gives an empty table. Of
the items item_id and text are read, of the documents doc_id and text.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beaconry.llm.common import map_rows, stored, table, text_chunks, word_hashes

TOP = 50
#: Distinct terms and items of a block (a longer item is a block of its own).
BLOCK_TERMS = 8192
BLOCK_ITEMS = 1024
#: A shard of documents has at most so many (document, term) cells and postings.
CELLS = 1 << 25
POSTINGS = 1 << 21
#: First number of positions read from every list at once; it doubles from step to step.
STEP = 16
#: Buckets of the first level of the final ranking.
BUCKETS = 64

#: Bytes that part terms: ASCII other than letters and digits (fixed by the contract).
_PARTS = np.zeros(256, bool)
_PARTS[:128] = [not chr(b).isalnum() for b in range(128)]


def term_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every term in order, terms per text)."""
    return word_hashes(texts, _PARTS)


def item_blocks(items: DataFrame, terms: int = BLOCK_TERMS, most: int = BLOCK_ITEMS) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """(item_id, distinct term hashes) of the items, in blocks of bounded size."""
    held: list[tuple[int | None, np.ndarray]] = []
    known: set[int] = set()
    for row in items.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        own = np.unique(term_hashes([row.text])[0])
        if not len(own):
            continue
        if held and (len(held) >= most or len(known.union(own.tolist())) > terms):
            yield held
            held, known = [], set()
        held.append((row.item_id, own))
        known.update(own.tolist())
    if held:
        yield held


def _counted(vocabulary: np.ndarray):
    """Packed frequencies of the vocabulary's terms in the documents of a batch."""

    def each(rows: dict) -> dict:
        out: dict[str, list] = {name: [] for name in ("docs", "terms", "ids", "nulls", "sizes", "held", "term", "tf")}
        for part in text_chunks(rows["text"]):
            hashes, counts = term_hashes(rows["text"][part])
            ids = rows["doc_id"][part]
            some = counts > 0
            place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            hit = vocabulary[place] == hashes
            owner = np.repeat(np.arange(len(counts)), counts)[hit]
            pair, tf = np.unique(owner * len(vocabulary) + place[hit], return_counts=True)
            row = np.cumsum(some) - 1
            out["docs"].append(int(some.sum()))
            out["terms"].append(int(counts.sum()))
            out["ids"].append(np.array([ids[i] or 0 for i in np.flatnonzero(some)], np.int64).tobytes())
            out["nulls"].append(np.array([ids[i] is None for i in np.flatnonzero(some)], bool).tobytes())
            out["sizes"].append(counts[some].astype(np.int64).tobytes())
            out["held"].append(row[pair // len(vocabulary)].astype(np.int32).tobytes())
            out["term"].append((pair % len(vocabulary)).astype(np.int32).tobytes())
            out["tf"].append(tf.astype(np.int32).tobytes())
        return out

    return each


def _holders(n_terms: int):
    """Documents holding each term, summed over the chunks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            for packed in batch.column("term").to_pylist():
                df += np.bincount(np.frombuffer(packed, np.int32), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int32()), "df": pa.array(df[some], pa.int64())})

    return run


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)


def norms(sizes: np.ndarray, documents: int, terms: int) -> np.ndarray:
    if int(sizes.max(initial=0)) * documents * 50 < 1 << 63:
        return 50 + (50 * sizes * documents) // terms
    return np.array([50 + 50 * int(n) * documents // terms for n in sizes], np.int64)


class Shard:
    """Impact lists of some documents: by term, falling impact; and each document's position in each."""

    def __init__(self, n_terms: int, size: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.lexsort((doc, -impact, term))
        self.size = size
        self.doc, self.impact = doc[order], impact[order]
        self.length = np.bincount(term, minlength=n_terms)
        self.start = np.cumsum(self.length) - self.length
        self.position = np.zeros((n_terms, size), np.int32)  # from 1; 0: the term isn't in the document
        self.position[term[order], self.doc] = np.arange(len(order)) - self.start[term[order]] + 1

    def best(self, terms: np.ndarray, weight: np.ndarray, k: int, least: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) holding the k best of the shard, as far as they reach
        ``least``, the k-th score known from elsewhere (0: none)."""
        use = (self.length[terms] > 0) & (weight > 0)
        terms, weight = terms[use], weight[use]
        start, length = self.start[terms], self.length[terms]
        seen_docs = np.zeros(self.size, bool)
        seen = np.zeros((len(terms), int(length.max(initial=0)) + 1), bool)
        docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        total, depth, kth = 0, 0, least
        last = max(0, len(self.impact) - 1)
        while len(terms):
            reading = np.minimum(length, depth + step) - np.minimum(length, depth)
            at = np.repeat(start + depth - (np.cumsum(reading) - reading), reading) + np.arange(int(reading.sum()))
            met = np.unique(self.doc[at])
            met = met[~seen_docs[met]]
            seen_docs[met] = True
            where = self.position[terms[:, None], met[None, :]]
            value = np.where(where > 0, self.impact[np.minimum(start[:, None] + where - 1, last)], 0)
            docs.append(met)
            scores.append(weight @ value)
            lists, found = np.nonzero(where)
            seen[lists, where[lists, found] - 1] = True
            total += len(met)
            position = seen.argmin(axis=1)  # the first position not seen; the column behind the longest list never is
            bound = int((weight * np.where(position < length, self.impact[np.minimum(start + position, last)], 0)).sum())
            if total >= k:
                all_scores = np.concatenate(scores)
                scores = [all_scores]
                kth = max(least, int(np.partition(all_scores, total - k)[total - k]))
            if bound == 0 or bound < kth:
                break
            depth, step = depth + step, step * 2
        found, score = np.concatenate(docs), np.concatenate(scores)
        keep = (score > 0) & (score >= kth)
        return found[keep], score[keep]


def _searched(sent, k: int):
    """At most k rows an item over all chunks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, documents, total = sent.value
        n_terms = len(weight)
        most = max(1, CELLS // n_terms)
        kept = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items]

        def search(held: list[dict]) -> None:
            ids = np.concatenate([np.frombuffer(c["ids"], np.int64) for c in held])
            nulls = np.concatenate([np.frombuffer(c["nulls"], bool) for c in held])
            norm = norms(np.concatenate([np.frombuffer(c["sizes"], np.int64) for c in held]), documents, total)
            before = np.cumsum([0, *(c["docs"] for c in held)])
            doc = np.concatenate([np.frombuffer(c["held"], np.int32) + b for c, b in zip(held, before)])
            term = np.concatenate([np.frombuffer(c["term"], np.int32) for c in held])
            tf = np.concatenate([np.frombuffer(c["tf"], np.int32) for c in held]).astype(np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 20 * norm[doc])
            for first in range(0, len(ids), most):  # a chunk may be larger than a shard
                size = min(most, len(ids) - first)
                own = (doc >= first) & (doc < first + size) if size < len(ids) else slice(None)
                shard = Shard(n_terms, size, doc[own] - first, term[own], impact[own])
                for i, (_, terms) in enumerate(items):
                    old_ids, old_nulls, old_scores = kept[i]
                    least = int(old_scores[k - 1]) if len(old_scores) >= k else 0
                    docs, score = shard.best(terms, weight[terms], k, least)
                    if len(docs):
                        new_ids = np.concatenate([old_ids, ids[first + docs]])
                        new_nulls = np.concatenate([old_nulls, nulls[first + docs]])
                        scores = np.concatenate([old_scores, score])
                        order = np.lexsort((new_ids, new_nulls, -scores))[:k]
                        kept[i] = (new_ids[order], new_nulls[order], scores[order])

        held: list[dict] = []
        docs = postings = 0
        for batch in batches:
            for chunk in batch.to_pylist():
                if held and (docs + chunk["docs"] > most or postings + len(chunk["tf"]) // 4 > POSTINGS):
                    search(held)
                    held, docs, postings = [], 0, 0
                if chunk["docs"]:
                    held.append(chunk)
                    docs, postings = docs + chunk["docs"], postings + len(chunk["tf"]) // 4
        if held:
            search(held)
        sizes = [len(scores) for _, _, scores in kept]
        if sum(sizes):
            ids, nulls, scores = (np.concatenate(column) for column in zip(*kept))
            number = np.repeat(np.arange(len(items)), sizes)
            yield pa.RecordBatch.from_pydict({
                "number": pa.array(number, pa.int32()), "doc_id": pa.array(ids, pa.int64(), mask=nulls), "score": pa.array(scores, pa.int64()),
            })

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, terms: int = BLOCK_TERMS, most: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents."""
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    parts = []
    for block, held in enumerate(item_blocks(items, terms, most)):
        vocabulary = np.unique(np.concatenate([own for _, own in held]))
        chunks = stored(map_rows(
            read, "docs int, terms long, ids binary, nulls binary, sizes binary, held binary, term binary, tf binary", _counted(vocabulary), rows=4096,
        ))
        documents, total = chunks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for row in chunks.select("term").mapInArrow(_holders(len(vocabulary)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[row.term] = row.df
        sent = spark.sparkContext.broadcast((
            [(i, np.searchsorted(vocabulary, own)) for i, own in held], weights(documents, df), documents, total,
        ))
        names = F.array(*[F.lit(i).cast("long") for i, _ in held])
        found = chunks.drop("terms").mapInArrow(_searched(sent, k), "number int, doc_id long, score long")
        parts.append(found.select(F.lit(block).alias("block"), "number", names[F.col("number")].alias("item_id"), "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    best_first = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    bucket = F.pmod(F.spark_partition_id(), F.lit(BUCKETS))
    for level in (["block", "number", "bucket"], ["block", "number"]):
        found = (found.withColumn("bucket", bucket) if "bucket" in level else found).withColumn(
            "rank", F.row_number().over(W.partitionBy(*level).orderBy(*best_first))
        ).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def op11_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE = f"""
with d as (select doc_id, {_TERMS} as terms from documents where text is not null),
sized as (select row_number() over () as r, doc_id, terms, len(terms)::bigint as n from d where len(terms) > 0),
total as (select count(*)::bigint as documents, sum(n)::bigint as all_terms from sized),
asked as (select q, item_id, term from (
  select q, item_id, unnest(list_distinct(terms)) as term from (
    select row_number() over () as q, item_id, {_TERMS} as terms from benchmark where text is not null))),
tf as (select r, term, count(*)::bigint as tf from (select r, unnest(terms) as term from sized) t
  where term in (select term from asked) group by r, term),
weight as (select term, floor(1000 * ln((2 * documents + 2)::double / (2 * df + 1)))::bigint as w
  from (select term, count(*)::bigint as df from tf group by term), total),
scored as (select a.q, any_value(a.item_id) as item_id, s.doc_id, t.r,
    sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (50 + (50 * s.n * total.documents) // total.all_terms))))::bigint as score
  from asked a join tf t on a.term = t.term join weight w on a.term = w.term join sized s on t.r = s.r, total
  group by a.q, s.doc_id, t.r),
ranked as (select item_id, row_number() over (partition by q order by score desc, doc_id nulls last) as rank, doc_id, score from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= {TOP}
"""
