"""Operator 4: toxicity by a weighted lexicon and an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts to Latin
ones, digits and signs inside words to the letters they stand for, everything that
is no letter to one space. The lexicon is learned from labelled documents: whole
words and word beginnings whose document frequency among toxic documents exceeds
that among clean ones, weighted by the smoothed log-odds ratio. One automaton
matches all terms in one pass; the longest match at a word counts, unless the word
stands in an exception phrase (a pair of neighbouring words found mostly in clean
documents). Weights are summed, normalised by length, and a logistic function fitted on other
labelled rows turns the sums into a score.

Learning takes about ``SAMPLE`` labelled documents (all where there are fewer), picked by a hash of their id
(the classifier's documented bound); one half gives the lexicon, the other the
logistic function. Scoring reads every whole text. labels, lang, source and doc_id
are never inputs of a score.

Defined results: null and empty texts get the score of a text without matches;
documents with null labels or without labels are not learned from; with no toxic
or no clean example, the lexicon is empty and scores are 0; repeated rows are
scored alike; a null doc_id counts as held in. Only doc_id and text are read.
"""
from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from beaconry.llm.common import cut, hashed_sample, map_rows, table

SAMPLE = 20_000
#: A term needs this many toxic documents and this log-odds ratio; the strongest TERMS are kept.
LEAST_TOXIC, LEAST_ODDS, TERMS = 5, 1.6, 5_000
PREFIXES = (4, 5, 6, 7, 8)
#: An exception phrase needs this many clean documents, and at most a quarter of its documents toxic.
LEAST_CLEAN = 5
REJECT = 0.7
FEATURES = 4

# fixed values: look-alike letters of other scripts, and signs that stand for letters
LOOKALIKES = str.maketrans("авеёкмнорстухіјѕԁԛԝһӏαεικνορτυχ", "abeekmhopctyxijsdqwhlaeiknoptux", "​‌‍­﻿")
SIGNS = str.maketrans("013457@$", "oieastas")
_MIXED = re.compile(r"[013457@$]+(?=[^\W\d_])|(?<=[^\W\d_])[013457@$]+")
_GAPS = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Folded text with one space around each word."""
    plain = (text or "").lower()
    if not plain.isascii():
        plain = plain.translate(LOOKALIKES)
    plain = _MIXED.sub(lambda m: m[0].translate(SIGNS), plain)
    return f" {_GAPS.sub(' ', plain).strip()} "


def terms_of(folded: str) -> set[str]:
    """Whole words (with the closing space) and word beginnings of a folded text."""
    out = set()
    for word in set(folded.split()):
        if 3 <= len(word) <= 40:
            out.add(f" {word} ")
            out.update(f" {word[:n]}" for n in PREFIXES if n <= len(word))
    return out


def _count(rows: dict) -> dict:
    toxic, clean = Counter(), Counter()
    for text, label in zip(rows["text"], rows["toxic"]):
        (toxic if label else clean).update(terms_of(fold(text)))
    names = list(toxic.keys() | clean.keys())
    return {"term": names, "toxic": [toxic[t] for t in names], "clean": [clean[t] for t in names]}


class Lexicon:
    """Weighted terms, exception phrases and the automaton over the terms."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[tuple[str, str]] = frozenset()):
        self.weights, self.exceptions = weights, exceptions

    def __getstate__(self):
        return self.weights, self.exceptions

    def __setstate__(self, state):
        self.weights, self.exceptions = state

    def automaton(self):
        if not hasattr(self, "_automaton"):
            self._automaton = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                self._automaton.add_word(term, (term, weight))
            if self.weights:
                self._automaton.make_automaton()
        return self._automaton

    def matches(self, folded: str) -> dict[int, tuple[str, float]]:
        """Word start -> longest matching term and its weight."""
        best: dict[int, tuple[str, float]] = {}
        if self.weights:
            for end, (term, weight) in self.automaton().iter(folded):
                start = end + 1 - len(term)
                if start not in best or len(term) > len(best[start][0]):
                    best[start] = term, weight
        return best

    def neighbours(self, folded: str, start: int) -> list[tuple[str, str]]:
        """Pairs of the word at ``start`` with the word before and the word after it."""
        end = folded.index(" ", start + 1)
        word = folded[start + 1 : end]
        before = folded[folded.rfind(" ", 0, start) + 1 : start] if start else ""
        after = folded[end + 1 : folded.find(" ", end + 1)] if end + 1 < len(folded) else ""
        return [pair for pair in ((before, word), (word, after)) if all(pair)]

    def features(self, text: str | None) -> list[float]:
        folded = fold(text)
        total, distinct = 0.0, set()
        for start, (term, weight) in self.matches(folded).items():
            if self.exceptions and any(p in self.exceptions for p in self.neighbours(folded, start)):
                continue
            total += weight
            distinct.add(term)
        words = max(1, folded.count(" ") - 1)
        return [math.log1p(total), total / math.sqrt(words), min(4.0, 100.0 * total / words) if total else 0.0, math.log1p(len(distinct))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None):
        self.lexicon, self.weights = lexicon, weights

    def score(self, texts: list[str | None]) -> list[float]:
        if self.weights is None:
            return [0.0] * len(texts)
        x = np.array([self.lexicon.features(t) for t in texts]).reshape(len(texts), FEATURES)
        z = x @ self.weights[:-1] + self.weights[-1]
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    labelled = cut(
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    picked = hashed_sample(labelled, "doc_id", "toxicity", sample).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)))
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(cut(picked)), "doc_id"))
    ratio = F.col("toxic") > 0
    totals = rows.where("half = 0").agg(F.count_if(ratio).alias("t"), F.count_if(~ratio).alias("c")).first()
    if not totals.t or not totals.c:
        return Model(Lexicon({}), None)
    counted = map_rows(rows.where("half = 0").select("text", "toxic"), "term string, toxic long, clean long", _count)
    odds = F.log((F.col("toxic") + 0.5) / (totals.t + 1.0)) - F.log((F.col("clean") + 0.5) / (totals.c + 1.0))
    found = (
        counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= LEAST_TOXIC).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(TERMS).collect()
    )
    lexicon = Lexicon({r.term: r.odds for r in found})
    sent = spark.sparkContext.broadcast(lexicon)

    def phrases(rows: dict) -> dict:
        toxic, clean = Counter(), Counter()
        for text, label in zip(rows["text"], rows["toxic"]):
            folded = fold(text)
            pairs = {p for start in sent.value.matches(folded) for p in sent.value.neighbours(folded, start)}
            (toxic if label else clean).update(pairs)
        names = list(toxic.keys() | clean.keys())
        return {"a": [n[0] for n in names], "b": [n[1] for n in names], "toxic": [toxic[n] for n in names], "clean": [clean[n] for n in names]}

    excepted = (
        map_rows(rows.where("half = 0").select("text", "toxic"), "a string, b string, toxic long, clean long", phrases)
        .groupBy("a", "b").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("clean") >= LEAST_CLEAN) & (F.col("clean") >= 3 * F.col("toxic"))).orderBy(F.desc("clean"), "a", "b").limit(TERMS).collect()
    )
    lexicon = Lexicon(lexicon.weights, frozenset((r.a, r.b) for r in excepted))
    again = spark.sparkContext.broadcast(lexicon)
    fitted = map_rows(
        rows.where("half = 1").select("text", "toxic"), "x array<double>, toxic int",
        lambda rows: {"x": [again.value.features(t) for t in rows["text"]], "toxic": rows["toxic"]},
    ).collect()
    y = np.array([float(r.toxic > 0) for r in fitted])
    if not len(y) or y.min() == y.max():
        return Model(Lexicon({}), None)
    return Model(lexicon, _logistic(np.array([r.x for r in fitted]), y))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` rows' doc_id with held_out, score and predicted, row for row."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def each(rows: dict) -> dict:
        score = sent.value.score(rows["text"])
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": score, "predicted": [int(s >= REJECT) for s in score]}

    read = docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return map_rows(read, "doc_id long, held_out boolean, score double, predicted int", each)


def op4_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the rejection threshold."""
    sent = spark.sparkContext.broadcast(learn(docs, table(spark, sf_dir, "labels")))
    columns = docs.columns
    schema = docs.schema

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                score = np.array(sent.value.score(part.column(columns.index("text")).to_pylist()))
                yield part.filter(pa.array(score < REJECT))

    return docs.mapInArrow(keep, schema)
