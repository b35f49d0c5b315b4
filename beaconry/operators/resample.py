"""Bootstrap intervals whose cost does not grow with the samples.

Samples count only through their outcome (tp, fp, fn). In Poisson resampling each of
n samples with one outcome is drawn a Poisson(1) number of times, together a
Poisson(n) number, so one draw per outcome and replicate has the law of n draws.
What grows with the data is one count per outcome; draws and sums are a job over
the distinct outcomes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.operators import evaluate as E


def draws(seed: int, outcome: tuple[int, int, int], n: int, replicates: int) -> np.ndarray:
    """How often samples of an outcome are drawn in each replicate; the same on every run and in every task."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *outcome]))).poisson(n, replicates)


def outcomes(samples: DataFrame, matched: DataFrame) -> DataFrame:
    """tp, fp, fn, n: samples by what was found right, too much and not at all in them."""
    per_sample = samples.select("sample").join(E.counts(matched, "sample"), "sample", "left").fillna(0, ["tp", "fp", "fn"])
    return per_sample.groupBy("tp", "fp", "fn").agg(F.count("*").alias("n"))


def replicate_sums(groups: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """replicate, tp, fp, fn over all outcomes; each task sends one row per replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((replicates, 3), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                outcome = (row["tp"], row["fp"], row["fn"])
                if any(outcome):
                    sums += draws(seed, outcome, row["n"], replicates)[:, None] * np.array(outcome)
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_pydict({"replicate": some, "tp": sums[some, 0], "fp": sums[some, 1], "fn": sums[some, 2]})

    drawn = groups.select(*[F.col(c).cast("long") for c in ("tp", "fp", "fn", "n")]).mapInArrow(run, "replicate long, tp long, fp long, fn long")
    every = groups.sparkSession.range(replicates).select(F.col("id").alias("replicate"), *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return drawn.union(every).groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def bootstrap(samples: DataFrame, matched: DataFrame, replicates: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """metric, point, lower, upper for precision, recall and F1; an empty table gives zeros."""
    sums = replicate_sums(outcomes(samples, matched), replicates, seed)
    return E.percentile_interval(E.with_prf(sums), E.micro(matched), replicates, level)
