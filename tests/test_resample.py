"""Bootstrap by outcome: the law of its draws, agreement with draws per sample, cost without the samples."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.operators import evaluate as E
from beaconry.operators import resample as R


@pytest.mark.parametrize("n", [1, 40, 1_000_000_007])
def test_draws_are_poisson(n):
    found = R.draws(42, (1, 0, 0), n, 20_000)
    assert abs(found.mean() - n) < 5 * np.sqrt(n / 20_000) and abs(found.var() / n - 1) < 0.06
    assert (found == R.draws(42, (1, 0, 0), n, 20_000)).all() and (found != R.draws(42, (0, 1, 0), n, 20_000)).any()


def tables(spark, n):
    rows = spark.range(n).select(F.col("id").alias("sample"))
    outcome = F.when(F.col("sample") % 5 == 0, "fp").when(F.col("sample") % 7 == 0, "fn").otherwise("tp")
    matched = rows.where("sample % 11 <> 0").select("sample", F.lit("v").alias("value"), F.lit("ip").alias("type"), outcome.alias("outcome"))
    return rows, matched


def test_intervals_agree_with_draws_per_sample(spark):
    samples, matched = tables(spark, 3000)
    one = {r.metric: r for r in E.bootstrap(samples, matched, 400).collect()}
    two = {r.metric: r for r in R.bootstrap(samples, matched, 400).collect()}
    for metric, r in one.items():
        s = two[metric]
        assert s.point == r.point and s.lower < s.point < s.upper
        assert abs(s.lower - r.lower) < 0.006 and abs(s.upper - r.upper) < 0.006
    again = {r.metric: (r.lower, r.upper) for r in R.bootstrap(samples.repartition(5), matched.repartition(3), 400).collect()}
    assert again == {m: (r.lower, r.upper) for m, r in two.items()}


def test_rows_are_outcomes(spark):
    assert R.outcomes(*tables(spark, 2000)).count() == R.outcomes(*tables(spark, 6000)).count() == 4
    empty = R.bootstrap(*(df.limit(0) for df in tables(spark, 5)), 20).collect()
    assert {(r.metric, r.point, r.lower, r.upper) for r in empty} <= {(m, 0.0, 0.0, 0.0) for m in ("precision", "recall", "f1")}
