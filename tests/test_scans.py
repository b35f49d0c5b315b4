"""Running sums and order statistics over many partitions against one window, with one hot key."""
import random

from pyspark.sql import functions as F

from beaconry.operators import evaluate as E
from beaconry.operators import scans as SC
from beaconry.operators import store as S


def log(n=600):
    draw = random.Random(2)
    return [("hot" if i % 3 else draw.choice(["a", "b", None]), i, draw.random() < 0.4) for i in range(n)]


def test_running_sum(spark):
    rows = log()
    table = spark.createDataFrame(rows, "job string, seq long, ok boolean")
    want, sums = {}, {}
    for job, seq, ok in rows:
        sums[job] = sums.get(job, 0) + ok
        want[job, seq] = sums[job]
    for size in (37, 10**6):
        got = SC.running_sum(table, "job", "seq", F.col("ok").cast("int"), "n", size)
        assert got.columns == ["job", "seq", "ok", "n"] and {(r.job, r.seq): r.n for r in got.collect()} == want
    assert SC.running_sum(table.limit(0), "job", "seq", F.lit(1), "n").collect() == []


def test_streaks_equal_window(spark):
    table = spark.createDataFrame([r for r in log() if r[0]], "job string, seq long, ok boolean")
    assert sorted(SC.failure_streaks(table, 3, 50).collect()) == sorted(S.failure_streaks(table, 3).collect())


def test_hot_key_is_spread(spark):
    """A key with two thirds of the rows: no partition of the first pass holds more than a few hundred."""
    table = spark.createDataFrame(log(6000), "job string, seq long, ok boolean")
    dealt = table.repartitionByRange(-(-6000 // 300), "job", "seq").withColumn("p", F.spark_partition_id())
    sizes = [r["count"] for r in dealt.groupBy("p").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 900
    assert dealt.where("job = 'hot'").select("p").distinct().count() > 6


def test_timing_stats_equal(spark):
    draw = random.Random(5)
    rows = [("s" if i % 4 else "t", draw.choice([draw.random() * 100, float(draw.randrange(5))])) for i in range(501)] + [("one", 3.0)]
    table = spark.createDataFrame(rows, "stage string, ms double")
    shown = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*E.timing_stats(table).columns).collect())
    assert shown(SC.timing_stats(table, 40)) == shown(E.timing_stats(table))
