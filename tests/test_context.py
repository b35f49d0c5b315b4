"""Bounded expansion and blocked nearest vectors against plain forms."""
import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.operators import context as X
from beaconry.operators import nearest as NV
from beaconry.operators import predict as P


@pytest.mark.parametrize("first", [1, 8])
def test_expand_equals_plain_steps(spark, first):
    draw = random.Random(first)
    names = [f"n{i:03d}" for i in range(60)]
    edges = [(draw.choice(names), draw.choice(names)) for _ in range(90)] + [("hub", n) for n in names[:40]] + [("n001", "n001"), ("n001", "n002"), ("n002", "n001")]
    table = spark.createDataFrame(edges, "src string, dst string")
    starts = spark.createDataFrame([(n,) for n in names[:30] + ["hub", "unknown", "n000"]], "seed string")
    for keep in (3, 15):
        got = sorted(map(tuple, X.expand(table, starts, keep, first).collect()))
        assert got == sorted(map(tuple, P.multi_hop(table.where("src <> dst"), starts, 2, keep).collect()))


def test_hub_adds_a_short_list(spark):
    """Every seed names the hub; what is looked up per node is bounded."""
    hub = spark.range(2000).select(F.lit("hub").alias("a"), F.format_string("n%05d", "id").alias("b"))
    listed = X._first_neighbours(hub, spark.createDataFrame([("hub",)], "node string"), 30).collect()
    assert [(len(r["names"]), r["more"]) for r in listed] == [(30, True)]


def test_nearest_blocks(spark):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-3, 4, (120, 5)).astype(float).tolist()  # many ties
    rows = [(i, v) for i, v in enumerate(vectors)] + [(200, None), (201, [None] * 5), (202, [1.0, 2.0]), (203, [1e8, 0.0, 0.0, 0.0, 0.0]), (204, [1e8 + 1, 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = table.where("id % 20 = 0 or id > 150").withColumnRenamed("id", "query_id")
    want = []
    for q, x in rows:
        if (q % 20 == 0 or q > 150) and x and None not in x:
            near = sorted((functools.reduce(lambda t, p: t + (p[0] - p[1]) ** 2, zip(x, v), 0.0), i) for i, v in rows if v and None not in v and len(v) == len(x))[:7]
            want += [(q, i, r) for r, (_, i) in enumerate(near, 1)]
    for blocks in ((4096, 16384), (3, 11)):
        found = NV.nearest(queries, table, 7, query_block=blocks[0], vector_block=blocks[1])
        assert sorted((r.query_id, r.id, r["rank"]) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Cross" not in plan
