"""Ingest cycles against the batch operators: late, repeated and divided reports, replays, bounded rewriting."""
import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from beaconry.operators import graph as G
from beaconry.operators import store as S
from beaconry.operators.incremental import Tables

START = datetime.datetime(2024, 1, 1)
ROW = "ioc string, type string, severity string, fused_confidence double, feed string, timestamp timestamp, confidence double, verified boolean, reasoning string, deobfuscated boolean"
MENTION = "context_id string, place int, ioc string, type string, confidence double, feed string, seen_at timestamp"


def as_of():
    return F.expr("timestamp '2024-02-01 00:00:00'")



def batch(spark, mentions):
    rows = [(m[2], m[3], "High", m[4], m[5], m[6], m[4], None, None, None) for m in mentions]
    return spark.createDataFrame(rows, ROW), spark.createDataFrame(mentions, MENTION)


def some_mentions(seed, contexts, names):
    draw = random.Random(seed)
    out = []
    for c in contexts:
        at = START + datetime.timedelta(minutes=draw.randrange(5000))  # any order of time over the batches
        for place, name in enumerate(draw.sample(names, draw.randrange(1, 8))):
            out.append((f"art-{c}", place, name, "ip", draw.randrange(30, 90) / 100, f"f{c % 3}", at))
    return out


def rounded(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


def expected(spark, mentions):
    rows, log = batch(spark, mentions)
    nodes, edges = G.update(log)
    columns = ["src", "dst", "type", "context_id", "timestamp", "weight"]
    return (
        rounded(nodes.select("id", "type", "confidence", "first_seen", "last_seen").collect()), rounded(edges.select(*columns).collect()),
        rounded(S.upsert_iocs(None, rows, as_of()).select("ioc_id", "fused_confidence", "feed", "timestamp").collect()),
    )


def found(tables):
    nodes, edges = tables.graph()
    columns = ["src", "dst", "type", "context_id", "timestamp", "weight"]
    return (
        rounded(nodes.select("id", "type", "confidence", "first_seen", "last_seen").collect()), rounded(edges.select(*columns).collect()),
        rounded(tables.iocs().select("ioc_id", "fused_confidence", "feed", "timestamp").collect()),
    )


@pytest.fixture(scope="module")
def batches():
    names = [f"45.1.1.{i}" for i in range(25)]
    first, second, third = some_mentions(1, range(20), names), some_mentions(2, range(20, 40), names), some_mentions(3, range(40, 50), names)
    pieces = [("art-pieces", i, names[i], "ip", 0.5, "f1", START) for i in range(7)]
    # three indicators give pairs, seven none; the pairs of the first cycle must go
    return [first + pieces[:3], second + first[:15], third + pieces[3:], [(*first[0][:4], 0.9, "f9", START - datetime.timedelta(days=3))]]


def test_cycles_equal_batch(spark, tmp_path, batches):
    tables, seen = Tables(spark, str(tmp_path), 4, 1), []
    for epoch, mentions in enumerate(batches):
        seen += mentions
        tables.fold(*batch(spark, mentions), epoch, as_of())
        assert found(tables) == expected(spark, seen)
    # the last cycle again, as after a failure before its progress was noted
    tables.fold(*batch(spark, batches[-1]), len(batches) - 1, as_of())
    assert found(tables) == expected(spark, seen)
    assert tables.vacuum(keep=1) > 0 and found(tables) == expected(spark, seen)


def test_unfinished_cycle_is_unseen(spark, tmp_path, batches):
    tables = Tables(spark, str(tmp_path), 4, 1)
    tables.fold(*batch(spark, batches[0]), 0, as_of())
    versions = tables.versions(before=1)
    tables._fold_indicators(batch(spark, batches[1])[1], 1, versions)  # and no commit
    assert found(tables) == expected(spark, batches[0])
    tables.fold(*batch(spark, batches[1]), 1, as_of())
    assert found(tables) == expected(spark, batches[0] + batches[1])


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), 64, 1)
    many = [(f"art-{i}", 0, f"10.0.{i % 250}.{i}", "ip", 0.5, "f", START) for i in range(400)]
    tables.fold(*batch(spark, many), 0, as_of())
    one = [("art-new", 0, "10.0.7.7", "ip", 0.6, "f", START), ("art-new", 1, "10.9.9.9", "ip", 0.6, "f", START)]
    tables.fold(*batch(spark, one), 1, as_of())
    for table in ("iocs", "mentions", "nodes", "edges", "contexts", "context_nodes", "pairs"):
        size = lambda epoch: sum(
            os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / table / f"epoch={epoch}") for f in fs if f.endswith(".parquet"))
        touched = [d for d in os.listdir(tmp_path / table / "epoch=1") if d.startswith("bucket=")]
        assert 1 <= len(touched) <= 2
        assert table == "pairs" or size(1) < size(0) / 10


def test_nothing_arrives(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), 4)
    assert tables.iocs() is None and tables.graph() == (None, None)
    tables.fold(*batch(spark, [(f"a{i}", 0, "x", "ip", 0.5, "f", START) for i in range(2)]), 0, as_of())
    tables.fold(*(df.limit(0) for df in batch(spark, [("a", 0, "x", "ip", 0.5, "f", START)])), 1, as_of())
    assert tables.iocs().count() == 1
