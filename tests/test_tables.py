"""Verdicts, store, graph, campaigns, evaluation, prediction on small tables."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from beaconry.operators import campaigns as P
from beaconry.operators import communities as M
from beaconry.operators import evaluate as E
from beaconry.operators import graph as G
from beaconry.operators import predict as T
from beaconry.operators import store as S
from beaconry.operators import summaries as U
from beaconry.operators import verify as Y
from beaconry.sources import feeds as D

T0 = dt.datetime(2024, 1, 1)
MENTION = "context_id string, place int, ioc string, type string, confidence double, feed string, seen_at timestamp"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("pattern, verdict, valid, reliability, want", [
    (0.8, None, True, 0.5, 0.8), (0.8, 0.9, True, 1.0, 0.86), (0.8, 0.9, False, 1.0, 0.38), (1.0, 1.0, True, 0.5, 0.5),
])
def test_fusion(spark, pattern, verdict, valid, reliability, want):
    got = one(spark, Y.fuse_with_penalty(F.lit(pattern), F.lit(verdict).cast("double"), F.lit(valid), F.lit(reliability)))
    assert got == pytest.approx(want)


def test_fusion_weights():
    with pytest.raises(ValueError):
        Y.check_weights(0.5, 0.6)


@pytest.mark.parametrize("kind, conf, want", [("url", 0.9, "Critical"), ("ip", 0.85, "High"), ("cve", 0.3, "High"), ("ip", 0.3, "Low"), ("asn", 0.9, "Unknown")])
def test_severity(spark, kind, conf, want):
    assert one(spark, Y.severity(F.lit(kind), F.lit(conf))) == want


def test_node_fold_and_decay(spark):
    rows = [("a1", 1, "x", "ip", 0.6, "f", T0), ("a2", 1, "x", "ip", 0.7, "g", T0), ("a3", 1, "y", "ip", 1.0, "f", T0)]
    mentions = spark.createDataFrame(rows, MENTION)
    nodes = {r.id: r for r in G.nodes(mentions).collect()}
    assert nodes["x"].confidence == pytest.approx(0.88) and nodes["y"].confidence == 1.0
    later = G.decay_nodes(G.nodes(mentions), F.lit(T0 + dt.timedelta(days=30)))
    assert {r.id: r.confidence for r in later.collect()}["x"] == pytest.approx(0.44)


def test_update_is_idempotent_and_guards_pairs(spark):
    rows = [(f"a{d}", p, f"i{d}{p}", "ip", 0.5, "f", T0) for d, n in ((1, 3), (2, 6), (3, 1)) for p in range(n)]
    mentions = spark.createDataFrame(rows, MENTION)
    _, edges = G.update(mentions)
    _, again = G.update(mentions.union(mentions), edges)
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, again.select(edges.columns).collect()))
    assert edges.where("type = 'CO_OCCURS_WITH'").count() == 3


def cliques(spark):
    ips, names = [f"10.0.0.{i}" for i in range(4)], [f"d{i}.com" for i in range(3)]
    pairs = [(a, b, 0.5) for group in (ips, names) for i, a in enumerate(group) for b in group[i + 1 :]]
    nodes = spark.createDataFrame([(n,) for n in ips + names + ["alone"]], "id string")
    return nodes, spark.createDataFrame(pairs, "a string, b string, w double"), set(ips), set(names)


def partition(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r[1], set()).add(r[0])
    return {frozenset(g) for g in groups.values()}


def test_components(spark):
    nodes, edges, ips, names = cliques(spark)
    assert partition(M.components(nodes, edges)) == {frozenset(ips), frozenset(names), frozenset({"alone"})}


def test_communities_split_bridged_cliques(spark):
    nodes, edges, ips, names = cliques(spark)
    bridged = edges.union(spark.createDataFrame([("10.0.0.0", "d0.com", 0.1)], edges.schema))
    found = M.louvain(nodes, bridged)
    assert partition(found) == {frozenset(ips), frozenset(names), frozenset({"alone"})}
    assert M.modularity(bridged, found.where("id <> 'alone'")) > 0.4


def test_campaign_rows(spark):
    rows = [("c", f"n{i}", "ip" if i < 3 else "url", 0.5, T0, T0 + dt.timedelta(hours=i)) for i in range(4)]
    members = spark.createDataFrame(rows, "community string, id string, type string, confidence double, first_seen timestamp, last_seen timestamp")
    got = P.enrich(members, F.lit(T0)).first()
    assert got.label == "IP Campaign 2024-01-01" and got.duration_hours == 3.0
    assert got.severity_distribution == {"Medium": 3, "High": 1} and len(got.campaign_id) == len("campaign_") + 16


def test_metrics(spark):
    want = spark.createDataFrame([(1, "A", "ip"), (1, "b", "url"), (2, "c", "ip")], "sample int, value string, type string")
    got = spark.createDataFrame([(1, " a ", "IP", 0.9), (2, "z", "ip", 0.3), (2, "z", "ip", 0.3)], "sample int, value string, type string, confidence double")
    m = E.match(want, got)
    r = E.micro(m).first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 2)
    assert r.precision == 0.5 and r.recall == pytest.approx(1 / 3)
    samples = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "sample int, category string")
    assert E.true_negatives(samples, m).first().tn == 1


def test_bootstrap_is_tight_on_perfect_data(spark):
    want = spark.createDataFrame([(i, f"v{i}", "ip") for i in range(30)], "sample int, value string, type string")
    got = want.withColumn("confidence", F.lit(0.9))
    samples = want.select("sample")
    rows = E.bootstrap(samples, E.match(want, got), replicates=50).collect()
    assert all(r.lower == r.upper == r.point == 1.0 for r in rows)


def test_timing_stats(spark):
    rows = spark.createDataFrame([("s", float(i)) for i in range(1, 101)], "stage string, ms double")
    r = E.timing_stats(rows).first()
    assert (r.n, r.p95, r.p99, r.median) == (100, 96.0, 100.0, 50.5)


def test_profile_without_graph(spark):
    rows = [("c", f"n{i}", "domain", 0.5, T0, T0) for i in range(3)]
    members = spark.createDataFrame(rows, "community string, id string, type string, confidence double, first_seen timestamp, last_seen timestamp")
    none = spark.createDataFrame([], "campaign_id string, seed string, hop int, neighbour string")
    text = T.profile(P.enrich(members, F.lit(T0)), none).first().profile
    assert text.split("\n")[0] == "Campaign: DOMAIN Campaign 2024-01-01" and "IOC types: domain: 3" in text
    assert text.endswith("No known graph connections for this campaign") and "Duration" not in text


def test_next_stages_clip_at_the_end(spark):
    rows = spark.createDataFrame([("k", "Exfiltration")], "key string, stage string")
    got = [(r.tactic, r.confidence) for r in T.next_stages(rows, "key", "stage").orderBy("step").collect()]
    assert got == [("Impact", 0.6), ("Impact", 0.4), ("Impact", 0.3)]


def test_verdict_replies(spark):
    raw = ['{"is_valid_ioc": false, "confidence": 1.7, "reasoning": "a {b} c"}', "<think>{}</think>none", "```json\n{\"confidence\": 0.2}\n```"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "id int, raw_reply string")
    got = {r.id: (r.is_valid, r.confidence, r.verified) for r in Y.parse_verdicts(rows).collect()}
    assert got == {0: (False, 1.0, True), 1: (True, 0.5, False), 2: (True, 0.2, True)}


def test_store_and_files(spark, tmp_path):
    row = ("f", "x", "ip", "High", 0.5, None, None, None, None, None, T0, "u")
    batch = spark.createDataFrame([row], "feed string, ioc string, type string, severity string, confidence double, fused_confidence double, "
                                  "verdict_confidence double, verified boolean, reasoning string, deobfuscated boolean, timestamp timestamp, source_url string")
    got = S.upsert_iocs(None, batch, F.lit(T0))
    assert got.first().fused_confidence == 0.5 and got.first().verified is False
    for fmt in ("csv", "json", "parquet"):
        D.write_iocs(got, f"{tmp_path}/{fmt}", fmt)
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == D.IOC_COLUMNS
    nodes = spark.createDataFrame([("a",)], "id string")
    D.save_graph(nodes, nodes, f"{tmp_path}/g")
    assert D.load_graph(spark, f"{tmp_path}/g")[0].collect() == nodes.collect()
    with pytest.raises(ValueError):
        D.load_graph(spark, f"{tmp_path}/g", "2.0")


def test_recommendations(spark):
    text = "intro\nRecommended:\n1. Block the host now\n- short\nno bullet line here\n• Review all the logs"
    assert one(spark, U.recommendations(F.lit(text))) == ["Block the host now", "Review all the logs"]


def test_registry_is_consistent():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and entry.FLAGSHIP in names and len(names) > 150


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from beaconry.functions.lineage import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default)))
