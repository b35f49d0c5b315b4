"""The weighted indicator graph: nodes, edges, decay, ranking, neighbourhoods.

Input rows ("mentions") are normalized indicators: context_id, place, ioc, type,
confidence, feed, seen_at; one row per context and indicator. Every fold is a pure
function of the mentions, so ingesting the same report again changes nothing.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions.columns import hours_between

CAP = 0.999
CO_WEIGHT = 0.5
MAX_PAIRED = 5
#: Indicators of one context that are paired together, about.
PAIR_BLOCK = 256
SCHEMA_VERSION = "1.0"


def _once(mentions: DataFrame) -> DataFrame:
    """One row per (context, indicator); the earliest wins."""
    rest = [c for c in mentions.columns if c not in ("context_id", "ioc")]
    best = F.min_by(F.struct(*rest), F.struct("seen_at", "place")).alias("r")
    return mentions.groupBy("context_id", "ioc").agg(best).select("context_id", "ioc", *[F.col(f"r.{c}").alias(c) for c in rest])


def _fused(count: Column, miss: Column, single: Column) -> Column:
    """1 - prod(1 - p), capped once there is more than one mention."""
    return F.when(count == 1, single).otherwise(F.least(F.lit(CAP), 1.0 - miss))


def fold_nodes(mentions: DataFrame) -> DataFrame:
    """Indicator nodes. All aggregates combine partially on the map side, so an
    indicator mentioned in a third of all reports costs no more than others."""
    return mentions.groupBy(F.col("ioc").alias("id")).agg(
        F.max_by("type", F.struct("seen_at", "context_id")).alias("type"),
        _fused(F.count("*"), F.product(1.0 - F.col("confidence")), F.max("confidence")).alias("confidence"),
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
    )


def provenance(mentions: DataFrame) -> DataFrame:
    """Distinct feeds per node in first-seen order. Reduced to one row per
    (node, feed) first, so the collected list has at most one entry per feed."""
    firsts = mentions.groupBy("ioc", "feed").agg(F.min("seen_at").alias("at"))
    return firsts.groupBy(F.col("ioc").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "feed"))), lambda r: r["feed"]).alias("provenance")
    )


def context_nodes(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy(F.col("context_id").alias("id")).agg(
        F.lit("context").alias("type"), F.lit(0.1).alias("confidence"),
        F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"),
    )


def nodes(mentions: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """All nodes, with the reviewed flag merged in."""
    out = fold_nodes(mentions).unionByName(context_nodes(mentions))
    return with_reviewed(out, reviewed)


def with_reviewed(node_table: DataFrame, reviewed: DataFrame | None) -> DataFrame:
    if reviewed is None:
        return node_table.withColumn("reviewed", F.lit(False))
    flags = reviewed.select("id", F.col("reviewed").alias("_flag"))
    return node_table.join(flags, "id", "left").withColumn("reviewed", F.coalesce("_flag", F.lit(False))).drop("_flag")


def mention_edges(mentions: DataFrame, chunk: str = "hour") -> DataFrame:
    """indicator -> context edges; the weight is the node confidence so far.

    A plain running window would put all mentions of one indicator in one task.
    Instead the running product is cut into time chunks: chunk totals are
    aggregated, their (short) running product is joined back, and only rows of
    one indicator and one chunk are ordered together.
    """
    rows = mentions.withColumn("_chunk", F.date_trunc(chunk, "seen_at"))
    totals = rows.groupBy("ioc", "_chunk").agg(F.product(1.0 - F.col("confidence")).alias("_total"))
    before = Window.partitionBy("ioc").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("ioc", "_chunk", F.product("_total").over(before).alias("_before"))
    inside = Window.partitionBy("ioc", "_chunk").orderBy("seen_at", "context_id")
    running = rows.join(totals, ["ioc", "_chunk"]).select(
        "*",
        F.product(1.0 - F.col("confidence")).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_inside"),
        F.row_number().over(inside).alias("_n"),
    )
    first = F.col("_before").isNull() & (F.col("_n") == 1)
    miss = F.coalesce("_before", F.lit(1.0)) * F.col("_inside")
    weight = F.when(first, F.col("confidence")).otherwise(F.least(F.lit(CAP), 1.0 - miss))
    return running.select(
        F.col("ioc").alias("src"), F.col("context_id").alias("dst"), F.lit("MENTIONED_IN").alias("type"),
        weight.alias("weight"), "context_id", F.col("seen_at").alias("timestamp"),
    )


def pair_groups(mentions: DataFrame, max_paired: int | None = None) -> DataFrame:
    """The indicators of each context that has two or more (and ``max_paired`` at most), in
    blocks of about PAIR_BLOCK: what all pairs are made of, in as many entries as mentions."""
    n = F.col("_n")
    wanted = n > 1 if max_paired is None else n.between(2, max_paired)
    sized = mentions.groupBy("context_id").agg(F.count("*").alias("_n")).where(wanted)
    sized = sized.select("context_id", F.ceil(n / PAIR_BLOCK).cast("int").alias("blocks"))
    dealt = mentions.join(sized, "context_id").withColumn("block", F.pmod(F.xxhash64("ioc"), F.col("blocks")).cast("int"))
    return dealt.groupBy("context_id", "blocks", "block").agg(F.sort_array(F.collect_list(F.struct("place", "ioc", "seen_at"))).alias("members"))


def paired(groups: DataFrame) -> DataFrame:
    """Co-occurrence edges of ``pair_groups``, in order of appearance. A row makes the pairs of
    one or two blocks, so a context of any size is many tasks' work and no task's memory."""
    one = groups.where("blocks = 1").select("context_id", "members", F.posexplode("members").alias("at", "a")).select(
        "context_id", "a", F.explode(F.expr("slice(members, at + 2, size(members))")).alias("b")
    ).where("a.place < b.place")
    some = groups.where("blocks > 1")
    left = some.select("context_id", "block", F.col("members").alias("firsts"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("other"))
    both = left.join(some.select("context_id", F.col("block").alias("other"), "members"), ["context_id", "other"])
    met = both.select("context_id", "block", "other", "members", F.explode("firsts").alias("a")).select(
        "context_id", "block", "other", "a", F.explode("members").alias("b")
    ).where("a.place < b.place or (block < other and a.place > b.place)")
    rise = F.col("a.place") < F.col("b.place")
    met = met.select("context_id", F.when(rise, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(rise, F.col("b")).otherwise(F.col("a")).alias("b"))
    return one.union(met).select(
        F.col("a.ioc").alias("src"), F.col("b.ioc").alias("dst"), F.lit("CO_OCCURS_WITH").alias("type"), F.lit(CO_WEIGHT).alias("weight"),
        "context_id", F.col("a.seen_at").alias("timestamp"),
    )


def pair_edges(mentions: DataFrame, max_paired: int | None = MAX_PAIRED) -> DataFrame:
    """Co-occurrence edges, in order of appearance, for contexts with two to
    ``max_paired`` indicators (None: any number). With a limit the count decides before
    any pair is formed, so a context yields at most a fixed number of pairs."""
    if max_paired is None:
        return paired(pair_groups(mentions))
    small = (
        mentions.groupBy("context_id").agg(F.count("*").alias("_n"))
        .where(F.col("_n").between(2, max_paired)).select("context_id")
    )
    few = mentions.join(small, "context_id", "left_semi")
    a = few.select("context_id", F.col("ioc").alias("src"), F.col("place").alias("_a"), F.col("seen_at").alias("timestamp"))
    b = few.select("context_id", F.col("ioc").alias("dst"), F.col("place").alias("_b"))
    return a.join(b, "context_id").where(F.col("_a") < F.col("_b")).select(
        "src", "dst", F.lit("CO_OCCURS_WITH").alias("type"), F.lit(CO_WEIGHT).alias("weight"), "context_id", "timestamp"
    )


def insert_edges(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Edges keyed by (src, dst, type:context); the first weight wins."""
    rows = new.withColumn("edge_key", F.concat_ws(":", "type", "context_id")).withColumn("_new", F.lit(1))
    if existing is not None:
        rows = rows.unionByName(existing.withColumn("_new", F.lit(0)))
    rest = ["type", "weight", "context_id", "timestamp"]
    first = F.min_by(F.struct(*rest), F.struct("_new", "timestamp", "weight")).alias("r")
    return rows.groupBy("src", "dst", "edge_key").agg(first).select("src", "dst", "edge_key", *[F.col(f"r.{c}").alias(c) for c in rest])


def update(mentions: DataFrame, edges: DataFrame | None = None, reviewed: DataFrame | None = None):
    """Nodes and edges of the whole mention log, as a new snapshot."""
    once = _once(mentions)
    new_edges = mention_edges(once).unionByName(pair_edges(once))
    return nodes(once, reviewed), insert_edges(edges, new_edges)


# --- decay ------------------------------------------------------------------
def _decay_factor(since: Column, as_of: Column, half_life_days: float) -> Column:
    return F.pow(F.lit(0.5), hours_between(since, as_of) / F.lit(half_life_days * 24.0))


def decay_nodes(node_table: DataFrame, as_of: Column, half_life_days: float = 30) -> DataFrame:
    """Confidence as of a time; context and reviewed nodes keep theirs. Computed
    from the folded value each time, never written back."""
    kept = (F.col("type") == "context") | F.col("reviewed") | F.col("last_seen").isNull()
    faded = F.greatest(F.lit(0.01), F.col("confidence") * _decay_factor(F.col("last_seen"), as_of, half_life_days))
    return node_table.withColumn("confidence", F.when(kept, F.col("confidence")).otherwise(faded))


def decay_edges(edges: DataFrame, node_table: DataFrame, as_of: Column, half_life_days: float = 30) -> DataFrame:
    """Edge weights as of a time; edges that touch a context node keep theirs."""
    contexts = node_table.where(F.col("type") == "context").select(F.col("id"), F.lit(True).alias("_ctx"))
    joined = edges.join(contexts.toDF("src", "_s"), "src", "left").join(contexts.toDF("dst", "_d"), "dst", "left")
    kept = F.coalesce("_s", "_d", F.lit(False)) | F.col("timestamp").isNull()
    faded = F.col("weight") * _decay_factor(F.col("timestamp"), as_of, half_life_days)
    return joined.withColumn("weight", F.when(kept, F.col("weight")).otherwise(faded)).drop("_s", "_d")


# --- reads ------------------------------------------------------------------
def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each node, parallel ones counted, in both directions."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def top_nodes(node_table: DataFrame, edges: DataFrame, n: int = 100) -> DataFrame:
    """Best nodes by confidence squared times log(1 + degree); contexts excluded."""
    ranked = node_table.where(F.col("type") != "context").join(degrees(edges), "id", "left")
    score = F.col("confidence") * F.col("confidence") * F.log1p(F.coalesce("degree", F.lit(0)))
    return ranked.withColumn("score", score).orderBy(F.desc("score"), "id").limit(n)


def _inside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")


def display_subgraph(node_table: DataFrame, edges: DataFrame, n: int = 300, min_confidence: float = 0.3):
    """Top nodes above a confidence, and the edges between them."""
    shown = top_nodes(node_table, edges, n).where(F.col("confidence") >= min_confidence)
    return shown, _inside(edges, shown.select("id"))


def display_filter(shown: DataFrame, inner: DataFrame, search: str = "", min_degree: int = 0):
    """Display degree inside a subgraph, text search and minimum degree, then the
    edges that still have both ends."""
    ranked = shown.drop("degree").join(degrees(inner), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    picked = ranked.where((F.col("degree") >= min_degree) & F.lower("id").contains(search.lower()))
    return picked, _inside(inner, picked.select("id"))


def symmetric(edges: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    return edges.select(F.explode(both).alias("e")).select("e.a", "e.b")


def neighbourhood(edges: DataFrame, node: Column | str, depth: int = 1):
    """Nodes within ``depth`` steps in either direction, and the induced edges."""
    node = node if isinstance(node, Column) else F.lit(node)
    links = symmetric(edges)
    reached = edges.sparkSession.range(1).select(node.alias("id"))
    layer = reached
    for _ in range(depth):
        layer = links.join(layer.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        reached = reached.union(layer).distinct()
    return reached, _inside(edges, reached)


def node_details(node_table: DataFrame, sources: DataFrame, ids: list[str]) -> DataFrame:
    return node_table.where(F.col("id").isin(ids)).join(sources, "id", "left").withColumn(
        "provenance", F.coalesce("provenance", F.array().cast("array<string>"))
    )


def stats(node_table: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts, directed density and a histogram of node types."""
    by_type = node_table.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))
    totals = node_table.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))
    pairs = F.col("nodes").cast("double") * (F.col("nodes") - 1)
    density = F.when(F.col("nodes") > 1, F.round(F.col("edges") / pairs, 6)).otherwise(F.lit(0.0))
    return by_type.crossJoin(totals.withColumn("density", density))  # totals is one row
