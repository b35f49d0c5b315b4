"""Connected components and modularity communities as DataFrame jobs."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.functions.lineage import cut


def project(node_table: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected indicator-only edges (a < b, w); parallel edges are summed and a
    missing weight counts .5. Self-loops are kept."""
    keep = node_table.where(F.lower("type") != "context").select("id")
    inner = edges.join(keep.toDF("src"), "src", "left_semi").join(keep.toDF("dst"), "dst", "left_semi")
    return inner.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.sum(F.coalesce("weight", F.lit(0.5))).alias("w")
    )


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return tuple(row)


def components(node_table: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """id, component (= smallest id in it), by alternating large-star and
    small-star steps: each round links nodes to smaller representatives until
    every component is a star. Hub nodes only ever meet a minimum aggregate and
    an equi-join, which adaptive execution can split."""
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = cut(links)
    seen = _fingerprint(links)
    for _ in range(max_rounds):
        both = links.select("u", "v").union(links.select(F.col("v"), F.col("u")))
        lowest = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(lowest, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        base = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(base, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.union(base.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = _fingerprint(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = links.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return node_table.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def _symmetric(edges: DataFrame) -> DataFrame:
    """Both directions; a self-loop (a contracted community) counts twice."""
    loops = edges.where("a = b").select("a", "b", (2 * F.col("w")).alias("w"))
    rest = edges.where("a <> b")
    return rest.select("a", "b", "w").union(rest.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).union(loops)


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> float:
    """Q of a partition; ``edges`` are undirected (a, b, w)."""
    links = _symmetric(edges)
    ma, mb = membership.toDF("a", "ca"), membership.toDF("b", "cb")
    joined = links.join(ma, "a").join(mb, "b")
    per = joined.groupBy(F.col("ca").alias("c")).agg(
        F.sum("w").alias("tot"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside")
    )
    total = F.sum("tot")
    row = per.agg(total.alias("m2"), F.sum("inside").alias("i"), F.sum(F.col("tot") * F.col("tot")).alias("s")).first()
    if not row.m2:
        return 0.0
    return row.i / row.m2 - resolution * row.s / (row.m2 * row.m2)


def _move(edges: DataFrame, total: float, resolution: float, most_rounds: int = 200) -> DataFrame:
    """Local moving phase: id, community.

    All nodes pick their best neighbouring community at once. Rounds alternate
    between moves to smaller and to larger names, so two nodes never swap places,
    and from the fourth pair of rounds on a hash lets only half of the nodes move,
    which ends longer cycles. Two quiet full rounds end the phase; a phase that finds
    no rest raises instead of returning a half-settled partition.
    """
    links = cut(_symmetric(edges))
    strength = links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    between = links.where("a <> b")
    state = cut(strength.select("id", "k", F.col("id").alias("c")))
    quiet = 0
    for turn in range(most_rounds):
        volume = state.groupBy(F.col("c").alias("to")).agg(F.sum("k").alias("vol"))
        # the current community is always an option, with whatever weight leads into it
        toward = between.join(state.select(F.col("id").alias("b"), F.col("c").alias("to")), "b").select(F.col("a").alias("id"), "to", "w")
        options = toward.union(state.select("id", F.col("c").alias("to"), F.lit(0.0).alias("w")))
        scored = options.groupBy("id", "to").agg(F.sum("w").alias("w_to")).join(volume, "to").join(state, "id")
        own = F.col("to") == F.col("c")
        others = F.col("vol") - F.when(own, F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w_to") - F.lit(resolution / total) * F.col("k") * others, 9)
        allowed = own | ((F.col("to") < F.col("c")) == F.lit(turn % 2 == 0))
        if turn >= 8 and quiet == 0:
            allowed = own | (allowed & (F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0))
        # highest gain; ties: stay, then the smaller name
        best = scored.where(allowed).groupBy("id").agg(
            F.first("k").alias("k"), F.first("c").alias("c"), F.min_by("to", F.struct((-gain).alias("g"), (~own).alias("o"), "to")).alias("to")
        )
        moved = cut(best.select("id", "k", F.col("to").alias("c"), (F.col("to") != F.col("c")).alias("moved")))
        quiet = 0 if moved.where("moved").limit(1).count() else quiet + 1
        state = moved.drop("moved")
        if quiet == 3:
            return state.select("id", F.col("c").alias("community"))
    raise RuntimeError(f"communities did not settle within {most_rounds} rounds")


def _levels(edges: DataFrame, total: float, resolution: float) -> DataFrame:
    level = cut(edges.select("a", "b", "w"))
    ends = level.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    membership = cut(ends.select("id", F.col("id").alias("community")))
    best = modularity(level, membership, resolution)
    while not level.where("a <> b").isEmpty():  # each level has fewer nodes than the last
        step = _move(level, total, resolution)
        quality = modularity(level, step, resolution)
        if quality <= best + 1e-9:
            break
        best = quality
        membership = cut(
            membership.join(step.toDF("community", "_next"), "community", "left")
            .select("id", F.coalesce("_next", "community").alias("community"))
        )
        level = cut(
            level.join(step.toDF("a", "ca"), "a").join(step.toDF("b", "cb"), "b")
            .groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))
        )
    return membership


def louvain(node_table: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """id, community: a modularity partition of an undirected weighted graph.

    One path for graphs of every size: distributed local moves until nobody moves,
    then contraction of the communities, until a level no longer raises the
    modularity. Isolated nodes form their own community.
    """
    edges = cut(edges.select("a", "b", "w"))
    total = edges.agg(2 * F.sum("w")).first()[0]
    alone = node_table.select("id", F.col("id").alias("_self"))
    if not total:
        return alone.withColumnRenamed("_self", "community")
    found = _levels(edges, total, resolution)
    return alone.join(found, "id", "left").select("id", F.coalesce("community", "_self").alias("community"))
