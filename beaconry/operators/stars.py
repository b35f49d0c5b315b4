"""Communities over the star of indicators and contexts.

Indicators that are named together are tied through their contexts: every mention is
one edge between an indicator and its context, and modularity is optimized on this
two-sided graph. A context of any size therefore costs as many edges as it has
indicators, where pairs would be quadratic in it.

By default an indicator's mentions share a weight of one. An indicator named
everywhere then ties nothing: at resolution 1 its pull on a group falls as the number
of groups grows, just as the expected weight does, so the same resolution serves
graphs of every size.

Mentions without an indicator or context are left out; a repeated mention counts once;
an empty table gives an empty membership.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.functions.lineage import cut
from beaconry.operators import communities


def star_edges(mentions: DataFrame, shared: bool = True) -> DataFrame:
    """a (indicator), b (context), w of mentions (ioc, context_id). Names of both sides are kept apart."""
    once = mentions.select("ioc", "context_id").where("ioc is not null and context_id is not null").distinct()
    if shared:
        share = once.groupBy("ioc").agg((1 / F.count("*")).alias("w"))
        once = once.join(share, "ioc")
    else:
        once = once.withColumn("w", F.lit(1.0))
    return once.select(F.concat(F.lit("i:"), F.col("ioc")).alias("a"), F.concat(F.lit("c:"), F.col("context_id").cast("string")).alias("b"), "w")


def membership(mentions: DataFrame, resolution: float = 1.0, shared: bool = True) -> DataFrame:
    """id, community (its smallest indicator) of every mentioned indicator."""
    edges = cut(star_edges(mentions, shared))
    found = communities.louvain(edges.select(F.col("a").alias("id")).distinct(), edges, resolution)
    found = cut(found.select(F.expr("substr(id, 3)").alias("id"), F.col("community").alias("_c")))
    names = found.groupBy("_c").agg(F.min("id").alias("community"))
    return found.join(names, "_c").select("id", "community")


def star_modularity(mentions: DataFrame, groups: DataFrame, resolution: float = 1.0, shared: bool = True) -> float:
    """Modularity of the partition ``groups`` (id, community) on the star; a context goes to
    the community that holds most of its weight (ties: the smallest name)."""
    edges = star_edges(mentions, shared)
    sides = groups.select(F.concat(F.lit("i:"), F.col("id")).alias("id"), "community")
    pull = edges.join(sides, edges.a == sides.id).groupBy("b", "community").agg(F.round(F.sum("w"), 9).alias("w"))
    contexts = pull.groupBy(F.col("b").alias("id")).agg(F.min_by("community", F.struct((-F.col("w")).alias("w"), "community")).alias("community"))
    return communities.modularity(edges, cut(sides.union(contexts)), resolution)
