"""Campaign context rows: bounded graph expansion, technique lines, and the row that joins them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions.lineage import cut
from beaconry.operators import graph as G
from beaconry.operators import predict as P


def _first_neighbours(links: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """node, names (its first ``n`` neighbours by name), more (whether there are others).
    Each map task keeps n + 1 rows a node, so a hub's edges meet nowhere."""
    order = Window.partitionBy("a").orderBy("b")
    few = links.join(nodes.toDF("a"), "a", "left_semi").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n + 1)
    listed = few.groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("_b"))
    return listed.select(F.col("a").alias("node"), F.slice("_b", 1, n).alias("names"), (F.size("_b") > n).alias("more"))


def expand(edges: DataFrame, starts: DataFrame, keep: int = P.MAX_PER_HOP, first: int | None = None) -> DataFrame:
    """seed, hop, neighbour: the first ``keep`` nodes by name at one and at two steps from
    each seed, in either direction; the rows of ``predict.multi_hop`` with two hops.

    Seeds meet their own edges once. The nodes they reach are looked up as *distinct*
    nodes in an index of each node's first ``first`` neighbours, and seeds are joined to
    these short lists last, so a hub that every seed names adds a short list a seed, not
    all its neighbours. A seed is settled when no list that was cut could hide a name
    before its last one; the others go round again with lists twice as long.
    """
    links = cut(G.symmetric(edges).where("a <> b").distinct())
    seeds = starts.select("seed").distinct()
    near = cut(links.join(seeds.withColumnRenamed("seed", "a"), "a").select(F.col("a").alias("seed"), F.col("b").alias("node")))
    rank = Window.partitionBy("seed").orderBy("neighbour")
    pick = lambda df: df.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= keep)
    out = pick(near.select("seed", F.lit(1).alias("hop"), F.col("node").alias("neighbour"))).drop("_r")
    open_, length = near, first or 2 * keep
    while True:
        index = _first_neighbours(links, open_.select("node").distinct(), length)
        lists = cut(open_.join(index, "node"))
        reached = lists.select("seed", F.explode("names").alias("neighbour")).where("neighbour <> seed").distinct()
        fresh = reached.join(open_.withColumnRenamed("node", "neighbour"), ["seed", "neighbour"], "left_anti")
        found = pick(fresh)
        # names up to the shortest end of a cut list are complete
        ends = lists.where("more").groupBy("seed").agg(F.min(F.element_at("names", -1)).alias("end"))
        state = found.groupBy("seed").agg(F.count("*").alias("n"), F.max("neighbour").alias("last"))
        waiting = cut(ends.join(state, "seed", "left").where(~((F.coalesce("n", F.lit(0)) == keep) & (F.col("last") <= F.col("end")))).select("seed"))
        settled = found.join(waiting, "seed", "left_anti").select("seed", F.lit(2).alias("hop"), "neighbour")
        out = out.union(cut(settled))
        if waiting.isEmpty():
            return out
        open_, length = cut(open_.join(waiting, "seed", "left_semi")), 2 * length


def technique_lines(found: DataFrame, techniques: DataFrame, most: int = 5) -> DataFrame:
    """query_id, technique_context: one line for each of a query's first techniques.
    ``found``: query_id, id, rank."""
    tactics = F.array_join("tactics", ", ")
    line = F.concat(F.lit("- "), "id", F.lit(" "), "name", F.lit(" (Tactics: "), tactics, F.lit("): "), F.left(F.coalesce("description", F.lit("")), F.lit(200)))
    rows = found.where(F.col("rank") <= most).join(techniques, "id").select("query_id", F.struct("rank", line.alias("line")).alias("x"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("technique_context"))


def graph_lines(neighbours: DataFrame, seeds: int = 10, each: int = 5) -> DataFrame:
    """campaign_id, graph_context: a line for each of the first seeds with direct neighbours."""
    direct = neighbours.where("hop = 1")
    by_name = Window.partitionBy("campaign_id", "seed").orderBy("neighbour")
    few = direct.withColumn("_r", F.row_number().over(by_name)).where(F.col("_r") <= each)
    lines = few.groupBy("campaign_id", "seed").agg(F.array_sort(F.collect_list("neighbour")).alias("n"))
    lines = lines.withColumn("_r", F.row_number().over(Window.partitionBy("campaign_id").orderBy("seed"))).where(F.col("_r") <= seeds)
    line = F.concat(F.lit("- "), "seed", F.lit(" is connected to: "), F.array_join("n", ", "))
    return lines.groupBy("campaign_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seed", line.alias("line")))), lambda x: x["line"]), "\n").alias("graph_context")
    )


def technique(techniques: DataFrame, id_: Column) -> DataFrame:
    """The technique with an id, as a row or none."""
    return techniques.where(F.col("id") == id_)


def context_rows(campaigns: DataFrame, edges: DataFrame, techniques: DataFrame, nearest: DataFrame) -> DataFrame:
    """One row per campaign: its times, retrieval text, profile, and the lines on its
    neighbourhood and on its nearest techniques (``nearest``: query_id = campaign_id, id, rank).
    A campaign without neighbours or techniques has the default line or an empty text."""
    starts = P.seeds(campaigns)
    neighbours = cut(starts.join(expand(edges, starts), "seed"))
    return (
        campaigns.select("campaign_id", "label", "ioc_count", "first_seen", "last_seen", "duration_hours")
        .join(P.retrieval_text(campaigns), "campaign_id").join(P.profile(campaigns, neighbours), "campaign_id")
        .join(graph_lines(neighbours), "campaign_id", "left")
        .join(technique_lines(nearest, techniques).withColumnRenamed("query_id", "campaign_id"), "campaign_id", "left")
        .withColumns({
            "graph_context": F.coalesce("graph_context", F.lit("No significant graph connections found.")),
            "technique_context": F.coalesce("technique_context", F.lit("")),
        })
    )
