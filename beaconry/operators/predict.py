"""Campaign context, attack-stage forecasts and technique retrieval."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry import constants as C
from beaconry.functions.columns import broadcast_if_small, lookup
from beaconry.functions.sqltext import occurrences
from beaconry.operators import graph as G

MAX_SEEDS, MAX_PER_HOP = 50, 15


def seeds(campaigns: DataFrame, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """First members of each campaign: campaign_id, seed."""
    return campaigns.select("campaign_id", F.explode(F.slice("ioc_members", 1, max_seeds)).alias("seed"))


def multi_hop(edges: DataFrame, starts: DataFrame, max_hops: int = 2, keep: int | None = MAX_PER_HOP) -> DataFrame:
    """seed, hop, neighbour: breadth-first steps in both directions.

    The frontier itself is never cut, only the rows reported per seed and hop
    (the report's size, in name order). ``keep=None`` reports all.
    """
    links = G.symmetric(edges).distinct()
    visited = starts.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")).distinct()
    layer = visited.select("seed", "node")
    for hop in range(1, max_hops + 1):
        reached = layer.join(links, layer["node"] == links["a"]).select("seed", F.col("b").alias("node")).distinct()
        layer = reached.join(visited.select("seed", "node"), ["seed", "node"], "left_anti")
        visited = visited.unionByName(layer.withColumn("hop", F.lit(hop)))
    found = visited.where(F.col("hop") > 0).select("seed", "hop", F.col("node").alias("neighbour"))
    if keep is None:
        return found
    rank = Window.partitionBy("seed", "hop").orderBy("neighbour")
    return found.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= keep).drop("_r")


def _by_count(distribution: str) -> Column:
    """Map entries by count descending, then name."""
    keyed = F.transform(F.map_entries(distribution), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("name")))
    return F.array_sort(keyed)


def retrieval_text(campaigns: DataFrame) -> DataFrame:
    """Query text per campaign: one phrase per known type, most frequent first,
    and a phrase for severe campaigns; a default where neither applies."""
    phrases = F.filter(
        F.transform(_by_count("type_distribution"), lambda e: lookup(F.lower(e["name"]), C.TYPE_PHRASES, None)),
        lambda p: p.isNotNull(),
    )
    severe = F.coalesce(F.element_at("severity_distribution", "Critical"), F.lit(0)) + F.coalesce(F.element_at("severity_distribution", "High"), F.lit(0))
    parts = F.concat(phrases, F.when(severe > 0, F.array(F.lit(C.SEVERE_PHRASE))).otherwise(F.array().cast("array<string>")))
    return campaigns.select(
        "campaign_id", F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(C.DEFAULT_PHRASE).alias("query")
    )


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, subtechniques: bool = True, metric: str = "sql2") -> DataFrame:
    """Nearest vectors of each query: query_id, id, rank, similarity 1/(1 + d).

    ``queries`` is small by nature (one row per campaign under study) and only its
    rows are repeated; every task keeps its best few per query before the shuffle,
    so the ranking window sees a bounded number of rows per query and task.
    ``metric`` is squared L2 (the store's default) or ``l2``. Without
    sub-techniques twice as many are fetched first.
    """
    fetch = k if subtechniques else 2 * k
    pairs = vectors.crossJoin(broadcast_if_small(queries, 10_000))
    squared = F.aggregate(
        F.zip_with("q_embedding", "embedding", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0), lambda acc, x: acc + x,
    )
    distance = F.sqrt(squared) if metric == "l2" else squared
    scored = pairs.select("query_id", "id", "is_subtechnique", distance.alias("distance"))
    # the group limit of a rank filter is applied before the exchange
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    fetched = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= fetch)
    if not subtechniques:
        fetched = fetched.where(~F.col("is_subtechnique"))
        fetched = fetched.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return fetched.select("query_id", "id", "rank", F.round(1 / (1 + F.col("distance")), 3).alias("similarity"))


def technique_text(techniques: DataFrame) -> DataFrame:
    tail = F.when(F.size("tactics") > 0, F.concat(F.lit(" Tactics: "), F.array_join("tactics", ", "))).otherwise(F.lit(""))
    return techniques.select("id", F.concat("id", F.lit(" "), "name", F.lit(": "), F.left("description", F.lit(500)), tail).alias("text"))


def context_lines(neighbours: DataFrame, seeds_shown: int = 10, each: int = 5) -> DataFrame:
    """One line per seed for the first seeds, with its first direct neighbours."""
    rank = Window.partitionBy("seed").orderBy("neighbour")
    few = neighbours.where(F.col("hop") == 1).withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= each)
    lines = few.groupBy("seed").agg(F.array_sort(F.collect_list("neighbour")).alias("n"))
    return lines.orderBy("seed").limit(seeds_shown).select(
        "seed", F.concat(F.lit("- "), "seed", F.lit(" is connected to: "), F.array_join("n", ", ")).alias("line")
    )


def profile(campaigns: DataFrame, neighbours: DataFrame, samples: int = 10) -> DataFrame:
    """Text profile per campaign. ``neighbours``: campaign_id, seed, hop, neighbour,
    already limited per seed and hop, so the lists per campaign are bounded."""
    per_hop = neighbours.groupBy("campaign_id", "hop").agg(F.count("*").alias("n"))
    totals = neighbours.groupBy("campaign_id").agg(F.countDistinct("seed").alias("connected"), F.count("*").alias("nodes"), F.countDistinct("hop").alias("hops"))
    often = neighbours.groupBy("campaign_id", "hop", "neighbour").agg(F.count("*").alias("times"))
    rank = Window.partitionBy("campaign_id", "hop").orderBy(F.desc("times"), "neighbour")
    top = often.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= 5)
    listed = top.groupBy("campaign_id").pivot("hop", [1, 2]).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "neighbour", "times"))),
                                 lambda t: F.format_string("%s (%dx)", t["neighbour"], t["times"])), ", ")
    )

    def pairs(name: str) -> Column:
        return F.array_join(F.transform(_by_count(name), lambda e: F.format_string("%s: %d", e["name"], -e["n"])), ", ")

    rows = campaigns.join(totals, "campaign_id", "left").join(listed, "campaign_id", "left")
    connectivity = F.when(
        F.col("connected") > 0,
        F.format_string("Graph connectivity: %d IOCs connected to %d nodes across %d hops", "connected", "nodes", "hops"),
    ).otherwise("Graph connectivity: No known graph connections for this campaign")
    lines = [
        F.concat(F.lit("Campaign: "), "label"),
        F.concat(F.lit("Total IOCs: "), F.col("ioc_count").cast("string")),
        F.concat(F.lit("First seen: "), F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss")),
        F.concat(F.lit("Last seen: "), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss")),
        F.when(F.col("duration_hours") != 0, F.format_string("Duration: %.1f hours", "duration_hours")),
        F.concat(F.lit("IOC types: "), pairs("type_distribution")),
        F.concat(F.lit("Severity distribution: "), pairs("severity_distribution")),
        F.concat(F.lit("Sample IOCs: "), F.array_join(F.slice("ioc_members", 1, samples), ", ")),
        connectivity,
        F.concat(F.lit("Hop-1 neighbors (immediate blast radius): "), F.col("1")),
        F.concat(F.lit("Hop-2 neighbors (extended threat web): "), F.col("2")),
    ]
    return rows.select("campaign_id", F.concat_ws("\n", *lines).alias("profile"))


# --- stages -----------------------------------------------------------------
def stage_from_words(text: str) -> Column:
    """Stage of a profile column by keyword counts; the first best stage wins."""
    scores = []
    for order, (stage, words) in enumerate(C.STAGE_WORDS.items()):
        total = " + ".join(occurrences(f"lower({text})", w) for w in words)
        scores.append(f"named_struct('score', {total}, 'order', {-order}, 'stage', '{stage}')")
    best = F.expr(f"array_max(array({', '.join(scores)}))")
    lower = F.lower(F.col(text))
    return (
        F.when(best["score"] > 0, best["stage"]).when(lower.contains("critical"), "Impact")
        .when(lower.contains("high"), "Lateral Movement").otherwise("Reconnaissance")
    )


def known_stage(reply: Column) -> Column:
    """One of the fourteen stages: exact match, then containment either way."""
    r = F.lower(reply)
    out = None
    for stage in C.STAGES:
        out = F.when(r == stage.lower(), stage) if out is None else out.when(r == stage.lower(), stage)
    for stage in C.STAGES:
        out = out.when(r.contains(stage.lower()) | F.lit(stage.lower()).contains(r), stage)
    return out.otherwise("Reconnaissance")


def progression(stage: Column) -> Column:
    """The three stages that follow, ending at the last, with falling confidence; an unknown or
    missing stage counts as the first."""
    names = F.array(*[F.lit(s) for s in C.STAGES])
    at = F.greatest(F.coalesce(F.array_position(names, stage), F.lit(0)), F.lit(1))

    def step(number: Column) -> Column:
        tactic = F.element_at(names, F.least(at + number, F.lit(len(C.STAGES))).cast("int"))
        return F.struct(
            tactic.alias("tactic"), F.lit("T0000").alias("technique_id"),
            F.concat(F.lit("Predicted "), tactic, F.lit(" technique")).alias("technique_name"),
            F.round(F.greatest(F.lit(0.3), 0.8 - number * 0.2), 4).alias("confidence"),
            F.concat(F.lit("Natural kill chain progression from "), F.coalesce(stage, F.lit("unknown"))).alias("reasoning"),
        )

    return F.transform(F.array(*[F.lit(i) for i in (1, 2, 3)]), step)


def next_stages(rows: DataFrame, key: str, stage: str) -> DataFrame:
    """The steps of ``progression`` as rows."""
    steps = rows.select(key, F.posexplode(progression(F.col(stage))).alias("_at", "_step"))
    return steps.select(key, (F.col("_at") + 1).alias("step"), "_step.*")


_REPLY = (
    "current_stage string, predictions array<struct<tactic:string,technique_id:string,technique_name:string,confidence:double,reasoning:string>>, "
    "defensive_recommendations array<string>, _corrupt_record string"
)


def parse_predictions(replies: DataFrame, reply: str = "raw_reply") -> DataFrame:
    """Predictions (at most three) and recommendations (at most five) from raw
    replies: the whole text, a fenced block, or the first object in it."""
    def readable(text: Column) -> Column:
        parsed = F.from_json(text, _REPLY)
        return F.when(text.startswith("{") & parsed["_corrupt_record"].isNull(), parsed)

    raw = F.col(reply)
    parsed = F.coalesce(
        readable(F.trim(raw)),
        readable(F.trim(F.regexp_extract(raw, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1))),
        readable(F.regexp_extract(raw, r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", 0)),
    )
    fixed = F.transform(
        F.slice(F.col("_p.predictions"), 1, 3),
        lambda p: F.struct(
            F.coalesce(p["tactic"], F.lit("Unknown")).alias("tactic"),
            F.coalesce(p["technique_id"], F.lit("T0000")).alias("technique_id"),
            F.coalesce(p["technique_name"], F.lit("Unknown")).alias("technique_name"),
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(p["confidence"], F.lit(0.5)))).alias("confidence"),
            F.coalesce(p["reasoning"], F.lit("")).alias("reasoning"),
        ),
    )
    return replies.withColumn("_p", parsed).withColumns(
        {"predictions": fixed, "recommendations": F.coalesce(F.slice(F.col("_p.defensive_recommendations"), 1, 5), F.array().cast("array<string>")),
         "replied_stage": F.col("_p.current_stage")}
    ).drop("_p")


def forecast(replies: DataFrame, stage: str, reply: str = "raw_reply") -> DataFrame:
    """``parse_predictions``; a reply that cannot be read or names no predictions gets the natural
    progression from ``stage`` and general recommendations. An empty list of predictions is an answer and stays."""
    parsed = parse_predictions(replies, reply)
    missing = F.col("predictions").isNull()
    return parsed.withColumns({
        "fallback": missing,
        "recommendations": F.when(missing, F.array(*[F.lit(r) for r in C.FALLBACK_RECOMMENDATIONS])).otherwise(F.col("recommendations")),
        "predictions": F.coalesce("predictions", progression(F.col(stage))),
    })


def to_predict(campaigns: DataFrame, predictions: DataFrame, as_of: Column, hours: float = 48, limit: int = 10) -> DataFrame:
    """Active campaigns not predicted on the day yet; at most ten are considered."""
    active = campaigns.where(F.col("last_seen") >= as_of - F.make_dt_interval(hours=F.lit(int(hours)))).orderBy("campaign_id").limit(limit)
    today = predictions.where(F.to_date("generated_at") == F.to_date(as_of)).select("campaign_id")
    return active.join(today, "campaign_id", "left_anti")


def prediction_stats(predictions: DataFrame) -> DataFrame:
    """Per tactic: count and mean confidence, with the totals beside them.
    ``predictions``: pred_id, campaign_id, tactic, confidence."""
    by_tactic = predictions.groupBy("tactic").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))
    totals = predictions.agg(
        F.countDistinct("pred_id").alias("total_predictions"), F.countDistinct("campaign_id").alias("unique_campaigns"),
        F.round(F.avg("confidence"), 4).alias("overall_confidence"),
    )
    top = by_tactic.agg(F.max_by("tactic", F.struct("n", "tactic")).alias("top_tactic"))
    return by_tactic.crossJoin(totals).crossJoin(top)  # single rows


def prediction_history(predictions: DataFrame, campaign_id: str, limit: int = 10) -> DataFrame:
    return predictions.where(F.col("campaign_id") == campaign_id).orderBy(F.desc("generated_at"), "pred_id").limit(limit)
