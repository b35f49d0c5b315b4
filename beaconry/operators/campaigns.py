"""Campaigns: communities of indicators with times, severities and feeds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry import constants as C
from beaconry.functions.columns import hours_between, lookup

MIN_SIZE = 3


def groups(membership: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """Members of communities with at least ``min_size`` nodes."""
    big = membership.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= min_size).select("community")
    return membership.join(big, "community", "left_semi")


def distributions(members: DataFrame, column: str) -> DataFrame:
    """Long form: community, name, count."""
    return members.groupBy("community", F.col(column).alias("name")).agg(F.count("*").alias("count"))


def _as_map(long_form: DataFrame, name: str) -> DataFrame:
    # at most one entry per type or severity
    return long_form.groupBy("community").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "count")))).alias(name))


def enrich(members: DataFrame, detected_at: Column, sources: DataFrame | None = None) -> DataFrame:
    """One row per community.

    ``members``: community, id, type, confidence, first_seen, last_seen.
    The id digests the sorted member list, which is part of the result anyway, so
    it is collected once per campaign.
    """
    rows = members.withColumn("severity", lookup(F.lower("type"), C.INGEST_SEVERITY, "Unknown"))
    by_type, by_severity = distributions(rows, "type"), distributions(rows, "severity")
    dominant = by_type.groupBy("community").agg(F.max_by("name", F.struct("count", _reverse("name"))).alias("dominant"))
    base = rows.groupBy("community").agg(
        F.sort_array(F.collect_list("id")).alias("ioc_members"),
        F.count("*").alias("ioc_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.round(F.max("confidence"), 4).alias("max_confidence"),
    )
    out = (
        base.join(dominant, "community")
        .join(_as_map(by_type, "type_distribution"), "community")
        .join(_as_map(by_severity, "severity_distribution"), "community")
    )
    if sources is not None:
        feeds = (
            members.join(sources, "id").select("community", F.explode("provenance").alias("feed"))
            .distinct().groupBy("community").agg(F.sort_array(F.collect_list("feed")).alias("feed_sources"))
        )
        out = out.join(feeds, "community", "left").withColumn("feed_sources", F.coalesce("feed_sources", F.array().cast("array<string>")))
    else:
        out = out.withColumn("feed_sources", F.array().cast("array<string>"))
    return out.select(
        campaign_id(F.col("ioc_members")).alias("campaign_id"),
        F.concat(F.upper("dominant"), F.lit(" Campaign "), F.date_format("first_seen", "yyyy-MM-dd")).alias("label"),
        "ioc_members", "ioc_count", "first_seen", "last_seen",
        F.round(hours_between(F.col("first_seen"), F.col("last_seen")), 2).alias("duration_hours"),
        "severity_distribution", "type_distribution", "feed_sources", "avg_confidence", "max_confidence",
        detected_at.alias("detected_at"),
    )


def _reverse(name: str) -> Column:
    """Sort key that prefers the alphabetically first name under a maximum."""
    return F.transform(F.split(F.col(name), ""), lambda ch: -F.ascii(ch))


def campaign_id(members: Column) -> Column:
    return F.concat(F.lit("campaign_"), F.substring(F.sha2(F.array_join(members, "|"), 256), 1, 16))


def top_severity(distribution: Column) -> Column:
    out = F.lit("Unknown")
    for name in ("Low", "Medium", "High", "Critical"):
        out = F.when(F.coalesce(F.element_at(distribution, name), F.lit(0)) > 0, name).otherwise(out)
    return out


def summaries(campaigns: DataFrame) -> DataFrame:
    return campaigns.select(
        "campaign_id", "label", "ioc_count", "first_seen", "last_seen", "duration_hours", "avg_confidence",
        top_severity(F.col("severity_distribution")).alias("top_severity"),
    )


def timeline(campaigns: DataFrame, as_of: Column, period_days: int = 30, bucket_days: int = 1) -> DataFrame:
    """Per bucket: campaigns whose span touches it (both ends count) and campaigns
    detected in it. Each campaign is expanded to the buckets it covers, at most one
    row per bucket of the period, and aggregated; no join with the calendar."""
    start = as_of - F.make_interval(days=F.lit(period_days))
    size = F.lit(bucket_days * 86_400_000_000)

    def bucket(at: Column) -> Column:
        return F.floor((F.unix_micros(at) - F.unix_micros(start)) / size)

    last = F.lit(period_days // bucket_days)
    # touching the end of bucket i at exactly its closing time still counts as active in i
    low = F.greatest(F.lit(0), F.ceil((F.unix_micros("first_seen") - F.unix_micros(start)) / size) - 1)
    high = F.least(last, bucket(F.col("last_seen")))
    active = campaigns.where(low <= high).select(F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("i"), F.lit(1).alias("a"), F.lit(0).alias("n"))
    found = F.coalesce("detected_at", "last_seen")
    new = campaigns.where((found >= start) & (bucket(found) <= last)).select(bucket(found).cast("int").alias("i"), F.lit(0).alias("a"), F.lit(1).alias("n"))
    buckets = campaigns.sparkSession.range(period_days // bucket_days + 1).select(F.col("id").cast("int").alias("i"), F.lit(0).alias("a"), F.lit(0).alias("n"))
    counted = active.union(new).union(buckets).groupBy("i").agg(F.sum("a").alias("active_campaigns"), F.sum("n").alias("new_campaigns"))
    return counted.select(
        F.date_format(F.timestamp_micros(F.unix_micros(start) + F.col("i") * size), "MMM dd").alias("period"),
        "i", "active_campaigns", "new_campaigns",
    )


def active(campaigns: DataFrame, as_of: Column, hours: float = 48) -> DataFrame:
    return campaigns.where(hours_between(F.col("last_seen"), as_of) <= hours)


def severity_totals(campaigns: DataFrame) -> DataFrame:
    return campaigns.select(F.explode("severity_distribution").alias("severity", "n")).groupBy("severity").agg(F.sum("n").alias("count"))


SORTABLE = ("detected_at", "ioc_count", "last_seen", "avg_confidence")


def list_campaigns(campaigns: DataFrame, as_of: Column | None = None, active_only: bool = False, sort_by: str = "detected_at", limit: int = 50) -> DataFrame:
    rows = active(campaigns, as_of) if active_only else campaigns
    field = sort_by if sort_by in SORTABLE else "detected_at"
    return rows.orderBy(F.desc(field), "campaign_id").limit(limit).drop("ioc_members")


def stats(campaigns: DataFrame, as_of: Column) -> DataFrame:
    biggest = F.max_by(F.struct("label", "ioc_count"), F.struct("ioc_count", "campaign_id"))
    return campaigns.agg(
        F.count("*").alias("total_campaigns"),
        F.count_if(hours_between(F.col("last_seen"), as_of) <= 48).alias("active_campaigns"),
        F.round(F.avg("ioc_count"), 1).alias("avg_ioc_count"),
        F.sum("ioc_count").alias("total_iocs_in_campaigns"),
        biggest.alias("_big"),
    ).select("*", F.col("_big.label").alias("largest_label"), F.col("_big.ioc_count").alias("largest_count")).drop("_big")


def detail(campaigns: DataFrame, ids: DataFrame) -> DataFrame:
    """Campaigns of the given ids, one row per member."""
    return campaigns.join(ids, "campaign_id", "left_semi").select("campaign_id", "label", F.explode("ioc_members").alias("ioc"))
