"""The indicator store: upserts, lists, facets, frequencies, feed health."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry import constants as C

PERIOD_DAYS = {"1d": 1, "7d": 7, "30d": 30, "90d": 90}
SORTABLE = ("timestamp", "ingested_at", "confidence", "severity")


# --- upserts ----------------------------------------------------------------
def keyed_upsert(
    target: DataFrame | None, batch: DataFrame, key: str, order: list[str], earliest: tuple[str, ...] = (), newest_first: bool = True
) -> DataFrame:
    """Newest row per key, batch over target.

    ``max_by`` over a struct keeps one row per key with partial aggregation on
    the map side, so a key that fills a third of the batch never meets in one
    task as rows. ``order`` columns decide "newest", largest first; rows of the batch
    come before those of the target, or only win ties where ``newest_first`` is off.
    Of the ``earliest`` columns the smallest value is kept, from the same aggregate.
    """
    columns = batch.columns
    rows = batch.withColumn("_new", F.lit(1))
    if target is not None:
        rows = rows.unionByName(target.withColumn("_new", F.lit(0)), allowMissingColumns=True)
        columns = rows.drop("_new").columns
    rank = F.struct(*([F.col("_new")] if newest_first else []), *[F.col(c) for c in order], F.col("_new"))
    best = rows.groupBy(F.col(key)).agg(
        F.max_by(F.struct(*[F.col(c) for c in columns if c != key]), rank).alias("_row"), *[F.min(c).alias(f"_min_{c}") for c in earliest]
    )
    from_ = {key: F.col(key)} | {c: F.col(f"_min_{c}").alias(c) for c in earliest}
    return best.select(*[from_.get(c, F.col(f"_row.{c}").alias(c)) for c in columns])


def ioc_id(kind: Column, value: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(kind, F.lit("?")), F.lit("::"), F.coalesce(value, F.lit(""))), 256)


def upsert_iocs(target: DataFrame | None, batch: DataFrame, as_of: Column) -> DataFrame:
    """Indicator upsert with defaults filled and the ingest time stamped.

    The latest ``timestamp`` wins, then the higher fused confidence. The first
    ingest time is kept beside the last one.
    """
    rows = batch.withColumns(
        {
            "ioc_id": ioc_id(F.col("type"), F.col("ioc")),
            "fused_confidence": F.coalesce("fused_confidence", "confidence", F.lit(0.5)),
            "verified": F.coalesce("verified", F.lit(False)),
            "reasoning": F.coalesce("reasoning", F.lit("")),
            "deobfuscated": F.coalesce("deobfuscated", F.lit(False)),
            "ingested_at": as_of,
            "first_ingested_at": as_of,
        }
    )
    return keyed_upsert(target, rows, "ioc_id", ["timestamp", "fused_confidence", "feed"], earliest=("first_ingested_at",), newest_first=False)


def upsert_campaigns(target: DataFrame | None, batch: DataFrame) -> DataFrame:
    return keyed_upsert(target, batch, "campaign_id", ["detected_at"])


def upsert_predictions(target: DataFrame | None, batch: DataFrame) -> DataFrame:
    """At most one prediction per campaign and day."""
    key = F.concat(F.lit("pred_"), F.col("campaign_id"), F.lit("_"), F.date_format("generated_at", "yyyy-MM-dd"))
    return keyed_upsert(target, batch.withColumn("pred_id", key), "pred_id", ["generated_at"])


def export_bullets(iocs: DataFrame, n: int = 500, order: str = "doc_id") -> DataFrame:
    """First ``n`` rows as bullet lines; blanks are dropped after the cut."""
    head = iocs.orderBy(order).limit(n)
    value = F.trim(F.coalesce("ioc", F.lit("")))
    line = F.concat(F.lit("• "), F.coalesce("type", F.lit("?")), F.lit(": "), value)
    return head.where(value != "").select(order, line.alias("line"))


# --- reads ------------------------------------------------------------------
def counts_by(iocs: DataFrame, column: str) -> DataFrame:
    return iocs.groupBy(column).agg(F.count("*").alias("count"))


def facets(iocs: DataFrame, top_feeds: int = 20) -> DataFrame:
    """Total, by type, by severity and top feeds from one pass over the table."""
    sets = iocs.groupingSets(
        [[], ["type"], ["severity"], ["feed"]], "type", "severity", "feed"
    ).agg(F.count("*").alias("count"), F.grouping_id("type", "severity", "feed").alias("_set"))
    facet = F.when(F.col("_set") == 7, "total").when(F.col("_set") == 3, "type").when(F.col("_set") == 5, "severity").otherwise("feed")
    # a stored NULL and the literal "unknown" share one label
    rows = sets.select(
        facet.alias("facet"),
        F.when(F.col("_set") == 7, F.lit("all")).otherwise(F.coalesce("type", "severity", "feed", F.lit("unknown"))).alias("name"),
        "count",
    )
    best = Window.partitionBy("facet").orderBy(F.desc("count"), "name")
    return (
        rows.withColumn("_rank", F.row_number().over(best))
        .where((F.col("facet") != "feed") | (F.col("_rank") <= top_feeds))
        .drop("_rank")
    )


def filled_confidence() -> Column:
    return F.coalesce("confidence", "fused_confidence", F.lit(0.5))


def list_iocs(
    iocs: DataFrame,
    kind: str | None = None,
    severity: str | None = None,
    sort_by: str = "ingested_at",
    limit: int = 100,
    tie: str = "event_id",
) -> DataFrame:
    """One page, newest or highest first; unknown sort fields fall back to
    ``ingested_at``. The limit is the page size."""
    rows = iocs
    if kind:
        rows = rows.where(F.col("type") == kind)
    if severity:
        rows = rows.where(F.col("severity") == severity)
    field = sort_by if sort_by in SORTABLE else "ingested_at"
    page = rows.orderBy(F.desc_nulls_last(field), F.asc(tie)).limit(limit)
    return page.withColumn("confidence", filled_confidence())


def total_available(iocs: DataFrame, kind: str | None = None, severity: str | None = None) -> DataFrame:
    test = F.lit(True)
    if kind:
        test = test & (F.col("type") == kind)
    if severity:
        test = test & (F.col("severity") == severity)
    return iocs.agg(F.count_if(test).alias("total_available"))


def search_iocs(iocs: DataFrame, kind: str = "", severity: str = "") -> DataFrame:
    """Case-insensitive substring filter; the needle is a literal, never a pattern."""
    rows = iocs
    for column, needle in (("type", kind), ("severity", severity)):
        needle = "".join(ch for ch in needle[:100].strip() if ch not in "\\.*+?^${}()|[]").lower()
        if needle:
            rows = rows.where(F.lower(F.coalesce(column, F.lit(""))).contains(needle))
    return rows


def min_confidence(iocs: DataFrame, percent: float) -> DataFrame:
    return iocs.where(filled_confidence() >= percent / 100)


def frequency(iocs: DataFrame, as_of: Column, period: str = "7d", by: str = "severity", values: list[str] | None = None) -> DataFrame:
    """Counts per time bucket and group, zero-filled over the whole period.

    Either stamp may place a row in the period; the ingest time is preferred for
    the bucket. Buckets are hours for a one-day period, else days.
    """
    days = PERIOD_DAYS.get(period, 7)
    unit = "hour" if period == "1d" else "day"
    start = as_of - F.make_interval(days=F.lit(days))
    groups = values or ["Critical", "High", "Medium", "Low", "Unknown"]
    counted = (
        iocs.where((F.col("ingested_at") >= start) | (F.col("timestamp") >= start))
        .groupBy(F.date_trunc(unit, F.coalesce("ingested_at", "timestamp")).alias("bucket"))
        .pivot(by, groups)
        .agg(F.count(F.lit(1)))
    )
    calendar = iocs.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_trunc(unit, start), F.date_trunc(unit, as_of), F.expr(f"interval 1 {unit}"))).alias("bucket")
    )
    # the pivot has at most one row per bucket of the period
    return calendar.join(counted, "bucket", "left").select(
        "bucket", *[F.coalesce(F.col(f"`{g}`"), F.lit(0)).alias(g.lower()) for g in groups]
    )


def batch_summary(batch: DataFrame, first: int = 5, order: str = "doc_id") -> DataFrame:
    """Row count, distinct types and the first few indicators of a batch."""
    stats = batch.agg(
        F.count("*").alias("total"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types")
    )
    head = batch.orderBy(order, "place").limit(first)
    shown = head.agg(F.array_sort(F.collect_list(F.struct(order, "place", "type", "ioc"))).alias("h")).select(
        F.array_join(F.transform("h", lambda r: F.concat(r["type"], F.lit(":"), r["ioc"])), ", ").alias("first")
    )
    return stats.crossJoin(F.broadcast(shown))  # one row each


# --- feeds ------------------------------------------------------------------
def fetch_stats(fetches: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("status") == "success")
    return fetches.agg(
        F.count("*").alias("total"),
        ok.alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.when(F.count("*") > 0, F.format_string("%.1f%%", ok / F.count("*") * 100)).otherwise("0%").alias("success_rate"),
    )


def feed_health(checks: DataFrame) -> DataFrame:
    """Counters per feed from the check log, with the last successful response time."""
    good = F.col("success")
    return checks.groupBy("feed").agg(
        F.count("*").alias("total"),
        F.count_if(good).alias("success"),
        F.count_if(~good).alias("failure"),
        F.max_by(F.when(good, F.col("response_time")), F.when(good, F.struct("checked_at", "seq"))).alias("last_response_time"),
    )


def feed_listing(feeds: DataFrame, health: DataFrame) -> DataFrame:
    return feeds.join(health, feeds["name"] == health["feed"], "left").select(
        "name", "url", "category",
        F.coalesce("priority", F.lit("medium")).alias("priority"),
        F.coalesce("success", F.lit(0)).alias("success_count"),
        F.coalesce("failure", F.lit(0)).alias("failure_count"),
        "last_response_time",
    )


def fetch_age(checks: DataFrame, as_of: Column) -> DataFrame:
    """Whole minutes since the last fetch, with wording."""
    minutes = F.floor((F.unix_micros(as_of) - F.unix_micros(F.max("checked_at"))) / F.lit(6.0e7)).cast("bigint")
    wording = (
        F.when(F.col("minutes").isNull(), "No previous fetch recorded.")
        .when(F.col("minutes") < 1, "Last feed fetch was just now.")
        .when(F.col("minutes") == 1, "Last feed fetch was 1 minute ago.")
        .otherwise(F.concat(F.lit("Last feed fetch was "), F.col("minutes").cast("string"), F.lit(" minutes ago.")))
    )
    return checks.agg(minutes.alias("minutes")).withColumn("message", wording)


def failure_streaks(runs: DataFrame, at_least: int = 3) -> DataFrame:
    """Runs of consecutive failures per job.

    A failure belongs to the streak named by the number of successes before it.
    """
    before = Window.partitionBy("job").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = runs.withColumn("_streak", F.sum(F.col("ok").cast("int")).over(before))
    return (
        marked.where(~F.col("ok")).groupBy("job", "_streak")
        .agg(F.min("seq").alias("first_seq"), F.count("*").alias("failures"))
        .where(F.col("failures") >= at_least).drop("_streak")
    )


def severity_first(iocs: DataFrame) -> DataFrame:
    """Rows ordered from Critical to Unknown."""
    rank = F.lit(0)
    for name, priority in C.SEVERITY_PRIORITY.items():
        rank = F.when(F.col("severity") == name, priority).otherwise(rank)
    return iocs.withColumn("priority", rank)
