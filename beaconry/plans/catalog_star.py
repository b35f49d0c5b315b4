"""Registered queries: communities over the indicator-context star, and the campaigns made of them."""
from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.functions.lineage import cut
from beaconry.operators import campaigns as P
from beaconry.operators import graph as G
from beaconry.operators import stars
from beaconry.plans import catalog_graph as CG
from beaconry.plans import views as V

#: Reports of one family; the number of families grows with the table.
FAMILY = 12
#: Indicators of a family; a report names eight of them, more than pairs are formed for.
NAMES = 10
HUB = "hub.evil.top"

_NAME = "'n' || cast(k as {s}) || '-' || cast(i as {s}) || '.evil.top'"
_TYPE = "case i % 4 when 0 then 'ip' when 1 then 'domain' when 2 then 'url' else 'md5' end"
_CONFIDENCE = "cast(40 + (doc_id + i) % 50 as double) / 100"
_KEPT = "(doc_id + i) % 5 <> 0"


def _columns(string: str) -> list[str]:
    return [
        "doc_id", "k", "i as place", f"{_NAME.format(s=string)} as ioc", f"{_TYPE} as type", f"{_CONFIDENCE} as confidence", "source as feed",
        f"'ctx' || cast(doc_id as {string}) as context_id", f"{V.report_time()} as seen_at",
    ]


def mentions(spark, sf_dir):
    """Families of reports, and in each third report a hub that joins all families to one component."""
    documents = V.table(spark, sf_dir, "documents").select("doc_id", "source", F.expr(f"doc_id div {FAMILY}").alias("k"))
    own = documents.select("*", F.explode(F.sequence(F.lit(0), F.lit(NAMES - 1))).alias("i")).where(_KEPT).selectExpr(*_columns("string"))
    hub = documents.where("doc_id % 3 = 0").withColumn("i", F.lit(NAMES)).selectExpr(*_columns("string")).withColumn("ioc", F.lit(HUB))
    return own.union(hub)


def found(spark, sf_dir):
    """Mentions and membership; the hub belongs to any one of the families and is left out."""
    rows = cut(mentions(spark, sf_dir))
    return rows, cut(stars.membership(rows).where(F.col("id") != HUB))


def star_communities(spark, sf_dir):
    _, groups = found(spark, sf_dir)
    return groups.groupBy("community").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("members")).drop("community")


def star_campaigns(spark, sf_dir):
    """Mentions to nodes, communities and campaigns."""
    rows, groups = found(spark, sf_dir)
    members = P.groups(groups.join(G.fold_nodes(rows), "id"))
    made = P.enrich(members, F.lit(None).cast("timestamp"), G.provenance(rows)).withColumn("detected_at", F.expr("last_seen + interval '6' hour"))
    return CG.campaign_enrich(made)


#: The hub's mentions are not among them.
PLANTED = (
    f"select {', '.join(_columns('varchar'))} from (select doc_id, source, doc_id // {FAMILY} as k, unnest(range({NAMES})) as i from documents) where {_KEPT}"
)

QUERIES = {
    "star_communities": (
        star_communities,
        f"with m as ({PLANTED}) select min(ioc) as first, max(ioc) as last, count(distinct ioc) as members from m group by k",
    ),
    "star_campaigns": (
        star_campaigns,
        f"with {CG.campaign_ctes(PLANTED)} select campaign_id, label, ioc_count, first_seen, last_seen, duration_hours, avg_confidence, max_confidence, n_high, n_medium from camp",
    ),
}
