"""Reading fetched feeds, pages, labelled sets and technique bundles; writing results."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.functions import unicode as U

FETCH = "struct<status:string,url:string,content:string,category:string,source_type:string,reliability:double>"
_ITEM = "struct<title:string,link:string,description:string,summary:string,content:string,pubDate:string>"
_ENTRY = "struct<title:string,link:array<struct<_href:string>>,summary:string,content:string,published:string,updated:string>"


def read_fetches(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Raw fetch results: JSON objects keyed by feed, one object per line, or one per
    file where ``whole_files`` says so (an object spread over lines; its file is one row)."""
    return fetch_rows(spark.read.text(path, wholetext=whole_files).select(F.col("value").alias("body")))


def unreadable(bodies: DataFrame) -> DataFrame:
    """Number of bodies that hold no fetch results (blank lines aside)."""
    parsed = F.from_json("body", f"map<string,{FETCH}>")
    return bodies.agg(F.count_if((F.trim("body") != "") & (parsed.isNull() | (F.size(parsed) == 0))).alias("unreadable"))


def fetch_rows(bodies: DataFrame) -> DataFrame:
    """feed and its fetch result, successful ones only."""
    fetched = F.from_json("body", f"map<string,{FETCH}>")
    rows = bodies.select(F.explode(fetched).alias("feed", "f")).select("feed", "f.*")
    return rows.where(F.col("status") == "success").withColumn("reliability", F.coalesce("reliability", F.lit(0.5)))


def looks_like_xml(content: Column) -> Column:
    stripped = F.trim(content)
    return stripped.startswith("<") | F.substring(stripped, 1, 100).contains("<?xml")


def _feed(content: Column) -> Column:
    """RSS channel or Atom feed in one shape."""
    return F.from_xml(content, F.lit(f"channel struct<title:string,item:array<{_ITEM}>>, title string, entry array<{_ENTRY}>"))


def rss_entries(fetches: DataFrame) -> DataFrame:
    """One row per entry of an RSS or Atom feed, with the defaults of missing parts."""
    rows = fetches.where(looks_like_xml(F.col("content"))).withColumn("_x", _feed(F.col("content")))
    items = F.transform("_x.channel.item", lambda e: F.struct(
        e["title"].alias("title"), e["link"].alias("link"),
        F.coalesce(e["description"], e["summary"], e["content"]).alias("summary"), e["pubDate"].alias("published"),
    ))
    entries = F.transform("_x.entry", lambda e: F.struct(
        e["title"].alias("title"), F.get(e["link"], F.lit(0))["_href"].alias("link"),
        F.coalesce(e["summary"], e["content"]).alias("summary"), F.coalesce(e["published"], e["updated"]).alias("published"),
    ))
    named = rows.select("feed", "url", F.coalesce("_x.channel.title", "_x.title").alias("source"), F.explode(F.coalesce(items, entries)).alias("e"))
    return named.select(
        "feed",
        F.coalesce("source", F.lit("Unknown Source")).alias("source"),
        F.coalesce("e.title", F.lit("")).alias("title"),
        F.coalesce("e.link", "url").alias("link"),
        F.coalesce("e.summary", F.lit("")).alias("summary"),
        F.coalesce("e.published", F.lit("")).alias("published"),
        F.col("url").alias("feed_url"),
    )


def page_documents(fetches: DataFrame) -> DataFrame:
    """Fetched contents that hold no feed entries: the visible text of the page is the document."""
    parsed = fetches.withColumn("_x", F.when(looks_like_xml(F.col("content")), _feed(F.col("content"))))
    entries = F.coalesce(F.size("_x.channel.item"), F.lit(-1)) + F.coalesce(F.size("_x.entry"), F.lit(-1))
    pages = parsed.where(F.coalesce(entries, F.lit(-2)) <= -1)
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    return html_to_text(pages, "content").select(
        entry_id(F.col("url"), F.lit("")).alias("entry_id"), "feed", "url", text.alias("text"), F.lit("").alias("published")
    ).where("text <> ''")


def fetch_documents(fetches: DataFrame) -> DataFrame:
    """All documents of fetched feeds: their entries, or the page itself."""
    return entry_documents(rss_entries(fetches)).union(page_documents(fetches))


def entry_id(url: Column, title: Column) -> Column:
    return F.sha2(F.concat(url, F.lit("|"), title), 256)


def entry_documents(entries: DataFrame) -> DataFrame:
    return entries.select(
        entry_id(F.col("link"), F.col("title")).alias("entry_id"), "feed", F.col("link").alias("url"),
        F.concat("title", F.lit(" "), "summary").alias("text"), "published",
    )


#: Elements whose contents nobody sees.
HIDDEN = ("script", "style", "template", "noscript")


def strip_tags(html: Column) -> Column:
    """Visible text of a page: comments and the bodies of hidden elements vanish, tags
    become a blank. A quoted ">" does not end a tag."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for name in HIDDEN:
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ")
    return F.regexp_replace(out, r"""<[/!?a-zA-Z][^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+>""", " ")


def html_to_text(pages: DataFrame, html: str = "html") -> DataFrame:
    staged = pages.withColumn("text", strip_tags(F.col(html)))
    return staged.withColumn("text", U.normalize(F.col("text"), ["html_entities"], F.col("text")))


def techniques_from_stix(objects: DataFrame) -> DataFrame:
    """Technique rows from bundle objects.

    ``objects``: type, name, description, x_mitre_shortname, revoked,
    x_mitre_deprecated, external_references, kill_chain_phases, x_mitre_platforms,
    x_mitre_detection. Tactic names come from the bundle, else from the phase name.
    """
    tactics = objects.where(F.col("type") == "x-mitre-tactic").select(
        F.col("x_mitre_shortname").alias("phase"), F.col("name").alias("tactic")
    ).dropDuplicates(["phase"])
    live = objects.where(
        (F.col("type") == "attack-pattern") & ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False))
    ).withColumn("id", F.get(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(0))["external_id"])
    live = live.where(F.coalesce("id", F.lit("")) != "")
    phases = live.select("id", F.posexplode(F.transform("kill_chain_phases", lambda p: p["phase_name"])).alias("pos", "phase"))
    named = phases.join(tactics, "phase", "left").withColumn(
        "tactic", F.coalesce("tactic", F.initcap(F.replace("phase", F.lit("-"), F.lit(" "))))
    )
    lists = named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tactic"))), lambda x: x["tactic"]).alias("tactics"))
    return live.join(lists, "id", "left").select(
        "id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("tactics", F.array().cast("array<string>")).alias("tactics"),
        F.col("x_mitre_platforms").alias("platforms"), F.coalesce("x_mitre_detection", F.lit("")).alias("detection"),
        F.col("id").contains(".").alias("is_subtechnique"),
    )


STIX_OBJECT = (
    "struct<type:string,name:string,description:string,x_mitre_shortname:string,revoked:boolean,x_mitre_deprecated:boolean,"
    "external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<phase_name:string>>,"
    "x_mitre_platforms:array<string>,x_mitre_detection:string>"
)
SAMPLE = "struct<id:string,text:string,expected_iocs:array<struct<value:string,type:string>>,category:string,tags:array<string>>"


def bundle_objects(bodies: DataFrame) -> DataFrame:
    return bodies.select(F.explode(F.from_json("body", f"struct<objects:array<{STIX_OBJECT}>>")["objects"]).alias("o")).select("o.*")


def ground_truth(bodies: DataFrame) -> DataFrame:
    """Labelled samples from a bare list or ``{"samples": [...]}``."""
    wrapped = F.from_json("body", f"struct<samples:array<{SAMPLE}>>")["samples"]
    bare = F.from_json("body", f"array<{SAMPLE}>")
    return bodies.select(F.explode(F.when(F.trim("body").startswith("["), bare).otherwise(wrapped)).alias("s")).select("s.*")


def build_labelled(reports: DataFrame, replies: DataFrame, base_id: str = "real_world") -> DataFrame:
    """Labelled samples from reports and label replies joined on ``seq``: blank texts
    are skipped, missing ids are numbered, and the JSON array inside a reply is read.
    An unreadable reply labels nothing."""
    kept = reports.where(F.coalesce("text", F.lit("")) != "")
    array = F.regexp_extract(F.coalesce("reply", F.lit("")), r"(?s)\[.*\]", 0)
    labels = F.coalesce(F.from_json(array, "array<struct<value:string,type:string>>"), F.array().cast("array<struct<value:string,type:string>>"))
    return kept.join(replies, "seq", "left").select(
        F.coalesce("id", F.format_string(f"{base_id}_%04d", F.col("seq"))).alias("id"), "text", labels.alias("expected_iocs"),
        F.coalesce("category", F.lit("true_positive")).alias("category"),
    )


# --- sinks ------------------------------------------------------------------
IOC_COLUMNS = [
    "feed", "ioc", "type", "severity", "confidence", "fused_confidence", "verdict_confidence", "verified", "reasoning",
    "deobfuscated", "timestamp", "source_url",
]


def write_iocs(iocs: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Normalized indicators as JSON lines, CSV with a header, or parquet by day."""
    rows = iocs.select(*IOC_COLUMNS)
    if fmt == "csv":
        rows.write.mode(mode).option("header", True).csv(path)
    elif fmt == "json":
        rows.write.mode(mode).json(path)
    else:
        rows.withColumn("day", F.to_date("timestamp")).write.mode(mode).partitionBy("day").parquet(path)


def append_summaries(rows: DataFrame, path: str, fmt: str = "json") -> None:
    rows.write.mode("append").format(fmt).option("header", True).save(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, version: str = "1.0") -> None:
    """Graph snapshot: two tables and the schema version with each."""
    for name, table in (("nodes", nodes), ("edges", edges)):
        table.withColumn("schema_version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str, version: str = "1.0") -> tuple[DataFrame, DataFrame]:
    tables = []
    for name in ("nodes", "edges"):
        table = spark.read.parquet(f"{path}/{name}")
        found = table.select("schema_version").limit(1).collect()
        if found and found[0][0] != version:
            raise ValueError(f"graph schema {found[0][0]} found, {version} expected")
        tables.append(table.drop("schema_version"))
    return tables[0], tables[1]
