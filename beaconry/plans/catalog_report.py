"""Registered queries: sources, enrichment, prediction and summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from beaconry import constants as C
from beaconry.functions.columns import spread
from beaconry.functions.lineage import cut, work_folder
from beaconry.operators import context as X
from beaconry.operators import enrich as N
from beaconry.operators import graph as G
from beaconry.operators import nearest as NV
from beaconry.operators import predict as P
from beaconry.operators import store as S
from beaconry.operators import summaries as M
from beaconry.operators import verify as Y
from beaconry.plans import catalog_graph as KG
from beaconry.plans import oracle_text as O
from beaconry.plans import views as V
from beaconry.sources import feeds as D


def as_of():
    return F.expr(V.AS_OF)


def lit(x):
    return O.lit(x)


# --- sources: table rows serialized to the source formats -------------------
# Each document row as its own small fetch dump.
_STATUS = "if(doc_id % 7 = 0, 'failed', 'success')"


def fetch_bodies(spark, sf_dir):
    """One JSON object per document row: its own little fetch dump."""
    rows = V.table(spark, sf_dir, "documents")
    fetch = (
        f"named_struct('status', {_STATUS}, 'url', 'https://feeds.example.net/' || source, 'content', text, 'category', lang, "
        "'source_type', 'rss', 'reliability', if(doc_id % 3 = 0, null, 0.5D + doc_id % 5 / 10))"
    )
    return rows.selectExpr(f"to_json(map(source || '-' || doc_id, {fetch})) as body")


def fetches(spark, sf_dir):
    return D.fetch_rows(fetch_bodies(spark, sf_dir)).select("feed", "url", "content", "category", "reliability")


_PAGE_RSS = (
    "'<rss version=\"2.0\"><channel><title>Feed ' || cast(page_id % 9 as string) || '</title><item><title>A ' || cast(page_id as string) "
    "|| '</title><link>https://x.example.net/' || cast(page_id as string) || '</link><description>d ' || cast(page_id * 3 as string) "
    "|| '</description></item><item><title>B ' || cast(page_id as string) || '</title></item></channel></rss>'"
)


def rss_fetches(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").selectExpr("'p' || page_id as feed", "url", f"if(page_id % 4 = 0, 'plain text', {_PAGE_RSS}) as content")


def rss_entries(spark, sf_dir):
    return D.rss_entries(rss_fetches(spark, sf_dir))


_ENTRIES = """select 'p' || page_id::VARCHAR as feed, 'Feed ' || (page_id % 9)::VARCHAR as source, x.title || page_id::VARCHAR as title,
 case x.title when 'A ' then 'https://x.example.net/' || page_id::VARCHAR else url end as link, case x.title when 'A ' then 'd ' || (page_id * 3)::VARCHAR else '' end as summary,
 '' as published, url as feed_url from pages, (values ('A '), ('B ')) x(title) where page_id % 4 <> 0"""


def sniff(spark, sf_dir):
    rows = V.table(spark, sf_dir, "pages").selectExpr("page_id", "case page_id % 3 when 0 then html when 1 then 'text ' || substr(html, 1, 40) else '  note <?xml version=\"1.0\"?> ' || url end as content")
    return rows.select("page_id", D.looks_like_xml(F.col("content")).alias("is_xml"))


def pages_text(spark, sf_dir):
    return D.html_to_text(spread(V.table(spark, sf_dir, "pages"), "page_id")).select("page_id", "text")


def strip_tags(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", D.strip_tags(F.col("html")).alias("text"))


_FETCHES_READ = (
    "select source || '-' || doc_id::VARCHAR as feed, 'https://feeds.example.net/' || source as url, text as content, lang as category, "
    "case when doc_id % 3 = 0 then 0.5 else 0.5::DOUBLE + (doc_id % 5)::DOUBLE / 10 end as reliability from documents where doc_id % 7 <> 0"
)


def _stripped() -> str:
    out = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for name in D.HIDDEN:
        out = f"regexp_replace({out}, '(?is)<{name}\\b[^>]*>.*?</{name}\\s*>', ' ', 'g')"
    quoted = "\"[^\"]*\"|''[^'']*''"
    return f"regexp_replace({out}, '<[/!?a-zA-Z][^>\"'']*(?:(?:{quoted})[^>\"'']*)*>', ' ', 'g')"


# contents of four kinds: an Atom feed, two RSS feeds (one with summary instead of description), a page without entries
def mixed_fetches(spark, sf_dir):
    atom = (
        "'<feed xmlns=\"http://www.w3.org/2005/Atom\"><title>At</title><entry><title>T' || page_id || '</title><link href=\"https://a.example.net/' || page_id "
        "|| '\"/><summary>s' || page_id || '</summary><updated>2024-01-02</updated></entry></feed>'"
    )
    summary = "'<rss><channel><title>R</title><item><title>I' || page_id || '</title><summary>m' || page_id || '</summary></item></channel></rss>'"
    page = "'<html><head><title>P</title><script>var u=\"http://no.example\";</script></head><body><p title=\"a>b\">seen ' || page_id || '</p> <!-- x -->end</body></html>'"
    return V.table(spark, sf_dir, "pages").selectExpr(
        "'p' || page_id as feed", "url", f"case page_id % 4 when 0 then {page} when 1 then {atom} when 2 then {summary} else {_PAGE_RSS} end as content"
    )


def feed_documents(spark, sf_dir):
    return D.fetch_documents(mixed_fetches(spark, sf_dir)).select("feed", "url", "text", "published")


_FEED_DOCUMENTS = """select 'p' || page_id as feed, case page_id % 4 when 1 then 'https://a.example.net/' || page_id else url end as url,
 case page_id % 4 when 0 then 'P seen ' || page_id || ' end' when 1 then 'T' || page_id || ' s' || page_id else 'I' || page_id || ' m' || page_id end as text,
 case page_id % 4 when 1 then '2024-01-02' else '' end as published from pages where page_id % 4 < 3
 union all select 'p' || page_id, case x.t when 'A ' then 'https://x.example.net/' || page_id else url end,
 x.t || page_id || ' ' || case x.t when 'A ' then 'd ' || (page_id * 3) else '' end, '' from pages, (values ('A '), ('B ')) x(t) where page_id % 4 = 3"""


def fetches_read(spark, sf_dir):
    """Dumps written as JSON lines and read back through the reader."""
    folder = work_folder(spark)
    fetch_bodies(spark, sf_dir).write.text(folder)
    return D.read_fetches(spark, folder).select("feed", "url", "content", "category", "reliability")


# technique bundle: parts as techniques


def stix_bodies(spark, sf_dir):
    """One bundle per hundred parts, with two tactics in each."""
    obj = (
        "named_struct('type', 'attack-pattern', 'name', p_name, 'description', p_brand, 'x_mitre_shortname', cast(null as string), 'revoked', if(p_partkey % 11 = 0, true, null), "
        "'x_mitre_deprecated', p_partkey % 13 = 0, 'external_references', array(named_struct('source_name', 'capec', 'external_id', 'C1'), "
        "named_struct('source_name', 'mitre-attack', 'external_id', if(p_partkey % 17 = 0, '', 'T' || p_partkey || if(p_partkey % 5 = 0, '.001', '')))), "
        "'kill_chain_phases', array(named_struct('phase_name', 'initial-access'), named_struct('phase_name', if(p_size % 2 = 0, 'lateral-movement', 'resource-development'))), "
        "'x_mitre_platforms', array('Linux', p_brand), 'x_mitre_detection', cast(null as string))"
    )
    tactic = "named_struct('type', 'x-mitre-tactic', 'name', 'Initial Access (TA)', 'x_mitre_shortname', 'initial-access')"
    rows = V.table(spark, sf_dir, "part").selectExpr(f"concat('{{\"objects\":[', to_json({obj}), ',', to_json({tactic}), ']}}') as body")
    return rows


def techniques(spark, sf_dir):
    return D.techniques_from_stix(D.bundle_objects(stix_bodies(spark, sf_dir)))


_TECH = """select 'T' || p_partkey::VARCHAR || case when p_partkey % 5 = 0 then '.001' else '' end as id, p_name as name, p_brand as description,
 'Initial Access (TA), ' || case when p_size % 2 = 0 then 'Lateral Movement' else 'Resource Development' end as tactics, p_partkey % 5 = 0 as is_subtechnique
 from part where p_partkey % 11 <> 0 and p_partkey % 13 <> 0 and p_partkey % 17 <> 0"""

# labelled samples as JSON bodies, in both shapes
_SAMPLE = (
    "named_struct('id', 's' || doc_id, 'text', text, 'expected_iocs', if(doc_id % 3 = 0, array(), array(named_struct('value', 'v' || doc_id, 'type', 'domain'))), "
    "'category', if(doc_id % 2 = 0, 'true_positive', 'edge_case'), 'tags', array(lang))"
)


def ground_truth(spark, sf_dir):
    rows = V.table(spark, sf_dir, "documents").selectExpr(
        f"if(doc_id % 2 = 0, to_json(array({_SAMPLE})), to_json(named_struct('samples', array({_SAMPLE})))) as body"
    )
    return D.ground_truth(rows).select("id", "text", F.size("expected_iocs").alias("n"), "category", F.array_join("tags", ",").alias("tags"))


LABEL_REPORTS = "select conv_id * 100 + turn as seq, case when turn % 3 = 0 then 'r' || cast(conv_id as string) || '-' || cast(turn as string) end as id, case when turn % 5 = 4 then '' else text end as text, cast(null as string) as category from conversations"
LABEL_REPLIES = """select conv_id * 100 + turn as seq, case turn % 3 when 0 then 'Here: [{"value": "a' || cast(conv_id as string) || '.top", "type": "domain"}, {"value": "1.2.3.4", "type": "ip"}] done' when 1 then 'none' else '[]' end as reply from conversations"""


def build_labelled(spark, sf_dir):
    out = D.build_labelled(V.view(spark, sf_dir, LABEL_REPORTS, "conversations"), V.view(spark, sf_dir, LABEL_REPLIES, "conversations"))
    return out.select("id", "text", F.array_join(F.transform("expected_iocs", lambda e: F.concat(e["type"], F.lit("="), e["value"])), ";").alias("labels"), "category")


# --- enrichment -------------------------------------------------------------
HITS = """select event_id, case event_id % 4 when 0 then '45.' || cast(event_id % 25 as string) || '.' || cast(user_id % 250 as string) || '.7'
 when 1 then 'http://d' || cast(user_id % 60 as string) || '[.]evil.ru/x/y' when 2 then 'https://45.' || cast(event_id % 30 as string) || '.3.9/a' else 'free text ' || event_type end as ioc from events"""
RANGES = """select (45 * 256 + n_nationkey) * cast(65536 as bigint) + case when n_nationkey % 4 = 0 then 40000 else 0 end as low,
 (45 * 256 + n_nationkey) * cast(65536 as bigint) + case when n_nationkey % 5 = 0 then 65535 + 30000 * (n_nationkey % 2) - 30000 * (n_nationkey % 2) else 65535 end as high, n_name as country, 'org-' || cast(n_regionkey as string) as org from nation"""
REGISTRATIONS = "select 'd' || cast(s_suppkey % 60 as string) || '.evil.ru' as domain, min(s_name) as registrar from supplier group by s_suppkey % 60"
ANSWERS = "select 'd' || cast(s_suppkey % 60 as string) || '.evil.ru' as domain, min('45.' || cast(s_suppkey % 60 % 25 as string) || '.200.1') as resolved_ip from supplier where s_suppkey % 60 % 3 <> 0 group by s_suppkey % 60"


def enrich(spark, sf_dir):
    return N.enrich(
        V.view(spark, sf_dir, HITS, "events"), V.view(spark, sf_dir, RANGES, "nation"),
        V.view(spark, sf_dir, REGISTRATIONS, "supplier"), V.view(spark, sf_dir, ANSWERS, "supplier"),
    ).select("event_id", "clean_ioc", "kind", "registrar", "resolved_ip", "country", "org")


_CLEAN = "replace(replace(split_part(replace(replace(ioc, 'http://', ''), 'https://', ''), '/', 1), '[.]', '.'), '[:]', ':')"
_ENRICH_SQL = f"""with h as (select event_id, {_CLEAN} as clean_ioc from ({HITS})),
 k as (select *, case when regexp_full_match(clean_ioc, '[0-9]+(\\.[0-9]+){{3}}') then 'ip' when contains(clean_ioc, '.') and not contains(clean_ioc, ' ') then 'domain' end as kind from h),
 j as (select k.*, r.registrar, a.resolved_ip, case when kind = 'ip' then clean_ioc else a.resolved_ip end as address from k left join ({REGISTRATIONS}) r on r.domain = clean_ioc left join ({ANSWERS}) a on a.domain = clean_ioc where kind is not null),
 n as (select *, {O._ipnum('address')} as num from j)
 select event_id, clean_ioc, kind, registrar, resolved_ip, country, org from n left join ({RANGES}) g on num between g.low and g.high"""


# --- prediction -------------------------------------------------------------
def _pairs(spark, sf_dir):
    return G.pair_edges(V.mentions(spark, sf_dir))


STARTS = "select distinct 'c' || cast(doc_id % 60 as string) || '.evil.top' as seed from documents"


def hops(n, keep):
    def run(spark, sf_dir):
        return P.multi_hop(_pairs(spark, sf_dir), V.view(spark, sf_dir, STARTS, "documents"), n, keep)

    return run


_HOPS = f"""{KG._M}, {KG._PAIRS}, sym as (select src as a, dst as b from pairs union select dst, src from pairs), st as ({STARTS}),
 h1 as (select distinct seed, 1 as hop, b as neighbour from st join sym on a = seed where b <> seed),
 h2 as (select distinct seed, 2 as hop, b as neighbour from h1 join sym on a = h1.neighbour where b <> seed and (seed, b) not in (select seed, neighbour from h1))"""


def retrieval_text(spark, sf_dir):
    return P.retrieval_text(KG.campaigns(spark, sf_dir))


_PHRASE = "case type " + " ".join(f"when '{k}' then {lit(x)}" for k, x in C.TYPE_PHRASES.items()) + " end"

QUERY_VECTORS = "vec_id < 10"


def topk(sub, metric="sql2"):
    def run(spark, sf_dir):
        vectors = V.table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "embedding", "label % 2 = 1 as is_subtechnique")
        queries = V.table(spark, sf_dir, "embeddings").where(QUERY_VECTORS).selectExpr("vec_id as query_id", "embedding as q_embedding")
        return P.vector_topk(queries, vectors, 5, sub, metric).withColumn("similarity", F.round("similarity", 2))

    return run


def _topk_sql(sub: bool, metric: str = "sql2") -> str:
    dist = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
    if metric == "l2":
        dist = f"sqrt({dist})"
    return f"""with d as (select q.vec_id as query_id, e.vec_id as id, e.label % 2 = 1 as is_sub, {dist} as dist from embeddings e, (select * from embeddings where vec_id < 10) q),
 f as (select * from d qualify row_number() over (partition by query_id order by dist, id) <= {5 if sub else 10})
 select query_id, id, row_number() over (partition by query_id order by dist, id)::INT as rank, round(round(1 / (1 + dist), 3), 2) as similarity from f where {'true' if sub else 'not is_sub'} qualify rank <= 5"""


def nearest_blocks(metric="sql2"):
    """Every twentieth vector against all, in several blocks."""

    def run(spark, sf_dir):
        table = V.table(spark, sf_dir, "embeddings")
        queries = table.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
        found = NV.nearest(queries, table.withColumnRenamed("vec_id", "id"), 5, F.expr("label % 2 = 0"), metric, 64, 512)
        return found.withColumn("similarity", F.round("similarity", 2))

    return run


def _nearest_sql(metric: str = "sql2") -> str:
    near = _topk_sql(True, metric).replace("where vec_id < 10", "where vec_id % 20 = 0")
    return near.replace("(select * from embeddings where vec_id % 20 = 0) q", "(select * from embeddings where vec_id % 20 = 0) q where e.label % 2 = 0")


def technique_text(spark, sf_dir):
    return P.technique_text(techniques(spark, sf_dir))


def technique_counts(spark, sf_dir):
    return techniques(spark, sf_dir).groupBy("is_subtechnique").agg(F.count("*").alias("n"))


def profile_rows(spark, sf_dir):
    rows = KG.campaigns(spark, sf_dir)
    starts = P.seeds(rows)
    found = P.multi_hop(G.pair_edges(V.mentions(spark, sf_dir, hub=False)), starts.select("seed"))
    return P.profile(rows, starts.join(found, "seed"))


def profile_stage(spark, sf_dir):
    rows = profile_rows(spark, sf_dir)
    return rows.select("campaign_id", P.stage_from_words("profile").alias("stage"))


def multi_hop_hub(spark, sf_dir):
    """Every indicator as a seed, on mentions whose hub ties all families together."""
    mentions = V.mentions(spark, sf_dir)
    return X.expand(G.pair_edges(mentions), mentions.select(F.col("ioc").alias("seed")))


def campaign_context(spark, sf_dir):
    """The vector of a campaign is the one with its member count as id; a technique's has its number."""
    rows = cut(KG.campaigns(spark, sf_dir))
    known = cut(techniques(spark, sf_dir))
    embeddings = V.table(spark, sf_dir, "embeddings")
    vectors = known.join(embeddings, F.regexp_extract("id", r"^T(\d+)", 1).cast("long") == F.col("vec_id")).select("id", "embedding", "is_subtechnique")
    queries = rows.join(embeddings, F.col("ioc_count") == F.col("vec_id")).select(F.col("campaign_id").alias("query_id"), F.col("embedding").alias("q_embedding"))
    return X.context_rows(rows, G.pair_edges(V.mentions(spark, sf_dir)), known, P.vector_topk(queries, vectors, 5))


def technique_lookup(spark, sf_dir):
    """Known ids, one with a sub-technique's suffix, and one that no technique has."""
    known = techniques(spark, sf_dir)
    return X.technique(known, F.lit("T7")).union(X.technique(known, F.lit("T10.001"))).union(X.technique(known, F.lit("T0"))).select("id", "name", "is_subtechnique")


def _neighbourhood_sql(starts: str) -> str:
    return f"""allm as ({V.MENTIONS}), {KG._PAIRS.replace(" m ", " allm ")}, sym as (select src as a, dst as b from pairs where src <> dst union select dst, src from pairs where src <> dst),
 st as ({starts}), h1 as (select distinct seed, 1 as hop, b as neighbour from st join sym on a = seed where b <> seed),
 h2 as (select distinct seed, 2 as hop, b as neighbour from h1 join sym on a = h1.neighbour where b <> seed and (seed, b) not in (select seed, neighbour from h1)),
 hops as (select seed, hop, neighbour from (select * from h1 union all select * from h2) qualify row_number() over (partition by seed, hop order by neighbour) <= 15)"""


_SEEDS = "select distinct id as seed from (select community, id, row_number() over (partition by community order by id) as n from mem) where n <= 50"
_CONTEXT = f"""with {KG.MEMBERS}, {_neighbourhood_sql(_SEEDS)},
 own as (select c.campaign_id, c.community, s.id as seed, h.hop, h.neighbour from camp c
   join (select community, id, row_number() over (partition by community order by id) as n from mem) s on s.community = c.community and s.n <= 50 join hops h on h.seed = s.id),
 total as (select campaign_id, count(distinct seed) as connected, count(*) as nodes, count(distinct hop) as hops from own group by 1),
 often as (select campaign_id, hop, neighbour, count(*) as times from own group by all),
 top5 as (select * from often qualify row_number() over (partition by campaign_id, hop order by times desc, neighbour) <= 5),
 listed as (select campaign_id, array_to_string(list(neighbour || ' (' || times || 'x)' order by times desc, neighbour) filter (where hop = 1), ', ') as one,
   array_to_string(list(neighbour || ' (' || times || 'x)' order by times desc, neighbour) filter (where hop = 2), ', ') as two from top5 group by 1),
 types as (select community, array_to_string(list(type || ': ' || n order by n desc, type), ', ') as shown, array_to_string(list({_PHRASE} order by n desc, type), ' ') as phrases
   from (select community, type, count(*) as n from mem group by all) group by 1),
 severities as (select community, array_to_string(list(severity || ': ' || n order by n desc, severity), ', ') as shown from (select community, severity, count(*) as n from sev group by all) group by 1),
 samples as (select community, array_to_string(list(id order by id)[1:10], ', ') as shown from mem group by 1),
 profiles as (select c.campaign_id, array_to_string(list_filter(['Campaign: ' || c.label, 'Total IOCs: ' || c.ioc_count, 'First seen: ' || strftime(c.first_seen, '%Y-%m-%d %H:%M:%S'),
   'Last seen: ' || strftime(c.last_seen, '%Y-%m-%d %H:%M:%S'), case when duration_hours <> 0 then printf('Duration: %.1f hours', duration_hours) end, 'IOC types: ' || t.shown,
   'Severity distribution: ' || v.shown, 'Sample IOCs: ' || m.shown,
   case when connected > 0 then 'Graph connectivity: ' || connected || ' IOCs connected to ' || nodes || ' nodes across ' || hops || ' hops'
     else 'Graph connectivity: No known graph connections for this campaign' end,
   'Hop-1 neighbors (immediate blast radius): ' || l.one, 'Hop-2 neighbors (extended threat web): ' || l.two], lambda x: x is not null), chr(10)) as profile
   from camp c join types t using (community) join severities v using (community) join samples m using (community) left join total using (campaign_id) left join listed l using (campaign_id))"""
_CONTEXT_SQL = f"""{_CONTEXT}, tech as (select t.*, e.embedding from ({_TECH}) t join embeddings e on e.vec_id = regexp_extract(t.id, '^T([0-9]+)', 1)::BIGINT),
 near as (select c.campaign_id, t.*, list_sum(list_transform(list_zip(q.embedding, t.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) as dist
   from camp c join embeddings q on q.vec_id = c.ioc_count, tech t),
 near5 as (select *, row_number() over (partition by campaign_id order by dist, id) as rank from near qualify rank <= 5),
 tlines as (select campaign_id, array_to_string(list('- ' || id || ' ' || name || ' (Tactics: ' || tactics || '): ' || substr(description, 1, 200) order by rank), chr(10)) as technique_context from near5 group by 1),
 five as (select campaign_id, seed, neighbour from own where hop = 1 qualify row_number() over (partition by campaign_id, seed order by neighbour) <= 5),
 glines as (select campaign_id, seed, '- ' || seed || ' is connected to: ' || array_to_string(list(neighbour order by neighbour), ', ') as line from five group by campaign_id, seed
   qualify row_number() over (partition by campaign_id order by seed) <= 10),
 graphs as (select campaign_id, array_to_string(list(line order by seed), chr(10)) as graph_context from glines group by 1)
 select c.campaign_id, c.label, c.ioc_count, c.first_seen, c.last_seen, c.duration_hours, t.phrases || case when n_high > 0 then ' {C.SEVERE_PHRASE}' else '' end as query, p.profile,
   coalesce(g.graph_context, 'No significant graph connections found.') as graph_context, coalesce(k.technique_context, '') as technique_context
 from camp c join types t using (community) join profiles p using (campaign_id) left join graphs g using (campaign_id) left join tlines k using (campaign_id)"""

STAGE_TEXTS = "select doc_id, text || case doc_id % 6 when 0 then ' domain url whois tunnel' when 1 then ' sha256 sha1 dns' when 2 then ' Critical' when 3 then ' c2 ipv4' else '' end as profile from documents"


def stage_heuristic(spark, sf_dir):
    return V.view(spark, sf_dir, STAGE_TEXTS, "documents").select("doc_id", P.stage_from_words("profile").alias("stage"))


def _stage_sql() -> str:
    parts = []
    for i, (stage, words) in enumerate(C.STAGE_WORDS.items()):
        total = " + ".join(f"(length(p) - length(replace(p, '{w}', ''))) // {len(w)}" for w in words)
        parts.append(f"select doc_id, '{stage}' as stage, {i} as o, {total} as score, p from d")
    return f"""with d as (select doc_id, lower(profile) as p from ({STAGE_TEXTS})), s as ({' union all '.join(parts)}), b as (select * from s qualify row_number() over (partition by doc_id order by score desc, o) = 1)
 select doc_id, case when score > 0 then stage when contains(p, 'critical') then 'Impact' when contains(p, 'high') then 'Lateral Movement' else 'Reconnaissance' end as stage from b"""


_PROFILES = _CONTEXT.replace(V.MENTIONS, V.MENTIONS_PLAIN)


def _profile_stage_sql() -> str:
    source = f"with d as (select doc_id, lower(profile) as p from ({STAGE_TEXTS}))"
    own = f"{_PROFILES}, d as (select campaign_id as doc_id, lower(profile) as p from profiles)"
    return _stage_sql().replace(source, own).replace("select doc_id, case when score", "select doc_id as campaign_id, case when score")


STAGE_REPLIES = "select event_id, case event_id % 7 when 0 then 'execution' when 1 then 'Likely COLLECTION stage' when 2 then 'command' when 3 then 'Impact' when 4 then 'nonsense xyz' when 5 then 'Initial access' else 'Defense Evasion, Discovery' end as reply from events"
_STAGE_LIST = "[" + ", ".join(lit(s) for s in C.STAGES) + "]"
_KNOWN = f"""select r.event_id, coalesce((select s from (select unnest({_STAGE_LIST}) as s, unnest(range(14)) as i) where lower(s) = lower(reply) order by i limit 1),
 (select s from (select unnest({_STAGE_LIST}) as s, unnest(range(14)) as i) where contains(lower(reply), lower(s)) or contains(lower(s), lower(reply)) order by i limit 1), 'Reconnaissance') as stage from ({STAGE_REPLIES}) r"""


def known_stage(spark, sf_dir):
    return V.view(spark, sf_dir, STAGE_REPLIES, "events").select("event_id", P.known_stage(F.col("reply")).alias("stage"))


def next_stages(spark, sf_dir):
    return P.next_stages(known_stage(spark, sf_dir), "event_id", "stage").select("event_id", "step", "tactic", "confidence", "technique_name")


PREDICTION_REPLIES = """select conv_id, turn, case (conv_id + turn) % 4
 when 0 then '{"current_stage": "Execution", "predictions": [{"tactic": "Impact", "technique_id": "T1", "technique_name": "n", "confidence": 1.5}, {"tactic": "Discovery", "confidence": 0.25}, {"confidence": 0.1}, {"tactic": "Fourth"}], "defensive_recommendations": ["a", "b", "c", "d", "e", "f"]}'
 when 1 then 'text ```json' || chr(10) || '{"predictions": [{"tactic": "Persistence", "confidence": ' || cast(cast(conv_id % 100 as double) / 100 as string) || '}]}' || chr(10) || '``` tail'
 when 2 then 'so {"current_stage": "Impact", "predictions": []} ok' else 'nothing' end as raw_reply from conversations"""


def parse_predictions(spark, sf_dir):
    rows = P.parse_predictions(V.view(spark, sf_dir, PREDICTION_REPLIES, "conversations"))
    shown = F.array_join(F.transform("predictions", lambda p: F.concat_ws("/", p["tactic"], p["technique_id"], F.format_string("%.2f", p["confidence"]))), ";")
    return rows.select("conv_id", "turn", shown.alias("predictions"), F.size("recommendations").alias("n_recommendations"), "replied_stage")


_STAGE_OF = "case when turn % 5 = 4 then null when turn % 5 = 3 then 'Elsewhere' " + " ".join(f"when conv_id % 14 = {i} then '{name}'" for i, name in enumerate(C.STAGES)) + " end"


def forecast(spark, sf_dir):
    rows = V.view(spark, sf_dir, PREDICTION_REPLIES, "conversations").withColumn("stage", F.expr(_STAGE_OF))
    shown = F.array_join(F.transform("predictions", lambda p: F.concat_ws("/", p["tactic"], p["technique_id"], F.format_string("%.2f", p["confidence"]))), ";")
    return P.forecast(rows, "stage").select("conv_id", "turn", "fallback", shown.alias("predictions"), F.array_join("recommendations", "|").alias("recommendations"))


_PP_SQL = f"""select conv_id, turn, case (conv_id + turn) % 4 when 0 then 'Impact/T1/1.00;Discovery/T0000/0.25;Unknown/T0000/0.10' when 1 then 'Persistence/T0000/' || printf('%.2f', (conv_id % 100) / 100.0) when 2 then '' end as predictions,
 case (conv_id + turn) % 4 when 0 then 5 else 0 end::INT as n_recommendations, case (conv_id + turn) % 4 when 0 then 'Execution' when 2 then 'Impact' end as replied_stage from conversations"""

_FORECAST_SQL = f"""with p as ({_PP_SQL}), l as (select {_STAGE_LIST} as names), f as (select p.*, (p.conv_id + p.turn) % 4 = 3 as fallback, greatest(coalesce(list_position(names, {_STAGE_OF}), 0), 1) as at1, names from p, l)
 select conv_id, turn, fallback, case when fallback then names[least(at1 + 1, 14)] || '/T0000/0.60;' || names[least(at1 + 2, 14)] || '/T0000/0.40;' || names[least(at1 + 3, 14)] || '/T0000/0.30' else predictions end as predictions,
 case when fallback then '{"|".join(C.FALLBACK_RECOMMENDATIONS)}' when n_recommendations = 5 then 'a|b|c|d|e' else '' end as recommendations from f"""

PREDICTIONS = """select 'pred_' || cast(o_custkey as string) || '_' || cast(o_orderkey as string) as pred_id, 'camp' || cast(o_custkey as string) as campaign_id, case o_orderstatus when 'F' then 'Impact' when 'O' then 'Discovery' else 'Execution' end as tactic,
 cast(o_orderkey % 71 as double) / 100 as confidence, cast(o_orderdate as timestamp) as generated_at from orders"""


def predictions(spark, sf_dir):
    return V.view(spark, sf_dir, PREDICTIONS, "orders")


def upsert_predictions(spark, sf_dir):
    """Campaign predictions twice a day: one per campaign and day is left."""
    rows = predictions(spark, sf_dir).drop("pred_id").withColumn("generated_at", F.expr("generated_at + confidence * interval '10' hour"))
    once = rows.groupBy("campaign_id", "generated_at").agg(F.max("tactic").alias("tactic"))
    return S.upsert_predictions(None, once).select("pred_id", "tactic", "generated_at")


def to_predict(spark, sf_dir):
    rows = KG.campaigns(spark, sf_dir)
    done = rows.where("ascii(substr(campaign_id, 25, 1)) % 2 = 0").select("campaign_id", F.expr(V.LATE).alias("generated_at"))
    return P.to_predict(rows, done, F.expr(V.LATE)).select("campaign_id")


# --- summaries --------------------------------------------------------------
SUMMARIES = """select conv_id * 100 + turn as id, role, text || case conv_id % 5 when 0 then ' phishing payload with ransomware and a keylogger' when 1 then ' lateral movement, c2 beacon' else '' end as summary,
 case (conv_id + turn) % 6 when 0 then 'Critical' when 1 then 'High' when 2 then 'Medium' when 3 then 'Low' when 4 then 'very high' else null end as severity,
 case turn % 3 when 0 then 'INVALID: Low' when 1 then 'VALID' else 'INVALID' end as validation,
 timestamp '2024-01-01 00:00:00' + (conv_id * 7 + turn) * interval '1' hour as timestamp from conversations"""


def summaries(spark, sf_dir):
    return V.view(spark, sf_dir, SUMMARIES, "conversations")


def tactic_tags(spark, sf_dir):
    return summaries(spark, sf_dir).select("id", F.array_join(M.tactic_tags(F.col("summary")), ",").alias("tactics"))


def _tags_sql() -> str:
    hits = ", ".join("case when " + " or ".join(f"contains(s, {lit(w)})" for w in words) + f" then {lit(t)} end" for t, words in M.TACTIC_WORDS.items())
    return f"select id, array_to_string(list_filter([{hits}], lambda t: t is not null)[1:5], ',') as tactics from (select id, lower(summary) as s from ({SUMMARIES}))"


TTP_REPLIES = """select id, summary, case id % 3 when 0 then 'x ```json {"ttps": [{"technique_id": "T1", "tactic": "Impact", "confidence": 0.9}, {"technique_id": "T2", "tactic": "Discovery", "confidence": 0.4}]} ```'
 when 1 then 'reply {"note": 1, "ttps": [{"tactic": "Execution", "confidence": 0.5}]} end' else null end as reply from (SRC) s""".replace("SRC", SUMMARIES)


def technique_rows(spark, sf_dir):
    return M.technique_rows(V.view(spark, sf_dir, TTP_REPLIES, "conversations"), "id", "summary", "reply")


RECS = """select id, summary || chr(10) || 'Recommended actions:' || chr(10) || '1. Block the host ' || cast(id as string) || chr(10) || ' - short' || chr(10) || '- Rotate all credentials' || chr(10) || 'plain line' || chr(10)
 || '• Review mail gateway logs' || chr(10) || '4) Patch server ' || cast(id % 7 as string) || chr(10) || 'Response plan' || chr(10) || '5. Isolate the segment' || chr(10) || '6. Notify every stakeholder' as summary from (SRC) s""".replace("SRC", SUMMARIES)


def recommendations(spark, sf_dir):
    rows = V.view(spark, sf_dir, RECS, "conversations")
    return rows.select("id", F.array_join(M.recommendations(F.col("summary")), "|").alias("recommendations"))


_RECS_SQL = f"""with l as (select id, unnest(string_split(summary, chr(10))) as line, unnest(range(1, len(string_split(summary, chr(10))) + 1)) as i from ({RECS})),
 f as (select id, i, trim(line) as line, regexp_matches(lower(line), 'recommend|action|response') as hit from l), g as (select *, bool_or(hit) over (partition by id order by i) as after from f),
 c as (select id, i, trim(regexp_replace(line, '^[0-9.\\-•) ]+', '')) as item from g where after and not hit and regexp_matches(line, '^([0-9]|-|•)')),
 k as (select * from c where length(item) > 10 qualify row_number() over (partition by id order by i) <= 5) select id, array_to_string(list(item order by i), '|') as recommendations from k group by id"""


def pending(spark, sf_dir):
    lines = V.table(spark, sf_dir, "events").selectExpr("'  ioc ' || user_id || ' ' || event_type as line", "event_id as line_no")
    done = V.table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr("'ioc ' || user_id || ' click' as line").where("substr(line, 5, 1) <> '1'").distinct()
    return M.pending(lines, done)


def capped(spark, sf_dir):
    rows = summaries(spark, sf_dir).withColumn("ttps", F.split("summary", " ")).withColumn("recommendations", F.split("summary", "\n"))
    return M.capped_details(rows).select("id", F.array_join("ttps", " ").alias("ttps"), F.size("recommendations").alias("n"))


def export_severity(spark, sf_dir):
    rows = summaries(spark, sf_dir)
    user = rows.where("role = 'user'").select("id", "severity", "validation")
    rest = rows.where("role <> 'user'").select("id", "severity", "role")
    return M.export_severity([user, rest], "High")


def on_summaries(fn):
    return lambda spark, sf_dir: fn(summaries(spark, sf_dir))


_S = f"with s as ({SUMMARIES}) "
_CAMPAIGN = f"with {KG.MEMBERS} "

QUERIES = {
    "fetches_success": (fetches, _FETCHES_READ),
    "rss_entries": (rss_entries, _ENTRIES),
    "entry_documents": (
        lambda spark, sf_dir: D.entry_documents(rss_entries(spark, sf_dir)),
        f"select sha256(link || '|' || title) as entry_id, feed, link as url, title || ' ' || summary as text, published from ({_ENTRIES})",
    ),
    "sniff_format": (sniff, "select page_id, page_id % 3 <> 1 as is_xml from pages"),
    "html_strip_tags": (strip_tags, f"select page_id, {_stripped()} as text from pages"),
    "feed_documents": (feed_documents, _FEED_DOCUMENTS),
    "fetches_read": (fetches_read, _FETCHES_READ),
    "html_to_text": (pages_text, None),
    "stix_techniques": (
        lambda spark, sf_dir: techniques(spark, sf_dir).select("id", "name", "description", F.array_join("tactics", ", ").alias("tactics"), "is_subtechnique"),
        _TECH,
    ),
    "ground_truth_read": (
        ground_truth,
        "select 's' || doc_id::VARCHAR as id, text, case when doc_id % 3 = 0 then 0 else 1 end::INT as n, case when doc_id % 2 = 0 then 'true_positive' else 'edge_case' end as category, lang as tags from documents",
    ),
    "build_labelled": (
        build_labelled,
        f"select coalesce(id, printf('real_world_%04d', seq)) as id, text, case seq % 100 % 3 when 0 then 'domain=a' || (seq // 100)::VARCHAR || '.top;ip=1.2.3.4' else '' end as labels, 'true_positive' as category from ({LABEL_REPORTS}) where text <> ''",
    ),
    "enrich_iocs": (enrich, _ENRICH_SQL),
    "clean_indicator": (
        lambda spark, sf_dir: V.view(spark, sf_dir, HITS, "events").select("event_id", N.clean_indicator(F.col("ioc")).alias("clean_ioc")),
        f"select event_id, {_CLEAN} as clean_ioc from ({HITS})",
    ),
    "multi_hop": (
        hops(2, 15),
        f"with {_HOPS} select seed, hop, neighbour from (select * from h1 union all select * from h2) qualify row_number() over (partition by seed, hop order by neighbour) <= 15",
    ),
    "one_hop": (hops(1, None), f"with {_HOPS} select * from h1"),
    "graph_context_lines": (
        lambda spark, sf_dir: P.context_lines(hops(1, None)(spark, sf_dir)),
        f"with {_HOPS}, c as (select seed, neighbour from h1 qualify row_number() over (partition by seed order by neighbour) <= 5) "
        "select seed, '- ' || seed || ' is connected to: ' || array_to_string(list(neighbour order by neighbour), ', ') as line from c group by seed order by seed limit 10",
    ),
    "retrieval_text": (
        retrieval_text,
        _CAMPAIGN + f", tp as (select community, type, count(*) as n from mem group by all), ph as (select community, array_to_string(list({_PHRASE} order by n desc, type), ' ') as p from tp group by community) "
        f"select campaign_id, p || case when n_high > 0 then ' {C.SEVERE_PHRASE}' else '' end as query from camp join ph using (community)",
    ),
    "vector_topk": (topk(True), _topk_sql(True)),
    "vector_topk_no_sub": (topk(False), _topk_sql(False)),
    "vector_topk_l2": (topk(True, "l2"), _topk_sql(True, "l2")),
    "nearest_blocks": (nearest_blocks(), _nearest_sql()),
    "nearest_blocks_l2": (nearest_blocks("l2"), _nearest_sql("l2")),
    "technique_text": (technique_text, f"select id, id || ' ' || name || ': ' || substr(description, 1, 500) || ' Tactics: ' || tactics as text from ({_TECH})"),
    "technique_counts": (technique_counts, f"select is_subtechnique, count(*) as n from ({_TECH}) group by 1"),
    "multi_hop_hub": (multi_hop_hub, f"with {_neighbourhood_sql('select distinct ioc as seed from allm')} select * from hops"),
    "campaign_context": (campaign_context, _CONTEXT_SQL),
    "technique_lookup": (technique_lookup, f"select id, name, is_subtechnique from ({_TECH}) where id in ('T7', 'T10.001', 'T0')"),
    "campaign_profile": (profile_rows, f"{_PROFILES} select campaign_id, profile from profiles"),
    "campaign_profile_stage": (profile_stage, _profile_stage_sql()),
    "stage_heuristic": (stage_heuristic, _stage_sql()),
    "known_stage": (known_stage, _KNOWN),
    "next_stages": (
        next_stages,
        f"with k as ({_KNOWN}), l as (select {_STAGE_LIST} as names), x as (select event_id, step, names[least(list_position(names, stage) + step, 14)] as tactic from k, l, range(1, 4) t(step)) "
        "select event_id, step::INT as step, tactic, round(greatest(0.3::DOUBLE, 0.8::DOUBLE - step * 0.2::DOUBLE), 4) as confidence, 'Predicted ' || tactic || ' technique' as technique_name from x",
    ),
    "parse_predictions": (parse_predictions, _PP_SQL),
    "forecast": (forecast, _FORECAST_SQL),
    "prediction_stats": (
        lambda spark, sf_dir: P.prediction_stats(predictions(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6)),
        f"with p as ({PREDICTIONS}), t as (select tactic, count(*) as n, round(avg(confidence), 6) as avg_confidence from p group by tactic) select t.*, (select count(distinct pred_id) from p) as total_predictions, "
        "(select count(distinct campaign_id) from p) as unique_campaigns, (select round(avg(confidence), 4) from p) as overall_confidence, (select arg_max(tactic, (n, tactic)) from t) as top_tactic from t",
    ),
    "prediction_history": (
        lambda spark, sf_dir: P.prediction_history(predictions(spark, sf_dir), "camp7").select("pred_id", "tactic", "generated_at"),
        f"select pred_id, tactic, generated_at from ({PREDICTIONS}) where campaign_id = 'camp7' order by generated_at desc, pred_id limit 10",
    ),
    "upsert_predictions": (
        upsert_predictions,
        f"with p as (select campaign_id, generated_at + confidence * interval '10' hour as g, tactic from ({PREDICTIONS})), q as (select campaign_id, g, max(tactic) as tactic from p group by all) "
        "select 'pred_' || campaign_id || '_' || strftime(g, '%Y-%m-%d') as pred_id, tactic, g as generated_at from q qualify row_number() over (partition by campaign_id, strftime(g, '%Y-%m-%d') order by g desc) = 1",
    ),
    "campaigns_to_predict": (
        to_predict,
        _CAMPAIGN + f"select campaign_id from (select * from camp where last_seen >= {V.LATE} - interval 48 hour order by campaign_id limit 10) where ascii(substr(campaign_id, 25, 1)) % 2 <> 0",
    ),
    "tactic_tags": (tactic_tags, _tags_sql()),
    "technique_rows": (
        technique_rows,
        "with a as (" + _tags_sql() + ") select id, 'T1' as technique_id, 'Impact' as tactic, 0.9::DOUBLE as confidence from a where id % 3 = 0 union all select id, '', 'Execution', 0.5 from a where id % 3 = 1 "
        "union all select id, '', unnest(string_split(tactics, ',')), 0.5 from a where id % 3 = 2 and tactics <> ''",
    ),
    "recommendations": (recommendations, _RECS_SQL),
    "severity_parse": (
        on_summaries(lambda s: s.select("id", Y.parse_severity(F.col("severity")).alias("parsed"))),
        _S + "select id, case when contains(lower(severity), 'low') then 'Low' when contains(lower(severity), 'medium') then 'Medium' when contains(lower(severity), 'high') then 'High' when contains(lower(severity), 'critical') then 'Critical' else 'Unknown' end as parsed from s",
    ),
    "severity_corrections": (
        on_summaries(lambda s: M.correct_severity(s).select("id", "severity", "original_severity", "corrected")),
        _S + "select id, case when starts_with(validation, 'INVALID') then trim(string_split(validation, ':')[-1]) else severity end as severity, case when starts_with(validation, 'INVALID') then severity end as original_severity, starts_with(validation, 'INVALID') as corrected from s",
    ),
    "pending_lines": (
        pending,
        "with l as (select trim('  ioc ' || user_id::VARCHAR || ' ' || event_type) as line, event_id from events), d as (select distinct 'ioc ' || user_id::VARCHAR || ' click' as line from events where event_type = 'error') "
        "select line, min(event_id) as line_no from l where line not in (select line from d where substr(line, 5, 1) <> '1') group by line",
    ),
    "summaries_by_severity": (
        on_summaries(lambda s: M.by_severity(s, "HIGH").select("id", "severity", "timestamp")),
        _S + "select id, severity, timestamp from s where lower(severity) = 'high' order by timestamp desc, id limit 50",
    ),
    "summary_stats": (
        lambda spark, sf_dir: M.stats(summaries(spark, sf_dir), V.ioc_store(spark, sf_dir)),
        f"with s as ({SUMMARIES}), i as ({V.IOC_STORE}) select count(*) as total, count(*) filter (where contains(lower(severity), 'critical')) as critical, greatest(count(*) filter (where contains(lower(severity), 'high')), (select count(*) from i where severity = 'High')) as high, "
        "count(*) filter (where contains(lower(severity), 'medium')) as medium, count(*) filter (where contains(lower(severity), 'low')) as low, (select count(*) from i) as raw_ioc_count from s",
    ),
    "report_facts": (
        on_summaries(M.report_facts),
        _S + "select 'severity' as fact, coalesce(severity, 'Unknown') as name, count(*) as n from s group by 2 union all (select 'item', severity, id from s where severity in ('Critical', 'High') order by id limit 10)",
    ),
    "report_caps": (capped, _S + "select id, array_to_string(string_split(summary, ' ')[1:5], ' ') as ttps, least(3, len(string_split(summary, chr(10))))::INT as n from s"),
    "export_by_severity": (
        export_severity,
        _S + "select id, severity, case when role = 'user' then validation end as validation, case when role <> 'user' then role end as role from s where severity = 'High'",
    ),
}
