"""Input views built from the driver's tables.

The given tables hold almost no indicators, so reports get planted ones by
arithmetic on their id. Each view is plain SQL text over the given tables, the
same for every engine, and covers whole tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beaconry.functions.columns import broadcast_if_small, spread

BACKSLASH = "chr(92)"
NEWLINE = "chr(10)"


def v(expr: str) -> str:
    return f"cast({expr} as string)"


# Masked forms, one kind per document.
MASKED = f"""case doc_id % 12
 when 0 then ' a​b-zero.evil.top'
 when 1 then ' ' || {BACKSLASH} || 'u0065vil-u.ru x' || {BACKSLASH} || 'x2eevil.ru y' || {BACKSLASH} || '056evil.cc'
 when 2 then ' раyраl-login.top'
 when 3 then ' ent&#46;evil.top &amp; more &#x68;ost.evil.top &lt;b.evil.top&gt;'
 when 4 then ' aHR0cDovL2I2NC1ob3N0LnJ1L2EuZXhl'
 when 5 then ' `tick.evil.top` **bold.evil.top** _under.evil.top_ [text](http://link.evil.top/p) <angle.evil.top>'
 when 6 then ' broken' || {NEWLINE} || '.evil.top 45.77' || {NEWLINE} || '.10.3 http://cut.evil.top' || {NEWLINE} || '/tail.zip'
 when 7 then ' http[s]://br.evil.top/ [4]5.9.8.7 (x)y.evil.top 45(.)9(.)8(.)6'
 when 8 then ' word[dot]evil.top bad(dot)cc spaced . evil . top up DOT ru esc%2Eevil.top'
 when 9 then ' ops[at]evil.top boss (at) evil.top eve AT evil.top sl[/]ash'
 when 10 then ' 0x2d4d0a0b 759990795 0055.0115.012.013 45 . 77 . 1 . 2 [45.77.9.9]'
 else ' cve_2023_4455 CVE 2022 12345 xn--bcher-kva.top fxp://f.evil.top/a meow://m.evil.top h**ps://s.evil.top hxxps%3A%2F%2Fe.evil.top'
end"""

PLANTED = f"""' Malware C2 at hxxp://c2-' || {v('doc_id % 40')} || '[.]evil' || {v('doc_id % 7')} || '[.]ru/payload.exe and 45.'
 || {v('10 + doc_id % 50')} || '.' || {v('doc_id % 200')} || '.7 exploit CVE-2024-' || {v('1000 + doc_id % 60')}
 || ' hash ' || md5({v('doc_id % 30')}) || ' drop' || {v('doc_id % 25')} || '[.]phish[.]top mail ops' || {v('doc_id % 20')}
 || '[at]bad.xyz AS' || {v('13000 + doc_id % 90')} || ' 10.' || {v('doc_id % 9')} || '.0.0/16 Global' || {BACKSLASH} || 'mtx'
 || {v('doc_id % 11')} || ' HKLM-x HKCU:Run' || {v('doc_id % 5')} || '. sha ' || md5('a' || {v('doc_id % 30')}) || md5('b' || {v('doc_id % 30')})
 || ' JA3: ' || md5('j' || {v('doc_id % 6')}) || ' 0x' || md5({v('doc_id')}) || '0badf00d AKIA'
 || upper(substr(md5({v('doc_id % 8')}), 1, 16)) || ' 00:1A:2B:3C:4D:' || {v('10 + doc_id % 80')}
 || ' fe80:0:0:0:0:0:0:' || {v('1 + doc_id % 9')} || ' sha1 ' || substr(md5('s' || {v('doc_id % 30')}) || md5('t' || {v('doc_id % 30')}), 1, 40)
 || ' xmr 4A' || substr(replace(md5('x' || {v('doc_id % 4')}) || md5('y' || {v('doc_id % 4')}) || md5('z' || {v('doc_id % 4')}), '0', 'z'), 1, 93)
 || ' onion ' || substr(translate(md5('o' || {v('doc_id % 6')}) || md5('p' || {v('doc_id % 6')}), '0189', 'wxyz'), 1, 56) || '.onion'
 || ' JA3S: ' || md5('js' || {v('doc_id % 5')}) || ' jarm ' || substr(md5('k' || {v('doc_id % 5')}) || md5('l' || {v('doc_id % 5')}), 1, 62)
 || ' imphash: ' || md5('im' || {v('doc_id % 9')}) || ' rich header: ' || md5('rh' || {v('doc_id % 9')})
 || ' btc 1' || substr(replace(md5('bt' || {v('doc_id % 9')}), '0', 'z'), 1, 30) || ' call 212-' || {v('100 + doc_id % 900')} || '-' || {v('1000 + doc_id % 9000')}
 || ' resolver 8.8.8.8 and 1.1.1.' || {v('doc_id % 3')} || ' www.google.com https://github.com/x/' || {v('doc_id % 5')}
 || '.zip http://www.microsoft.com/a news.crowdstrike.com invoice' || {v('doc_id % 6')} || '.pdf zeros 00000000000000000000000000000000'"""

REPORTS = (
    "select doc_id, source as feed, 'https://feeds.example.net/' || source || '/' || cast(doc_id as string) as url, "
    f"text || {PLANTED} || {MASKED} || ' end.' as text from documents"
)
# Single-character rules only, to check each masking rule on its own text.
MASKED_ONLY = f"select doc_id, text || {MASKED} as text from documents"


def report_time(doc_id: str = "doc_id") -> str:
    """Timestamp text: 2024-01-01 plus the id in minutes, wrapping after 30 days."""
    return f"timestamp '2024-01-01 00:00:00' + ({doc_id} % 43200) * interval '1' minute"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run view SQL over the given tables."""
    for name in tables:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(view(spark, sf_dir, REPORTS, "documents"), "doc_id")


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(view(spark, sf_dir, MASKED_ONLY, "documents"), "doc_id")


AS_OF = "timestamp '2024-01-31 00:00:00'"

# Verdicts by arithmetic on the indicator: about a fifth have none.
VERDICTS = """select value, type, cast(n % 100 as double) / 100 as confidence, n % 3 <> 0 as is_valid, 'note ' || cast(n % 10 as string) as reasoning
 from (select distinct value, type, length(value) * 7 + ascii(substr(value, length(value), 1)) * 3 + ascii(substr(value, 6, 1)) as n
  from (select 'CVE-2024-' || cast(1000 + doc_id % 60 as string) as value, 'cve' as type from documents
   union all select 'http://c2-' || cast(doc_id % 40 as string) || '.evil' || cast(doc_id % 7 as string) || '.ru/payload.exe', 'url' from documents
   union all select '45.' || cast(10 + doc_id % 50 as string) || '.' || cast(doc_id % 200 as string) || '.7', 'ip' from documents)) where n % 5 <> 0"""

# Per-feed reliability.
RELIABILITY = """select source as feed, 0.2 + cast(n % 9 as double) / 10 as reliability from
 (select distinct source, length(source) + ascii(substr(source, length(source), 1)) as n from documents)"""

# Stored indicator rows: one per event.
IOC_STORE = """select event_id,
 case event_type when 'error' then 'ip' when 'click' then 'url' when 'view' then 'domain' when 'purchase' then 'cve' else 'md5' end as type,
 'ind-' || cast(user_id as string) as ioc, case when event_id % 17 = 0 then null else 'feed' || cast(event_id % 25 as string) end as feed,
 case event_id % 6 when 0 then 'Critical' when 1 then 'High' when 2 then 'Medium' when 3 then 'Low' when 4 then 'Unknown' else null end as severity,
 case when event_id % 11 = 0 then null else cast(event_id % 100 as double) / 100 end as confidence,
 case when event_id % 7 = 0 then null else cast(event_id * 7 % 100 as double) / 100 end as fused_confidence,
 cast(ts as timestamp) - interval '3' hour as timestamp, case when event_id % 13 = 0 then null else cast(ts as timestamp) end as ingested_at,
 event_id % 2 = 0 as verified, '' as reasoning, false as deobfuscated from events"""

# Feed checks: the event log read as a fetch log.
FEED_CHECKS = """select 'feed' || cast(user_id % 40 as string) as feed, event_type <> 'error' as success, value as response_time,
 cast(ts as timestamp) as checked_at, event_id as seq from events"""
FEEDS = """select 'feed' || cast(s_suppkey % 60 as string) as name, min('https://feeds.example.net/' || cast(s_suppkey % 60 as string)) as url,
 min(case s_nationkey % 3 when 0 then 'blog' when 1 then 'government' else 'threat_feed' end) as category,
 min(case when s_suppkey % 60 % 4 = 0 then null when s_suppkey % 60 % 4 = 1 then 'high' else 'low' end) as priority
 from supplier group by s_suppkey % 60"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, VERDICTS, "documents")


def over(rows: DataFrame, name: str, sql: str) -> DataFrame:
    """Run view SQL with ``rows`` (a batch or a stream) in place of a given table."""
    rows.createOrReplaceTempView(name)
    return rows.sparkSession.sql(sql)


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, one file or a folder of files, as a stream of files. The pattern in
    the path lets a stream start from a single file as well."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with feed reliability and time, ready for refang."""
    docs = reports(spark, sf_dir)
    # one row per feed: a checked broadcast keeps the texts where they are
    docs = docs.join(broadcast_if_small(view(spark, sf_dir, RELIABILITY, "documents")), "feed", "left")
    return docs.selectExpr("*", f"{report_time()} as seen_at")


def ioc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, IOC_STORE, "events")

# Mentions: two to seven indicators per brief report. Briefs fall in 60 families
# that share indicators; a few also name one hub, which ties families together.
_BRIEF = "select doc_id, source as feed, doc_id % 60 as k, cast(floor(doc_id / 60) as bigint) as r from documents"
_BRIEF_ROWS = f"""select doc_id, feed, k, 1 as place, '45.' || cast(k as string) || '.' || cast(r % 5 as string) || '.7' as ioc, 'ip' as type from ({_BRIEF}) b1
 union all select doc_id, feed, k, 2, 'c' || cast(k as string) || '.evil.top', 'domain' from ({_BRIEF}) b2
 union all select doc_id, feed, k, 3, md5(cast(k as string) || 'm' || cast(r % 2 as string)), 'md5' from ({_BRIEF}) b3 where r % 4 <> 3
 union all select doc_id, feed, k, 3 + p, 'http://x' || cast(k as string) || '.evil.ru/' || cast(p as string), 'url' from ({_BRIEF}) b4, (select explode_p as p from (P4)) ps where doc_id % 50 = 1"""
_P4 = "select 1 as explode_p union all select 2 union all select 3 union all select 4"


def mentions_sql(hub: bool = True) -> str:
    rows = _BRIEF_ROWS.replace("(P4)", f"({_P4}) p4")
    if hub:
        rows += f" union all select doc_id, feed, k, 9, 'hub.evil.top', 'domain' from ({_BRIEF}) b5 where doc_id % 20 = 0"
    return (
        "select 'art-' || cast(doc_id as string) as context_id, place, ioc, type, "
        f"cast((doc_id * 7 + place * 13) % 60 as double) / 100 + 0.3e0 as confidence, feed, {report_time()} as seen_at, k from ({rows}) m"
    )


LATE = "timestamp '2024-01-02 21:00:00'"
MENTIONS = mentions_sql()
MENTIONS_PLAIN = mentions_sql(hub=False)
REVIEWED = "select 'c' || cast(k as string) || '.evil.top' as id, k % 2 = 0 as reviewed from (select distinct doc_id % 60 as k from documents) where k % 3 = 0"


_MENTION_ARRAY = """filter(array(
 named_struct('place', 1, 'ioc', '45.' || string(k) || '.' || string(r % 5) || '.7', 'type', 'ip', 'keep', true),
 named_struct('place', 2, 'ioc', 'c' || string(k) || '.evil.top', 'type', 'domain', 'keep', true),
 named_struct('place', 3, 'ioc', md5(string(k) || 'm' || string(r % 2)), 'type', 'md5', 'keep', r % 4 <> 3),
 named_struct('place', 4, 'ioc', 'http://x' || string(k) || '.evil.ru/1', 'type', 'url', 'keep', doc_id % 50 = 1),
 named_struct('place', 5, 'ioc', 'http://x' || string(k) || '.evil.ru/2', 'type', 'url', 'keep', doc_id % 50 = 1),
 named_struct('place', 6, 'ioc', 'http://x' || string(k) || '.evil.ru/3', 'type', 'url', 'keep', doc_id % 50 = 1),
 named_struct('place', 7, 'ioc', 'http://x' || string(k) || '.evil.ru/4', 'type', 'url', 'keep', doc_id % 50 = 1),
 named_struct('place', 9, 'ioc', 'hub.evil.top', 'type', 'domain', 'keep', HUB and doc_id % 20 = 0)), x -> x.keep)"""


def mention_rows(spark: SparkSession, sf_dir: str, hub: bool = True) -> DataFrame:
    return mention_rows_of(table(spark, sf_dir, "documents"), hub)


def mention_rows_of(documents: DataFrame, hub: bool = True) -> DataFrame:
    """The rows of ``mentions_sql`` from a single scan."""
    rows = over(documents, "documents", _BRIEF).selectExpr(
        "doc_id", "feed", "k", f"explode({_MENTION_ARRAY.replace('HUB', str(hub).lower())}) as x"
    )
    return rows.selectExpr(
        "'art-' || string(doc_id) as context_id", "x.place as place", "x.ioc as ioc", "x.type as type",
        "cast((doc_id * 7 + x.place * 13) % 60 as double) / 100 + 0.3D as confidence", "feed",
        f"{report_time()} as seen_at", "k",
    )


def mentions(spark: SparkSession, sf_dir: str, hub: bool = True) -> DataFrame:
    return mention_rows(spark, sf_dir, hub).drop("k")
