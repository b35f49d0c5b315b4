"""Threat summaries: tactic tags, recommendations, severity fixes, report facts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that tag a tactic, in report order.
TACTIC_WORDS = {
    "Initial Access": ["phishing", "exploit", "drive-by", "spearphishing", "supply chain"],
    "Execution": ["script", "powershell", "cmd", "macro", "malware execution"],
    "Persistence": ["registry", "scheduled task", "startup", "backdoor", "implant"],
    "Privilege Escalation": ["elevation", "privilege", "root", "admin", "sudo"],
    "Defense Evasion": ["obfuscation", "encryption", "packed", "disguised", "evasion"],
    "Credential Access": ["password", "credential", "keylog", "brute force", "hash"],
    "Discovery": ["reconnaissance", "scanning", "enumeration", "discovery"],
    "Lateral Movement": ["lateral", "spread", "propagat", "remote", "psexec"],
    "Collection": ["exfiltrat", "data theft", "screenshot", "clipboard", "keylog"],
    "Command and Control": ["c2", "c&c", "beacon", "callback", "botnet", "rat"],
    "Exfiltration": ["exfiltrat", "data transfer", "upload", "steal"],
    "Impact": ["ransomware", "encrypt", "wipe", "destroy", "denial of service", "ddos"],
}


def tactic_tags(text: Column, limit: int = 5) -> Column:
    lower = F.lower(text)
    hits = []
    for tactic, words in TACTIC_WORDS.items():
        found = F.lit(False)
        for word in words:
            found = found | lower.contains(word)
        hits.append(F.when(found, F.lit(tactic)))
    return F.slice(F.array_compact(F.array(*hits)), 1, limit)


_TTPS = "ttps array<struct<technique_id:string,technique_name:string,tactic:string,confidence:double,evidence:string>>, _corrupt_record string"


def technique_rows(rows: DataFrame, key: str, summary: str, reply: str) -> DataFrame:
    """Technique rows of a reply: of its first five, those at .5 or more; without a
    reply, tactic tags of the summary at .5. An unreadable reply yields none."""
    raw = F.col(reply)
    fenced = F.regexp_extract(raw, r"(?s)```json\s*(.*?)\s*```", 1)
    bare = F.regexp_extract(raw, r'(?s)\{.*"ttps".*\}', 0)
    parsed = F.from_json(F.when(fenced != "", fenced).otherwise(bare), _TTPS)
    good = F.filter(F.slice(parsed["ttps"], 1, 5), lambda t: F.coalesce(t["confidence"], F.lit(0.0)) >= 0.5)
    from_reply = F.transform(
        good,
        lambda t: F.struct(
            F.coalesce(t["technique_id"], F.lit("")).alias("technique_id"), F.coalesce(t["tactic"], F.lit("")).alias("tactic"),
            t["confidence"].alias("confidence"),
        ),
    )
    from_tags = F.transform(
        tactic_tags(F.col(summary)), lambda t: F.struct(F.lit("").alias("technique_id"), t.alias("tactic"), F.lit(0.5).alias("confidence"))
    )
    return rows.select(key, F.explode(F.when(raw.isNull(), from_tags).otherwise(from_reply)).alias("t")).select(key, "t.*")


def recommendations(text: Column, limit: int = 5) -> Column:
    """List items after the first line that mentions a recommendation, an action or
    a response: numbered or bulleted lines of more than ten characters."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))

    def trigger(x: Column) -> Column:
        return F.lower(x).rlike("recommend|action|response")

    flags = F.transform(lines, trigger)
    first = F.array_position(flags, F.lit(True)).cast("int")
    after = F.slice(lines, first + 1, F.greatest(F.size(lines) - first, F.lit(0)))
    items = F.filter(after, lambda x: ~trigger(x) & x.rlike(r"^(?:(?U:\d)|-|•)"))
    clean = F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"^[0-9.\-•) ]+", "")))
    return F.when(first > 0, F.slice(F.filter(clean, lambda x: F.length(x) > 10), 1, limit)).otherwise(F.array().cast("array<string>"))


def correct_severity(rows: DataFrame, severity: str = "severity", reply: str = "validation") -> DataFrame:
    """Severity after validation: ``INVALID: x`` replaces it and keeps the original."""
    bad = F.col(reply).startswith("INVALID")
    fixed = F.trim(F.element_at(F.split(reply, ":"), -1))
    return rows.withColumns(
        {
            "original_severity": F.when(bad, F.col(severity)),
            "corrected": bad,
            severity: F.when(bad, fixed).otherwise(F.col(severity)),
        }
    )


def pending(lines: DataFrame, processed: DataFrame, order: str = "line_no") -> DataFrame:
    """Non-blank input lines not processed yet, each at its first occurrence."""
    todo = lines.select(F.trim("line").alias("line"), order).where("line <> ''")
    return todo.groupBy("line").agg(F.min(order).alias(order)).join(processed.select(F.trim("line").alias("line")), "line", "left_anti")


def by_severity(rows: DataFrame, severity: str, limit: int = 50) -> DataFrame:
    return rows.where(F.lower("severity") == severity.lower()).orderBy(F.desc("timestamp"), "id").limit(limit)


def stats(rows: DataFrame, iocs: DataFrame) -> DataFrame:
    """Summary counts by severity word, the larger High count of both tables, and
    the raw indicator count. Both sides are single rows."""
    def having(name: str) -> Column:
        return F.count_if(F.lower("severity").contains(name.lower()))

    left = rows.agg(F.count("*").alias("total"), *[having(n).alias(n.lower()) for n in ("Critical", "High", "Medium", "Low")])
    right = iocs.agg(having("High").alias("raw_high"), F.count("*").alias("raw_ioc_count"))
    return left.crossJoin(right).withColumn("high", F.greatest("high", "raw_high")).drop("raw_high")


def report_facts(rows: DataFrame, shown: int = 10) -> DataFrame:
    """Long form: counts per severity, and the first critical and high items."""
    tallies = rows.groupBy(F.coalesce("severity", F.lit("Unknown")).alias("name")).agg(F.count("*").alias("n"))
    head = rows.where(F.col("severity").isin("Critical", "High")).orderBy("id").limit(shown)
    return tallies.select(F.lit("severity").alias("fact"), "name", "n").union(
        head.select(F.lit("item").alias("fact"), F.col("severity").alias("name"), F.col("id").alias("n"))
    )


def capped_details(rows: DataFrame, ttps: str = "ttps", recs: str = "recommendations") -> DataFrame:
    """At most five techniques and three recommendations per printed item."""
    return rows.withColumn(ttps, F.slice(ttps, 1, 5)).withColumn(recs, F.slice(recs, 1, 3))


def export_severity(parts: list[DataFrame], severity: str) -> DataFrame:
    """Rows of one severity over tables with different columns: the union of all
    columns, missing ones NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.where(F.col("severity") == severity)

