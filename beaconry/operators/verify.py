"""Verdicts, fusion, severity and the normalized indicator rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry import constants as C
from beaconry.functions.columns import clamp01, lookup
from beaconry.functions.lineage import cut
from beaconry.operators import extract as X


# --- fusion -----------------------------------------------------------------
def check_weights(weight_pattern: float, weight_verdict: float) -> None:
    total = weight_pattern + weight_verdict
    if abs(total - 1.0) > 0.001:
        raise ValueError(f"fusion weights must sum to 1.0, got {total:.3f}")


def fuse(
    pattern: Column,
    verdict: Column,
    reliability: Column | float = 1.0,
    weight_pattern: float = 0.4,
    weight_verdict: float = 0.6,
    scale_always: bool = False,
) -> Column:
    """Weighted mean of both confidences, scaled by source reliability.

    Without a verdict the clamped pattern confidence is returned as it is;
    ``scale_always`` applies the reliability there too.
    """
    check_weights(weight_pattern, weight_verdict)
    reliability = reliability if isinstance(reliability, Column) else F.lit(float(reliability))
    alone = clamp01(pattern * reliability if scale_always else pattern)
    both = (F.lit(weight_pattern) * pattern + F.lit(weight_verdict) * verdict) * reliability
    return F.when(verdict.isNull(), alone).otherwise(F.round(clamp01(both), 4))


def fuse_with_penalty(pattern: Column, verdict: Column, is_valid: Column, reliability=1.0, **options) -> Column:
    """As ``fuse``, with the verdict inverted when it judged the indicator invalid."""
    inverted = F.when(is_valid == F.lit(False), 1.0 - verdict).otherwise(verdict)
    return fuse(pattern, inverted, reliability, **options)


# --- severity ---------------------------------------------------------------
def severity(kind: Column, confidence: Column, table: str = "ingest") -> Column:
    """Severity of a type, one step up from .85 and one step down below .4."""
    base = lookup(F.lower(kind), C.INGEST_SEVERITY if table == "ingest" else C.DEFAULT_SEVERITY, "Unknown")
    up = lookup(base, {"High": "Critical", "Medium": "High"}, None)
    down = lookup(base, {"Critical": "High", "High": "Medium", "Medium": "Low"}, None)
    moved = F.when(confidence >= 0.85, up).when(confidence < 0.4, down)
    return F.coalesce(moved, base)


def severity_priority(name: Column) -> Column:
    return lookup(name, C.SEVERITY_PRIORITY, 0)


def parse_severity(text: Column) -> Column:
    """First of Low, Medium, High, Critical, Unknown contained in the text."""
    lower = F.lower(text)
    out = None
    for name in ("Low", "Medium", "High", "Critical"):
        test = lower.contains(name.lower())
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("Unknown"))


# --- gates ------------------------------------------------------------------
def verification_gate(observations: DataFrame, per_doc: int = 5) -> DataFrame:
    """Observations worth a verdict: cve/url/ip above .6, best few per document.

    ``place`` already is the order by confidence inside a document, so the rank
    within the document is the only thing computed here.
    """
    worthy = observations.where(F.col("type").isin(C.VERIFIABLE_TYPES) & (F.col("confidence") > 0.6))
    best = Window.partitionBy("doc_id").orderBy("place")
    return worthy.withColumn("gate_rank", F.row_number().over(best)).where(F.col("gate_rank") <= per_doc)


def gated_matches(matches: str, per_doc: int = 5) -> str:
    """SQL text: the gate applied inside the document's ordered match array."""
    ranks = ", ".join(str(C.TYPE_RANK[t]) for t in C.VERIFIABLE_TYPES)
    worthy = f"filter({matches}, m -> m.rank in ({ranks}) and m.confidence > 0.6D)"
    return f"transform(slice({worthy}, 1, {per_doc}), m -> m.value)"


def batch_gate(observations: DataFrame, verdicts: DataFrame, top: int = 50) -> DataFrame:
    """Verdicts for the ``top`` most confident of a batch; the rest stay unverified.

    The matches are stored once, without texts, since the cut at ``top`` and the rows
    both need them and the text rules behind them should run a single time.
    """
    observations = cut(observations.select("doc_id", "place", "value", "type", "confidence"))
    order = [F.desc("confidence"), F.asc("doc_id"), F.asc("place")]
    chosen = observations.orderBy(*order).limit(top).select("doc_id", "value", F.lit(True).alias("chosen"))
    joined = observations.join(F.broadcast(chosen), ["doc_id", "value"], "left").join(
        verdicts.withColumnRenamed("confidence", "verdict"), ["value", "type"], "left"
    )
    seen = F.coalesce(F.col("chosen"), F.lit(False))
    return joined.select(
        "doc_id", "value", "type", "confidence",
        F.when(seen, F.col("verdict")).alias("verdict_confidence"),
        (seen & F.col("verdict").isNotNull()).alias("verified"),
        F.coalesce(F.when(seen, F.col("is_valid")), F.lit(True)).alias("is_valid"),
        F.when(seen, F.coalesce("reasoning", F.lit(""))).otherwise(F.lit("Not verified (batch limit exceeded)")).alias("reasoning"),
    )


# --- replies ----------------------------------------------------------------
def first_object(text: Column) -> Column:
    """First balanced ``{...}`` of a text, found by a running bracket depth."""
    return F.expr(
        f"""element_at(transform(array({_sql_name(text)}), t -> if(instr(t, '{{') = 0, null,
        element_at(transform(array(substring(t, instr(t, '{{'))), s ->
          element_at(transform(array(aggregate(
            regexp_extract_all(s, '[{{}}]|[^{{}}]+', 0),
            named_struct('depth', 0, 'len', 0, 'end', 0),
            (a, p) -> named_struct(
              'depth', a.depth + case p when '{{' then 1 when '}}' then -1 else 0 end,
              'len', a.len + length(p),
              'end', if(a.end = 0 and p = '}}' and a.depth = 1, a.len + length(p), a.end)))), r ->
            if(r.end = 0, null, substring(s, 1, r.end))), 1)), 1))), 1)"""
    )


def _sql_name(column: Column | str) -> str:
    if isinstance(column, str):
        return column
    raise TypeError("pass a column name")


def parse_verdicts(replies: DataFrame, reply: str = "raw_reply") -> DataFrame:
    """Verdict columns from raw reply text: think blocks and code fences are
    stripped, the first balanced object is read, missing fields get defaults, and
    an unreadable reply counts as valid with confidence .5."""
    cleaned = F.trim(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""))
    cleaned = F.trim(F.regexp_replace(cleaned, r"(?s)```(?:json)?\s*(.*?)\s*```", "$1"))
    staged = replies.withColumn("_cleaned", cleaned).withColumn("_object", first_object("_cleaned"))
    parsed = F.from_json("_object", "is_valid_ioc boolean, confidence double, reasoning string, _corrupt_record string")
    staged = staged.withColumn("_parsed", parsed)
    ok = F.col("_object").isNotNull() & F.col("_parsed._corrupt_record").isNull()
    return staged.withColumns(
        {
            "is_valid": F.when(ok, F.coalesce("_parsed.is_valid_ioc", F.lit(True))).otherwise(F.lit(True)),
            "confidence": F.when(ok, clamp01(F.coalesce("_parsed.confidence", F.lit(0.5)))).otherwise(F.lit(0.5)),
            "reasoning": F.when(ok, F.coalesce("_parsed.reasoning", F.lit("No reasoning provided"))).otherwise(
                F.lit("verification failed")
            ),
            "verified": ok,
        }
    ).drop("_cleaned", "_object", "_parsed")


def shorten_reasoning(text: Column, limit: int = 300) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def scrub_prompt_text(text: Column, max_length: int | None = None) -> Column:
    """Make report text safe to quote: cut where a length is given, drop braces, mask instruction phrases,
    code fences and tags, collapse blanks."""
    whole = F.coalesce(text, F.lit(""))
    out = F.translate(whole if max_length is None else F.left(whole, F.lit(max_length)), "{}", "")
    for pattern in (
        r"(?iU)\b(SYSTEM|IGNORE\s+PREVIOUS|FORGET\s+EVERYTHING|DISREGARD)\b",
        r"(?iU)\b(NEW\s+INSTRUCTIONS?|OVERRIDE|ACT\s+AS|YOU\s+ARE\s+NOW)\b",
        r"```",
        r"<[^>]+>",
    ):
        out = F.regexp_replace(out, pattern, "[FILTERED]")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


# --- rows -------------------------------------------------------------------
def normalize(
    docs: DataFrame,
    verdicts: DataFrame | None = None,
    text: str = "clean",
    min_confidence: float = 0.3,
    per_doc: int = 5,
    severity_table: str = "ingest",
) -> DataFrame:
    """Normalized indicator rows from clean documents.

    ``docs`` needs doc_id, feed, url, seen_at, reliability, was_modified and the
    clean text. The gate is decided inside each document's match array, so the
    only shuffle is the one that joins the verdicts, and none without verdicts.
    """
    keep = ["doc_id", "feed", "url", "seen_at", "reliability", "was_modified"]
    found = X.extract(docs, text=text, min_confidence=min_confidence).select(*keep, "matches")
    found = found.withColumn("_gated", F.expr(gated_matches("matches", per_doc)))
    rows = X.observations(found, [*keep, "_gated"])
    rows = rows.withColumn("_gate", F.array_contains("_gated", F.col("value")))
    if verdicts is not None:
        known = verdicts.select(
            "value", "type", F.col("confidence").alias("v_conf"), F.col("is_valid").alias("v_valid"),
            F.col("reasoning").alias("v_reason"),
        )
        # rows outside the gate get a key no verdict has, different for each row,
        # so they spread over all join partitions instead of meeting under NULL
        spare = F.concat_ws("\n", F.lit(""), F.col("doc_id"), F.col("value"))
        rows = rows.withColumn("_key", F.when(F.col("_gate"), F.col("value")).otherwise(spare)).join(
            known.withColumnRenamed("value", "_key"), ["_key", "type"], "left"
        )
    else:
        rows = rows.withColumns(
            {"v_conf": F.lit(None).cast("double"), "v_valid": F.lit(None).cast("boolean"), "v_reason": F.lit(None).cast("string")}
        )
    fused = fuse_with_penalty(F.col("confidence"), F.col("v_conf"), F.col("v_valid"), F.col("reliability"))
    rows = rows.withColumn("fused", fused)
    return rows.select(
        "doc_id",
        "feed",
        F.col("value").alias("ioc"),
        "type",
        severity(F.col("type"), F.col("fused"), severity_table).alias("severity"),
        F.round("confidence", 4).alias("confidence"),
        F.round("fused", 4).alias("fused_confidence"),
        F.round("v_conf", 4).alias("verdict_confidence"),
        F.col("v_conf").isNotNull().alias("verified"),
        F.coalesce("v_reason", F.lit("")).alias("reasoning"),
        F.col("was_modified").alias("deobfuscated"),
        F.col("seen_at").alias("timestamp"),
        F.col("url").alias("source_url"),
        "place",
    )


def verify_single(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per submitted text: best match, verdict, fused confidence.

    ``docs`` needs doc_id, input, was_modified and ``matches``; ``verdicts`` is
    keyed by doc_id. Without a match the pattern confidence is .5."""
    best = F.when(F.size("matches") > 0, F.get("matches", F.lit(0)))
    rows = docs.select(
        "doc_id", "was_modified",
        F.when(F.size("matches") > 0, X.type_name(best["rank"])).otherwise(F.lit("unknown")).alias("type"),
        F.coalesce(best["confidence"], F.lit(0.5)).alias("confidence"),
    ).join(verdicts.select("doc_id", F.col("confidence").alias("v_conf"), "is_valid"), "doc_id", "left")
    verdict = F.coalesce("v_conf", F.lit(0.5))
    return rows.select(
        "doc_id", "type", "was_modified", F.round("confidence", 4).alias("confidence"),
        F.round(verdict, 4).alias("verdict_confidence"),
        F.round(fuse_with_penalty(F.col("confidence"), verdict, F.coalesce("is_valid", F.lit(True))), 4).alias("fused_confidence"),
    )


def manual_type(docs: DataFrame, value: str = "input", matches: str = "matches") -> DataFrame:
    """Type of a hand-entered indicator: registry key, file path, what extraction
    finds, then loose address and hash shapes, else unknown. One row per result."""
    v = F.trim(F.col(value))
    detected = (
        F.when(v.rlike(r"(?i)^(HKEY_|HK[A-Z]{2,}\\|HKCU\\|HKLM\\)"), F.struct(F.lit("registry_key").alias("type"), F.lit(0.95).alias("confidence")))
        .when(v.rlike(r"^[A-Za-z]:\\|\\\\[a-zA-Z0-9]"), F.struct(F.lit("file_path").alias("type"), F.lit(0.95).alias("confidence")))
        .when(v.rlike(r"^/[a-zA-Z0-9_\-.]+(/[a-zA-Z0-9_\-.]+)+"), F.struct(F.lit("file_path").alias("type"), F.lit(0.90).alias("confidence")))
    )
    loose = (
        F.when(v.rlike(r"(?U)^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), F.struct(F.lit("ip").alias("type"), F.lit(0.8).alias("confidence")))
        .when(v.rlike(r"^[a-fA-F0-9]{32,64}$"), F.struct(F.lit("hash").alias("type"), F.lit(0.9).alias("confidence")))
        .otherwise(F.struct(F.lit("unknown").alias("type"), F.lit(0.5).alias("confidence")))
    )

    def row(ioc, kind, confidence):
        return F.struct(ioc.alias("ioc"), kind.alias("type"), confidence.alias("confidence"))

    results = (
        F.when(detected.isNotNull(), F.array(row(v, detected["type"], detected["confidence"])))
        .when(
            F.size(matches) > 0,
            F.transform(matches, lambda m: row(m["value"], X.type_name(m["rank"]), m["confidence"])),
        )
        .otherwise(F.array(row(v, loose["type"], loose["confidence"])))
    )
    return docs.select("doc_id", F.explode(results).alias("r")).select("doc_id", "r.*")
