"""Scoring extraction against labelled text.

``expected``: extractor-free truth rows (sample, value, type). ``extracted``: rows
(sample, value, type, confidence). ``samples``: sample, category. All metrics are
aggregates of one table, ``match``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.operators import extract as X


def _norm(name: str) -> Column:
    return F.lower(F.trim(F.col(name)))


def distinct_items(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select("sample", _norm("value").alias("value"), _norm("type").alias("type"), *extra)


def match(expected: DataFrame, extracted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per distinct (sample, value, type) with its outcome tp, fp or fn.

    Written as a union and one aggregation rather than a full outer join: the same
    shuffle also removes duplicates, and duplicates combine before it. ``by``
    names extra key columns, such as the extractor, that ``extracted`` carries and
    ``expected`` has been expanded to.
    """
    keys = [*by, "sample", "value", "type"]
    want = distinct_items(expected, *by).withColumns({"_want": F.lit(1), "_got": F.lit(0), "confidence": F.lit(None).cast("double")})
    got = distinct_items(extracted, *by, "confidence").withColumns({"_want": F.lit(0), "_got": F.lit(1)})
    merged = want.unionByName(got).groupBy(*keys).agg(
        F.max("_want").alias("_want"), F.max("_got").alias("_got"), F.max("confidence").alias("confidence")
    )
    outcome = F.when((F.col("_want") == 1) & (F.col("_got") == 1), "tp").when(F.col("_got") == 1, "fp").otherwise("fn")
    return merged.select(*keys, outcome.alias("outcome"), "confidence")


def _count(outcome: str) -> Column:
    return F.count_if(F.col("outcome") == outcome).alias(outcome)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def with_prf(counts: DataFrame) -> DataFrame:
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumn("precision", p).withColumn("recall", r)
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1)


def counts(matched: DataFrame, *by: str) -> DataFrame:
    return matched.groupBy(*by).agg(_count("tp"), _count("fp"), _count("fn"))


def micro(matched: DataFrame, *by: str) -> DataFrame:
    return with_prf(counts(matched, *by))


def per_type(matched: DataFrame) -> DataFrame:
    return with_prf(counts(matched, "type"))


def macro(matched: DataFrame) -> DataFrame:
    """Unweighted means over types, and F1 weighted by support."""
    support = F.col("tp") + F.col("fn")
    return per_type(matched).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * support), F.sum(support)).alias("weighted_f1"),
    )


def true_negatives(samples: DataFrame, matched: DataFrame) -> DataFrame:
    """Samples with nothing expected and nothing extracted."""
    return samples.join(matched.select("sample").distinct(), "sample", "left_anti").agg(F.count("*").alias("tn"))


def agreement(samples: DataFrame, matched: DataFrame) -> DataFrame:
    """Matthews correlation and Cohen's kappa. TN counts samples while TP, FP and
    FN count items; the mix is part of the definition used here."""
    one = counts(matched).crossJoin(true_negatives(samples, matched))  # two single rows
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    mcc_root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    n = tp + fp + fn + tn
    observed = (tp + tn) / n
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    return one.select(
        "tp", "fp", "fn", "tn",
        F.when(mcc_root > 0, (tp * tn - fp * fn) / mcc_root).otherwise(0.0).alias("mcc"),
        F.when(n == 0, 0.0).when(chance < 1, (observed - chance) / (1 - chance)).otherwise(0.0).alias("kappa"),
    )


def calibration(matched: DataFrame) -> DataFrame:
    """Mean confidence of hits and of false alarms, per type and over all."""
    sets = matched.groupingSets([["type"], []], "type").agg(
        F.avg(F.when(F.col("outcome") == "tp", F.col("confidence"))).alias("tp_confidence"),
        F.avg(F.when(F.col("outcome") == "fp", F.col("confidence"))).alias("fp_confidence"),
        F.grouping("type").alias("_all"),
    )
    return sets.select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col("type")).alias("type"),
        F.coalesce("tp_confidence", F.lit(0.0)).alias("tp_confidence"),
        F.coalesce("fp_confidence", F.lit(0.0)).alias("fp_confidence"),
    )


def category_accuracy(samples: DataFrame, matched: DataFrame) -> DataFrame:
    """Share of samples without any error, per category."""
    wrong = matched.where("outcome <> 'tp'").select("sample").distinct().withColumn("_wrong", F.lit(1))
    return samples.join(wrong, "sample", "left").groupBy("category").agg(
        F.count("*").alias("samples"), F.avg(F.when(F.col("_wrong").isNull(), 1.0).otherwise(0.0)).alias("accuracy")
    )


def compare(expected: DataFrame, extracted: DataFrame, key: str, names: list[str], by_type: bool = False) -> DataFrame:
    """Scores per extractor (or model, or configuration), over all or per type.

    The names are given, so the extracted rows are read once; each truth row is
    repeated per name in place."""
    wanted = expected.withColumn(key, F.explode(F.array(*[F.lit(n) for n in names])))
    matched = match(wanted, extracted, by=(key,))
    return micro(matched, key, "type") if by_type else micro(matched, key)


def with_delta(scores: DataFrame, key: str, first: str) -> DataFrame:
    """F1 difference to the configuration named ``first``; one row per configuration,
    so the window holds a handful of rows and the scores are planned once."""
    base = F.max(F.when(F.col(key) == first, F.col("f1"))).over(Window.partitionBy())
    return scores.withColumn("delta_f1", F.col("f1") - base)


def filter_samples(samples: DataFrame, truth: DataFrame, category: str | None = None, kind: str | None = None, tag: str | None = None) -> DataFrame:
    """Labelled samples of a category, with at least one expected indicator of a type, carrying a tag."""
    kept = samples
    for name, wanted in (("category", category), ("tag", tag)):
        if wanted is not None:
            kept = kept.where(F.col(name) == wanted)
    return kept if kind is None else kept.join(truth.where(F.col("type") == kind).select("sample").distinct(), "sample", "left_semi")


# --- configurations ---------------------------------------------------------
# The four standard configurations and the tests each one applies
# to a domain found in clean text.
CONFIGURATIONS = {
    "A. Regex Only": None,
    "B. Regex + Deobfuscation": [],
    "C. Regex + Deobfusc. + Domain Filter": ["listed", "file_name"],
    "D. Full Pipeline": ["listed", "file_name", "in_url"],
}


def configuration_items(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(config, sample, value, type) for each configuration; ``docs``: sample, text,
    clean. Patterns run once on the text and once on the clean text; the flags of a
    match decide which configurations keep it. ``texts`` (sample, text) are the same
    texts before the rules, which need not run for them."""
    raw = X.pattern_items(docs if texts is None else texts, "text", ["sample"]).select("sample", "value", "type", F.array(F.lit("A. Regex Only")).alias("configs"))
    clean = X.pattern_items(docs, "clean", ["sample"])
    keeps = []
    for name, flags in CONFIGURATIONS.items():
        if flags is not None:
            dropped = F.lit(False)
            for flag in flags:
                dropped = dropped | F.col(flag)
            keeps.append(F.when(~dropped, F.lit(name)))
    kept = clean.select("sample", "value", "type", F.array_compact(F.array(*keeps)).alias("configs"))
    return raw.union(kept).select(F.explode("configs").alias("config"), "sample", "value", "type", F.lit(None).cast("double").alias("confidence"))


# --- bootstrap --------------------------------------------------------------
def uniform_hash(sample: Column, replicate: Column, seed: int) -> Column:
    """Uniform number in [0, 1) per (sample, replicate), the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), replicate, sample), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)


def bootstrap(
    samples: DataFrame, matched: DataFrame, replicates: int = 1000, level: float = 0.95, seed: int = 42, uniform=uniform_hash
) -> DataFrame:
    """Percentile intervals for precision, recall and F1.

    Drawing n of n samples with replacement is done as one Poisson(1) count per
    (replicate, sample), the form that needs no positions and no shuffle of the
    samples: counts come from a hash, and the weighted sums combine on the map
    side to one short row per replicate.
    """
    scores = counts(matched, "sample")
    per_sample = samples.select("sample").join(scores, "sample", "left").fillna(0, ["tp", "fp", "fn"])
    # explode first, draw after: the draw then runs in generated code, and the
    # uniform number is its own projection, computed once per row
    drawn = per_sample.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    drawn = drawn.withColumn("_u", uniform(F.col("sample"), F.col("replicate"), seed))
    weighted = drawn.select("tp", "fp", "fn", "replicate", poisson_count(F.col("_u")).alias("times"))
    sums = weighted.groupBy("replicate").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in ("tp", "fp", "fn")])
    return percentile_interval(with_prf(sums), micro(matched), replicates, level)


def poisson_count(u: Column) -> Column:
    """Poisson(1) count of a uniform number, by its cumulative probabilities."""
    total, term, out = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(12):
        total += term
        out = out + (u >= total).cast("int")
        term /= k + 1
    return out


def percentile_interval(scored: DataFrame, point: DataFrame, replicates: int, level: float) -> DataFrame:
    """Long form: metric, point, lower, upper. The replicate table has one short
    row per replicate."""
    alpha = (1 - level) / 2
    low, high = int(alpha * replicates), int((1 - alpha) * replicates)
    names = ("precision", "recall", "f1")
    stacked = scored.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("x")).select("x.*")
    rank = Window.partitionBy("metric").orderBy("v")
    ranked = stacked.withColumn("_i", F.row_number().over(rank) - 1)
    bounds = ranked.groupBy("metric").agg(
        F.max(F.when(F.col("_i") == low, F.col("v"))).alias("lower"), F.max(F.when(F.col("_i") == high, F.col("v"))).alias("upper")
    )
    points = point.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("point")) for n in names])).alias("x")).select("x.*")
    return points.join(bounds, "metric")


# --- errors -----------------------------------------------------------------
def false_positive_class(value: Column, kind: Column, text: Column, lowered: Column, category: Column) -> Column:
    """``lowered``: the text in lower case, whose literal search settles nearly all values before a pattern is made."""
    benign = category == "true_negative"
    quoted = F.regexp_replace(value, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    at_value = F.contains(lowered, F.concat(F.lit("@"), F.lower(value)))
    in_email = at_value & F.regexp_like(text, F.concat(F.lit(r"(?i)[A-Za-z0-9._%+-]@"), quoted))
    octets = F.filter(F.split(value, r"\."), lambda p: p.rlike("^[0-9]+$"))
    low_octets = F.forall(octets, lambda p: p.cast("int") < 20)
    return (
        F.when((kind == "domain") & in_email, "email_domain_leak")
        .when((kind == "domain") & benign, "benign_context_domain")
        .when(kind == "domain", "over_matching_domain")
        .when((kind == "ip") & benign, "benign_context_ip")
        .when((kind == "ip") & low_octets, "version_string_ip")
        .when(kind == "ip", "over_matching_ip")
        .when(kind.isin("md5", "sha1", "sha256") & value.rlike("^0*$"), "null_hash")
        .when(kind.isin("md5", "sha1", "sha256"), "over_matching_hash")
        .when((kind == "email") & benign, "benign_context_email")
        .when(kind == "email", "over_matching_email")
        .when((kind == "url") & benign, "benign_context_url")
        .when(kind == "url", "over_matching_url")
        .otherwise("unknown")
    )


def false_negative_class(value: Column, kind: Column, lowered: Column) -> Column:
    """``lowered``: the clean text in lower case."""
    return (
        F.when(~lowered.contains(F.lower(value)), "deobfuscation_failure")
        .when(kind == "domain", "domain_filtered")
        .when(kind == "ip", "ip_filtered")
        .when((kind == "url") & value.startswith("ftp://"), "unsupported_scheme")
        .when(kind == "url", "url_regex_miss")
        .when(kind.isin("md5", "sha1", "sha256"), "hash_regex_miss")
        .otherwise("unknown")
    )


def error_classes(matched: DataFrame, docs: DataFrame) -> DataFrame:
    """Wrong rows with their class; ``docs``: sample, text, clean, category.

    The error lists go to the documents, not the other way round: errors are
    gathered per sample (bounded by what one document can yield) and joined once,
    so a text is shuffled once however many errors it has."""
    wrong = matched.where("outcome <> 'tp'").groupBy("sample").agg(F.collect_list(F.struct("value", "type", "outcome")).alias("errors"))

    def classify(e: Column) -> Column:
        return F.when(
            e["outcome"] == "fp", false_positive_class(e["value"], e["type"], F.col("text"), F.col("_text"), F.col("category"))
        ).otherwise(false_negative_class(e["value"], e["type"], F.col("_clean")))

    classes = F.transform("errors", lambda e: F.struct(e["value"].alias("value"), e["type"].alias("type"), e["outcome"].alias("outcome"), classify(e).alias("class")))
    told = docs.join(wrong, "sample")
    with_mail = F.when(F.contains("text", F.lit("@")), F.lower("text")).otherwise(F.lit(""))
    told = told.withColumns({"_text": with_mail, "_clean": F.lower("clean")})  # once a text, not once an error
    return told.select("sample", F.explode(classes).alias("e")).select("sample", "e.*")


def error_shares(errors: DataFrame) -> DataFrame:
    totals = errors.groupBy("outcome", "class").agg(F.count("*").alias("n"))
    return totals.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("outcome")) * 100, 1))


# --- timings ----------------------------------------------------------------
def timing_stats(timings: DataFrame) -> DataFrame:
    """Per stage: n, total, extremes, mean, median, order-index p95/p99, sample
    deviation. Equal timings are counted first, then cumulative counts find the
    order statistics, so a stage with a third of all rows is never sorted row by
    row in one task: one task sees its distinct values only."""
    values = timings.groupBy("stage", "ms").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy("stage").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumns({"_to": F.sum("_c").over(upto), "_n": F.sum("_c").over(Window.partitionBy("stage"))})

    def at(index: Column) -> Column:
        """Value at a 0-based position of the sorted list."""
        return F.min(F.when(F.col("_to") > index, F.col("ms")))

    order = ranked.groupBy("stage").agg(
        at(F.floor(F.col("_n") * 0.95)).alias("p95"), at(F.floor(F.col("_n") * 0.99)).alias("p99"),
        ((at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2).alias("median"),
    )
    simple = timings.groupBy("stage").agg(
        F.count("*").alias("n"), F.sum("ms").alias("total"), F.min("ms").alias("min"), F.max("ms").alias("max"),
        F.avg("ms").alias("mean"), F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias("stdev"),
    )
    return simple.join(order, "stage")


def throughput(timings: DataFrame) -> DataFrame:
    seconds = F.sum("ms") / 1000
    return timings.agg(F.count("*").alias("samples"), _ratio(F.count("*"), seconds).alias("per_second"))


# --- labelled set -----------------------------------------------------------
def dataset_summary(samples: DataFrame, expected: DataFrame) -> DataFrame:
    """Long form: totals, per category, per type."""
    def rows(df: DataFrame, facet: str, name: Column) -> DataFrame:
        return df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(facet).alias("facet"), "name", "n")

    return (
        rows(samples, "category", F.col("category")).union(rows(expected, "type", F.col("type")))
        .union(rows(samples, "total", F.lit("samples"))).union(rows(expected, "total", F.lit("expected")))
    )


def report(samples: DataFrame, matched: DataFrame, report_id: str, as_of: Column) -> DataFrame:
    """One report row with the headline figures."""
    return (
        micro(matched).crossJoin(macro(matched)).crossJoin(agreement(samples, matched).select("tn", "mcc", "kappa"))
        .crossJoin(samples.agg(F.count("*").alias("total_samples")))
        .withColumn("report_id", F.lit(report_id)).withColumn("created_at", as_of)
    )


def history(reports: DataFrame, limit: int = 20) -> DataFrame:
    return reports.orderBy(F.desc("created_at")).limit(limit).select("report_id", "created_at", "precision", "recall", "f1")
