"""Registered queries: evaluation."""
from __future__ import annotations

from pyspark.sql import functions as F

from beaconry import constants as C
from beaconry.functions.lineage import cut
from beaconry.operators import evaluate as E
from beaconry.operators import extract as X
from beaconry.operators import refang as R
from beaconry.operators import resample as B
from beaconry.operators import scans as SC
from beaconry.plans import oracle_text as O
from beaconry.plans import views as V

# Truth and extracted items from the order lines; samples are the orders.
EXPECTED = "select l_orderkey as sample, 'V' || cast(l_partkey % 40 as string) as value, 't' || cast(l_linenumber as string) as type from lineitem where l_suppkey % 5 <> 0"
EXTRACTED = (
    "select l_orderkey as sample, ' v' || cast(l_partkey % 40 as string) || ' ' as value, 'T' || cast(l_linenumber as string) as type, "
    "cast(10 + l_partkey % 90 as double) / 100 as confidence from lineitem where l_partkey % 7 <> 0 and l_quantity > 3"
)
MODELS = f"""select e.*, m.model from ({EXTRACTED}) e join (select 'small' as model, 2 as n union all select 'medium', 5 union all select 'large', 11) m on cast(round(e.confidence * 100) as bigint) % m.n <> 0"""
SAMPLES = "select o_orderkey as sample, case o_orderpriority when '1-URGENT' then 'true_positive' when '2-HIGH' then 'true_negative' when '3-MEDIUM' then 'obfuscated' else 'edge_case' end as category from orders"
TIMINGS = "select event_type as stage, value as ms from events"

_MATCH = f"""want as (select distinct sample, lower(trim(value)) as value, lower(trim(type)) as type from ({EXPECTED})),
 got as (select sample, lower(trim(value)) as value, lower(trim(type)) as type, max(confidence) as confidence from ({EXTRACTED}) group by 1, 2, 3),
 samples as ({SAMPLES}),
 matched as (select coalesce(w.sample, g.sample) as sample, coalesce(w.value, g.value) as value, coalesce(w.type, g.type) as type,
  case when w.sample is not null and g.sample is not null then 'tp' when g.sample is not null then 'fp' else 'fn' end as outcome, g.confidence
  from want w full join got g on w.sample = g.sample and w.value = g.value and w.type = g.type)"""
_COUNTS = "count(*) filter (where outcome = 'tp') as tp, count(*) filter (where outcome = 'fp') as fp, count(*) filter (where outcome = 'fn') as fn"


def prf(source: str, by: str = "") -> str:
    """PRF columns over a query with tp, fp, fn."""
    keys = f"{by}, " if by else ""
    return (
        f"select {keys}tp, fp, fn, precision, recall, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from "
        f"(select {keys}tp, fp, fn, case when tp + fp > 0 then tp::DOUBLE / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp::DOUBLE / (tp + fn) else 0 end as recall from ({source}))"
    )


_MICRO = prf(f"select {_COUNTS} from matched")
_TYPE = prf(f"select type, {_COUNTS} from matched group by type", "type")
_TN = "(select count(*) from samples where sample not in (select sample from matched))"
_MACRO = f"select avg(precision) as macro_precision, avg(recall) as macro_recall, avg(f1) as macro_f1, sum(f1 * (tp + fn)) / sum(tp + fn) as weighted_f1 from ({_TYPE})"
_AGREE = f"""select tp, fp, fn, tn, (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) as mcc,
 ((tp + tn) / n - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)) as kappa
 from (select tp::DOUBLE as tp, fp::DOUBLE as fp, fn::DOUBLE as fn, tn::DOUBLE as tn, (tp + fp + fn + tn)::DOUBLE as n from (select {_COUNTS}, {_TN} as tn from matched))"""


def rounded(df, *skip):
    """Doubles to nine places, so that summation order cannot show."""
    return df.select(*[F.round(n, 9).alias(n) if t == "double" and n not in skip else F.col(n) for n, t in df.dtypes])


def sql_rounded(sql: str, plain: str, *doubles: str) -> str:
    return f"select {plain}{', ' if plain else ''}{', '.join(f'round({d}, 9) as {d}' for d in doubles)} from ({sql})"


def matched(spark, sf_dir):
    return E.match(V.view(spark, sf_dir, EXPECTED, "lineitem"), V.view(spark, sf_dir, EXTRACTED, "lineitem"))


def samples(spark, sf_dir):
    return V.view(spark, sf_dir, SAMPLES, "orders")


def on_match(fn):
    return lambda spark, sf_dir: rounded(fn(matched(spark, sf_dir)))


def on_both(fn):
    return lambda spark, sf_dir: rounded(fn(samples(spark, sf_dir), matched(spark, sf_dir)))


PRF_D = ("precision", "recall", "f1")


def compare(by_type):
    def run(spark, sf_dir):
        models = V.view(spark, sf_dir, MODELS, "lineitem")
        return rounded(E.compare(V.view(spark, sf_dir, EXPECTED, "lineitem"), models, "model", ["small", "medium", "large"], by_type))

    return run


def _compare_sql(by: str) -> str:
    inner = f"""with want as (select distinct sample, lower(trim(value)) as value, lower(trim(type)) as type, model from ({EXPECTED}), (values ('small'), ('medium'), ('large')) t(model)),
 got as (select distinct sample, lower(trim(value)) as value, lower(trim(type)) as type, model from ({MODELS})),
 matched as (select model, type, case when w.f and g.f then 'tp' when g.f then 'fp' else 'fn' end as outcome
  from (select *, true as f from want) w full join (select *, true as f from got) g using (sample, value, type, model))
 {prf(f'select {by}, {_COUNTS} from matched group by {by}', by)}"""
    return sql_rounded(inner, f"{by}, tp, fp, fn", *PRF_D)


def integer_uniform(sample, replicate, seed):
    """An integer mix that any SQL engine can repeat."""
    mixed = F.pmod(sample * 2654435 + replicate.cast("bigint") * 7919 + seed * 97, F.lit(2147483647))
    mixed = F.pmod(mixed * 48271, F.lit(2147483647))
    return F.pmod(mixed * 16807, F.lit(2147483647)) / F.lit(2147483647.0)


def bootstrap(spark, sf_dir):
    out = E.bootstrap(samples(spark, sf_dir), matched(spark, sf_dir), replicates=1000, uniform=integer_uniform)
    return rounded(out)


def bootstrap_groups(spark, sf_dir):
    """The same intervals by one draw per outcome and replicate; its draws have no SQL twin."""
    return rounded(B.bootstrap(samples(spark, sf_dir), matched(spark, sf_dir)))


def _bootstrap_sql() -> str:
    total, term, steps = 0.0, 0.36787944117144233, []
    for k in range(12):
        total += term
        steps.append((k + 1, total))
        term /= k + 1
    draw = "case " + " ".join(f"when u >= {t!r}::DOUBLE then {k}" for k, t in reversed(steps)) + " else 0 end"
    u = "((((sample * 2654435 + r * 7919 + 42 * 97) % 2147483647) * 48271 % 2147483647) * 16807 % 2147483647)::DOUBLE / 2147483647"
    reps = prf("select r, sum(tp * d)::BIGINT as tp, sum(fp * d)::BIGINT as fp, sum(fn * d)::BIGINT as fn from drawn group by r", "r")
    return f"""with {_MATCH}, per as (select sample, {_COUNTS} from matched group by sample),
 drawn as (select r, tp, fp, fn, {draw} as d from (select *, {u} as u from per, range(1000) t(r))),
 reps as ({reps}), micro as ({_MICRO}),
 x as (select unnest(['precision', 'recall', 'f1']) as metric, unnest([precision, recall, f1]) as v, r from reps),
 o as (select metric, v, row_number() over (partition by metric order by v) - 1 as i from x),
 p as (select unnest(['precision', 'recall', 'f1']) as metric, unnest([precision, recall, f1]) as point from micro)
 select p.metric, round(point, 9) as point, round((select v from o where o.metric = p.metric and i = 25), 9) as lower, round((select v from o where o.metric = p.metric and i = 975), 9) as upper from p"""


# ablation and errors on the planted reports
TRUTH = """select doc_id as sample, 'CVE-2024-' || cast(1000 + doc_id % 60 as string) as value, 'cve' as type from documents
 union all select doc_id, 'http://c2-' || cast(doc_id % 40 as string) || '.evil' || cast(doc_id % 7 as string) || '.ru/payload.exe', 'url' from documents
 union all select doc_id, md5(cast(doc_id % 30 as string)), 'md5' from documents
 union all select doc_id, 'drop' || cast(doc_id % 25 as string) || '.phish.top', 'domain' from documents
 union all select doc_id, 'ftp://gone' || cast(doc_id % 3 as string) || '.evil.top/x', 'url' from documents where doc_id % 6 = 0
 union all select doc_id, 'evil' || cast(doc_id % 7 as string) || '.ru', 'domain' from documents where doc_id % 4 = 0
 union all select doc_id, '10.' || cast(doc_id % 9 as string) || '.0.0', 'ip' from documents where doc_id % 3 = 0"""


def labelled_docs(spark, sf_dir):
    docs = R.refang(V.reports(spark, sf_dir))
    return docs.selectExpr("doc_id as sample", "text", "clean", "if(doc_id % 5 = 0, 'true_negative', 'true_positive') as category")


def ablation(spark, sf_dir):
    truth = V.view(spark, sf_dir, TRUTH, "documents")
    texts = V.reports(spark, sf_dir).selectExpr("doc_id as sample", "text")
    scores = E.compare(truth, E.configuration_items(labelled_docs(spark, sf_dir), texts), "config", list(E.CONFIGURATIONS))
    return rounded(E.with_delta(scores, "config", "A. Regex Only"))


def regex_only(spark, sf_dir):
    truth = V.view(spark, sf_dir, TRUTH, "documents")
    docs = V.reports(spark, sf_dir).withColumnRenamed("doc_id", "sample")
    items = X.pattern_items(docs, "text", ["sample"], public_only=False).withColumn("confidence", F.lit(None).cast("double"))
    return rounded(E.micro(E.match(truth, items)))


def errors(spark, sf_dir):
    """The texts, clean ones and their matches are stored once: both the match and the classes need them."""
    matches = F.transform("matches", lambda m: F.struct(m["value"].alias("value"), m["rank"].alias("rank"), m["confidence"].alias("confidence")))
    docs = cut(X.extract(labelled_docs(spark, sf_dir)).withColumn("matches", matches))
    found = docs.select("sample", F.explode("matches").alias("m")).select("sample", "m.value", X.type_name(F.col("m.rank")).alias("type"), "m.confidence")
    docs = docs.drop("matches")
    return E.error_classes(E.match(V.view(spark, sf_dir, TRUTH, "documents"), found), docs)


_RAW_ALL = " union all ".join(O.raw_matches(k, "doc_id") for k in C.INDICATOR_TYPES)
_PUBLIC = f"(type <> 'ip' or coalesce({O.VALID_V4} and not (case when {O.VALID_V4} then {O._net(O._ipnum('value'))} else true end), false))"
_URLS = f"lower(array_to_string(regexp_extract_all(clean, {O.lit(O.pattern('url'))}), chr(10)))"


def _items_cte(name: str, steps, test: str = _PUBLIC) -> str:
    return (
        f"{name} as (with {O.refang_ctes(V.REPORTS, steps)} select distinct doc_id as sample, lower(trim(value)) as value, type, "
        f"type = 'domain' and lower(value) in {O.dset(C.BLOCKED_DOMAINS)} as listed, type = 'domain' and regexp_matches(lower(value), '\\.({'|'.join(C.FILE_EXTENSIONS)})$') as file_name, "
        f"type = 'domain' and contains({_URLS}, lower(value)) as in_url from ({_RAW_ALL}) where {test})"
    )


_ABLATION_SQL = f"""with truth as (select sample, lower(value) as value, type from ({TRUTH})), {_items_cte('rawitems', [])}, {_items_cte('cleanitems', O.STEPS)},
 got as (select 'A. Regex Only' as config, sample, value, type from rawitems union select 'B. Regex + Deobfuscation', sample, value, type from cleanitems
  union select 'C. Regex + Deobfusc. + Domain Filter', sample, value, type from cleanitems where not listed and not file_name
  union select 'D. Full Pipeline', sample, value, type from cleanitems where not listed and not file_name and not in_url),
 want as (select distinct config, sample, value, type from truth, (select distinct config from got)),
 matched as (select config, case when w.f and g.f then 'tp' when g.f then 'fp' else 'fn' end as outcome
  from (select *, true as f from want) w full join (select *, true as f from got) g using (config, sample, value, type)),
 scores as ({prf(f'select config, {_COUNTS} from matched group by config', 'config')})
 select config, tp, fp, fn, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, round(f1 - (select f1 from scores where config = 'A. Regex Only'), 9) as delta_f1 from scores"""

_REGEX_ONLY_SQL = f"""with truth as (select distinct sample, lower(value) as value, type from ({TRUTH})), {_items_cte('rawitems', [], f"(type <> 'ip' or {O.VALID_V4})")},
 matched as (select case when w.f and g.f then 'tp' when g.f then 'fp' else 'fn' end as outcome
  from (select *, true as f from truth) w full join (select *, true as f from rawitems) g using (sample, value, type))
 {sql_rounded(prf(f'select {_COUNTS} from matched'), 'tp, fp, fn', *PRF_D)}"""

_ERRORS = f"""{O.scored_ctes(V.REPORTS)}, truth as (select distinct sample, lower(value) as value, type from ({TRUTH})),
 got as (select distinct doc_id as sample, lower(trim(value)) as value, type from obs),
 wrong as (select sample, value, type, case when g.f then 'fp' else 'fn' end as outcome from (select *, true as f from truth) w full join (select *, true as f from got) g using (sample, value, type) where w.f is null or g.f is null),
 told as (select w.*, c.text, c.clean, case when c.doc_id % 5 = 0 then 'true_negative' else 'true_positive' end as category from wrong w join cleaned c on c.doc_id = w.sample),
 errs as (select sample, value, type, outcome, case when outcome = 'fp' then
  case when type = 'domain' then case when regexp_matches(text, '(?i)[A-Za-z0-9._%+-]+@' || regexp_escape(value)) then 'email_domain_leak' when category = 'true_negative' then 'benign_context_domain' else 'over_matching_domain' end
   when type = 'ip' then case when category = 'true_negative' then 'benign_context_ip' when len(list_filter(string_split(value, '.'), lambda p: p::INT >= 20)) = 0 then 'version_string_ip' else 'over_matching_ip' end
   when type in ('md5', 'sha1', 'sha256') then case when replace(value, '0', '') = '' then 'null_hash' else 'over_matching_hash' end
   when type in ('email', 'url') then case when category = 'true_negative' then 'benign_context_' else 'over_matching_' end || type else 'unknown' end
  else case when not contains(lower(clean), value) then 'deobfuscation_failure' when type in ('domain', 'ip') then type || '_filtered' when type = 'url' and starts_with(value, 'ftp://') then 'unsupported_scheme'
   when type = 'url' then 'url_regex_miss' when type in ('md5', 'sha1', 'sha256') then 'hash_regex_miss' else 'unknown' end end as class from told)"""

TAGGED = "select doc_id as sample, case doc_id % 4 when 0 then 'true_positive' when 1 then 'true_negative' when 2 then 'obfuscated' else 'edge_case' end as category, lang as tag, text from documents"


def gt_filter(spark, sf_dir):
    """Samples of a category that expect at least one url and carry a tag."""
    typed = V.view(spark, sf_dir, TRUTH, "documents").where("type <> 'url' or value like 'ftp%'")
    kept = E.filter_samples(V.view(spark, sf_dir, TAGGED, "documents"), typed, category="obfuscated", kind="url", tag="fr")
    return kept.select("sample", "category", "tag")


_TIMING_SQL = (
    f"with t as ({TIMINGS}), o as (select *, row_number() over (partition by stage order by ms) - 1 as i, count(*) over (partition by stage) as c from t) "
    "select stage, count(*) as n, round(sum(ms), 9) as total, min(ms) as min, max(ms) as max, round(avg(ms), 9) as mean, round(stddev_samp(ms), 9) as stdev, "
    "max(ms) filter (where i = floor(c * 0.95)) as p95, max(ms) filter (where i = floor(c * 0.99)) as p99, median(ms) as median from o group by stage"
)

QUERIES = {
    "eval_match": (matched, f"with {_MATCH} select * from matched"),
    "eval_micro": (on_match(E.micro), f"with {_MATCH} {sql_rounded(_MICRO, 'tp, fp, fn', *PRF_D)}"),
    "eval_per_type": (on_match(E.per_type), f"with {_MATCH} {sql_rounded(_TYPE, 'type, tp, fp, fn', *PRF_D)}"),
    "eval_macro": (on_match(E.macro), f"with {_MATCH} {sql_rounded(_MACRO, '', 'macro_precision', 'macro_recall', 'macro_f1', 'weighted_f1')}"),
    "eval_true_negatives": (on_both(E.true_negatives), f"with {_MATCH} select {_TN} as tn"),
    "eval_agreement": (
        on_both(lambda s, m: E.agreement(s, m).select(*[F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn")], "mcc", "kappa")),
        f"with {_MATCH} {sql_rounded(_AGREE, 'tp, fp, fn, tn', 'mcc', 'kappa')}",
    ),
    "eval_calibration": (
        on_match(E.calibration),
        f"with {_MATCH} select coalesce(type, 'all') as type, round(coalesce(avg(confidence) filter (where outcome = 'tp'), 0), 9) as tp_confidence, round(coalesce(avg(confidence) filter (where outcome = 'fp'), 0), 9) as fp_confidence from matched group by grouping sets ((type), ())",
    ),
    "eval_category_accuracy": (
        on_both(E.category_accuracy),
        f"with {_MATCH} select category, count(*) as samples, round(avg(case when sample in (select sample from matched where outcome <> 'tp') then 0.0 else 1.0 end), 9) as accuracy from samples group by category",
    ),
    "eval_compare": (compare(False), _compare_sql("model")),
    "eval_compare_by_type": (compare(True), _compare_sql("model, type")),
    "eval_bootstrap": (bootstrap, _bootstrap_sql()),
    "eval_bootstrap_groups": (bootstrap_groups, None),
    "eval_regex_only": (regex_only, _REGEX_ONLY_SQL),
    "eval_ablation": (ablation, _ABLATION_SQL),
    "eval_errors": (errors, f"with {_ERRORS} select sample, value, type, outcome, class from errs"),
    "eval_error_shares": (
        lambda spark, sf_dir: E.error_shares(errors(spark, sf_dir)),
        f"with {_ERRORS} select outcome, class, count(*) as n, round(count(*) * 100.0::DOUBLE / sum(count(*)) over (partition by outcome), 1) as share from errs group by outcome, class",
    ),
    "timing_stats": (
        lambda spark, sf_dir: rounded(E.timing_stats(V.view(spark, sf_dir, TIMINGS, "events"))),
        _TIMING_SQL,
    ),
    "timing_stats_spread": (lambda spark, sf_dir: rounded(SC.timing_stats(V.view(spark, sf_dir, TIMINGS, "events"), 20_000)), _TIMING_SQL),
    "throughput": (
        lambda spark, sf_dir: rounded(E.throughput(V.view(spark, sf_dir, TIMINGS, "events"))),
        f"select count(*) as samples, round(count(*) / (sum(ms) / 1000), 9) as per_second from ({TIMINGS})",
    ),
    "gt_filter": (
        gt_filter,
        f"select sample, category, tag from ({TAGGED}) where category = 'obfuscated' and tag = 'fr' and sample in (select sample from ({TRUTH}) where type = 'url' and value like 'ftp%')",
    ),
    "gt_summary": (
        lambda spark, sf_dir: E.dataset_summary(V.view(spark, sf_dir, TAGGED, "documents"), V.view(spark, sf_dir, TRUTH, "documents")),
        f"select 'category' as facet, category as name, count(*) as n from ({TAGGED}) group by category union all select 'type', type, count(*) from ({TRUTH}) group by type "
        f"union all select 'total', 'samples', count(*) from documents union all select 'total', 'expected', count(*) from ({TRUTH})",
    ),
    "eval_report": (
        on_both(lambda s, m: E.report(s, m, "r1", F.expr(V.AS_OF)).select("report_id", "created_at", "total_samples", "tp", "fp", "fn", "tn", "f1", "macro_f1", "mcc")),
        f"with {_MATCH}, a as ({_AGREE}) select 'r1' as report_id, {V.AS_OF} as created_at, (select count(*) from samples) as total_samples, m.tp, m.fp, m.fn, {_TN} as tn, round(m.f1, 9) as f1, "
        f"round((select macro_f1 from ({_MACRO})), 9) as macro_f1, round(a.mcc, 9) as mcc from ({_MICRO}) m, a",
    ),
}
