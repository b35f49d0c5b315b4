"""Registered queries of the text family."""
from __future__ import annotations

from pyspark.sql import functions as F

from beaconry import constants as C
from beaconry.operators import extract as X
from beaconry.operators import refang as R
from beaconry.plans import oracle_text as O
from beaconry.plans import views as V


def _clean_reports(spark, sf_dir):
    return R.refang(V.reports(spark, sf_dir))


def refang_documents(spark, sf_dir):
    return _clean_reports(spark, sf_dir).select("doc_id", "clean", "was_modified")


def refang_rate_by_source(spark, sf_dir):
    docs = R.refang(V.table(spark, sf_dir, "documents"))
    return docs.groupBy("source").agg(
        F.count("*").alias("docs"), F.count_if("was_modified").alias("modified")
    )


def refang_rule(rule):
    def run(spark, sf_dir):
        docs = R.only(V.masked(spark, sf_dir), rule)
        return docs.where("was_modified").select("doc_id", "clean", "was_modified")

    return run


def extract_kind(kind):
    def run(spark, sf_dir):
        return X.extract_positions(_clean_reports(spark, sf_dir), kind, ["doc_id"])

    return run


def extract_scored(spark, sf_dir):
    found = X.observations(X.extract(_clean_reports(spark, sf_dir)), ["doc_id"])
    return found.select("doc_id", "place", "value", "type", F.round("confidence", 4).alias("confidence"), "snippet")


# Full-width letters, which only Unicode normal form turns into plain ones.
WIDE = "select doc_id, text || case doc_id % 3 when 0 then ' ｅｖｉｌ．ｔｏｐ' else '' end as text from documents"


def refang_nfkc(spark, sf_dir):
    docs = R.only(V.view(spark, sf_dir, WIDE, "documents"), "nfkc")
    return docs.where("was_modified").select("doc_id", "clean", "was_modified")


QUERIES = {
    "refang_documents": (
        refang_documents,
        f"with {O.refang_ctes(V.REPORTS)} select doc_id, clean, was_modified from cleaned",
    ),
    "refang_rate_by_source": (
        refang_rate_by_source,
        f"with {O.refang_ctes('select * from documents')} select source, count(*) as docs, "
        "count(*) filter (where was_modified) as modified from cleaned group by source",
    ),
}
for _rule in R.RULES:
    QUERIES[f"refang_{_rule}"] = (refang_rule(_rule), O.refang_rule(_rule) if _rule in O.RULE_STEPS else None)
QUERIES["refang_nfkc"] = (
    refang_nfkc,
    f"select doc_id, translate(text, 'ｅｖｉｌ．ｔｏｐ', 'evil.top') as clean, true as was_modified from ({WIDE}) where doc_id % 3 = 0",
)
for _kind in C.INDICATOR_TYPES:
    QUERIES[f"extract_{_kind}"] = (extract_kind(_kind), O.extract_kind(_kind))
QUERIES["extract_scored"] = (extract_scored, O.extract_scored())
