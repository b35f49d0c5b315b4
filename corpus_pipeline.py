"""Corpus pipeline: each stage reads what its predecessor wrote and keeps.

``STAGES`` lists (name, function) in order; a function takes (spark, docs, sf_dir)
and returns a DataFrame. All stages but the last return the columns of documents.
Nulls, empty tables, repeated rows and further columns are handled by the
operators as their docstrings say; columns other than doc_id, text and source are
carried along untouched.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beaconry.llm import decontaminate, grammar, minhash, mixing, toxicity
from beaconry.llm.common import fresh_folder

STAGES = [
    ("toxicity", toxicity.stage),
    ("minhash_near_dedup", minhash.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("token_output", grammar.stage),
]

#: The stages learn weights, compare shingle sets and compress; SQL has no twin for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_folder(spark)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
