"""Operator 1: token counts as an exact length histogram.

Every document is encoded; tasks count documents per encoded length, and the counts
are added up. Running and suffix sums over the distinct lengths (in two levels:
ranges of lengths, then within a range) answer, for every context limit that occurs:
how many documents fit or do not, the tokens of either, the tokens left when longer
documents are cut to the limit, and the share of documents up to it (quantiles).

Defined results: null and empty texts have length 0 and are counted; repeated rows
count each; an empty table gives an empty histogram. Only text is read.
"""
from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beaconry.llm.common import cut, map_rows, table
from beaconry.llm.encode import default_path, encoder

RANGE = 1024


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """length, n_docs."""
    path = path or default_path()

    def each(rows: dict) -> dict:
        encode = encoder(path)
        found = Counter(len(encode.ids(t)) // 2 for t in rows["text"])
        return {"length": list(found), "n": list(found.values())}

    return map_rows(docs.select("text"), "length long, n long", each).groupBy("length").agg(F.sum("n").alias("n_docs"))


def sums(hist: DataFrame) -> DataFrame:
    """The histogram with its running and suffix sums; ``length`` is the context limit. It is
    stored first, since it is read twice and each reading would encode all texts."""
    tokens = F.col("length") * F.col("n_docs")
    ranged = cut(hist).withColumn("_range", F.floor(F.col("length") / RANGE))
    ranges = ranged.groupBy("_range").agg(F.sum("n_docs").alias("_d"), F.sum(tokens).alias("_t"))
    before, everything = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    ranges = ranges.select(
        "_range", F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"),
        F.sum("_d").over(everything).alias("_dn"), F.sum("_t").over(everything).alias("_tn"),
    )
    upto = W.partitionBy("_range").orderBy("length")
    out = ranged.withColumn("_d", F.sum("n_docs").over(upto)).withColumn("_t", F.sum(tokens).over(upto)).join(ranges, "_range")
    fit, fit_tokens = F.col("_d0") + F.col("_d"), F.col("_t0") + F.col("_t")
    return out.select(
        "length", "n_docs", fit.alias("docs_upto"), (F.col("_dn") - fit).alias("docs_over"),
        fit_tokens.alias("tokens_upto"), (F.col("_tn") - fit_tokens).alias("tokens_over"),
        (fit_tokens + F.col("length") * (F.col("_dn") - fit)).alias("tokens_cut"), (fit / F.col("_dn")).alias("share_upto"),
    )


def at_limits(summed: DataFrame, limits: list[int]) -> DataFrame:
    """docs_upto, docs_over, tokens_upto, tokens_over and tokens_cut for any limits, from the sums alone."""
    spark = summed.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    total = summed.agg(F.sum("n_docs").alias("dn"), F.sum(F.col("length") * F.col("n_docs")).alias("tn"))
    below = asked.join(F.broadcast(summed.select("length", "docs_upto", "tokens_upto")), F.col("length") <= F.col("limit"), "left").groupBy("limit").agg(
        F.coalesce(F.max("docs_upto"), F.lit(0)).alias("docs_upto"), F.coalesce(F.max("tokens_upto"), F.lit(0)).alias("tokens_upto")
    )
    over = F.coalesce(F.col("dn"), F.lit(0)) - F.col("docs_upto")
    return below.join(F.broadcast(total)).select(
        "limit", "docs_upto", over.alias("docs_over"), "tokens_upto", (F.coalesce(F.col("tn"), F.lit(0)) - F.col("tokens_upto")).alias("tokens_over"),
        (F.col("tokens_upto") + F.col("limit") * over).alias("tokens_cut"),
    )


def quantiles(summed: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the smallest length that at least this share of the documents does not exceed."""
    columns = [F.min(F.when(F.col("share_upto") >= s, F.col("length"))).alias(str(i)) for i, s in enumerate(shares)]
    rows = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(str(i)).alias("length")) for i, s in enumerate(shares)])
    return summed.agg(*columns).select(F.explode(rows).alias("q")).select("q.share", "q.length")


def op1_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sums(histogram(table(spark, sf_dir, "documents")))
