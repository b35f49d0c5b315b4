"""Enrichment of indicators from local geo, registration and resolution tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.operators.extract import is_ipv4


def clean_indicator(value: Column) -> Column:
    """Scheme, path and masking removed."""
    host = F.split_part(F.replace(F.replace(value, F.lit("http://"), F.lit("")), F.lit("https://"), F.lit("")), F.lit("/"), F.lit(1))
    return F.replace(F.replace(host, F.lit("[.]"), F.lit(".")), F.lit("[:]"), F.lit(":"))


def route(name: str) -> Column:
    value = F.col(name)
    return F.when(F.expr(is_ipv4(name)), "ip").when(value.contains(".") & ~value.contains(" "), "domain")


def ip_number(value: Column) -> Column:
    out = F.lit(0).cast("bigint")
    for i in range(1, 5):
        out = out * 256 + F.split_part(value, F.lit("."), F.lit(i)).cast("bigint")
    return out


def with_geo(rows: DataFrame, ranges: DataFrame, ip: str, prefix: str) -> DataFrame:
    """Left range join. Ranges are cut at /16 borders and the join is an equi-join
    on the /16, with the exact bounds as residual."""
    cut = ranges.select(
        F.explode(F.sequence(F.shiftright("low", 16), F.shiftright("high", 16))).alias("_slash16"),
        "low", "high", F.col("country").alias(f"{prefix}country"), F.col("org").alias(f"{prefix}org"),
    )
    keyed = rows.withColumn("_n", F.when(F.expr(is_ipv4(ip)), ip_number(F.col(ip)))).withColumn("_k", F.shiftright("_n", 16))
    hit = (F.col("_k") == F.col("_slash16")) & F.col("_n").between(F.col("low"), F.col("high"))
    return keyed.join(cut, hit, "left").drop("_n", "_k", "_slash16", "low", "high")


def enrich(iocs: DataFrame, ranges: DataFrame, registrations: DataFrame, answers: DataFrame, value: str = "ioc") -> DataFrame:
    """Addresses get country and organisation; domains get registrar and creation
    date, and what their resolved address has."""
    rows = iocs.withColumn("clean_ioc", clean_indicator(F.col(value))).withColumn("kind", route("clean_ioc"))
    rows = rows.where(F.col("kind").isNotNull())
    rows = rows.join(registrations.withColumnRenamed("domain", "clean_ioc"), "clean_ioc", "left")
    rows = rows.join(answers.withColumnRenamed("domain", "clean_ioc"), "clean_ioc", "left")
    rows = rows.withColumn("address", F.when(F.col("kind") == "ip", F.col("clean_ioc")).otherwise(F.col("resolved_ip")))
    return with_geo(rows, ranges, "address", "")
