"""Column helpers shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add (or replace) an expensive column that later steps use many times.

    The one-element explode is a plan boundary: the optimizer neither copies the
    expression into each place that uses the column nor pushes a filter on it
    below its computation. Filters on other columns still reach the scan.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(value)).alias(name))


#: Inputs above this many bytes are never dealt anew: they have splits enough, and their texts stay where they are.
SPREAD_BYTES = 1 << 28


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal out an input of a single file that has fewer scan partitions than the session has slots.

    This only concerns inputs of up to ``SPREAD_BYTES`` (one row group that cannot be
    split); rows are the same either way. Anything larger passes through without a shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > SPREAD_BYTES:
        return df
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast hint for a side with at most ``rows`` rows; larger sides join by
    shuffle. The check stops counting at the limit."""
    return F.broadcast(df) if df.select(F.lit(1)).limit(rows + 1).count() <= rows else df


def lookup(key: Column, table: dict, default) -> Column:
    """Small fixed lookup table as a codegen-friendly CASE expression."""
    by_value: dict = {}
    for name, value in table.items():
        by_value.setdefault(value, []).append(name)
    out = None
    for value, names in by_value.items():
        test = key.isin(names)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(default))


def hours_between(start: Column, end: Column) -> Column:
    """Signed hours from ``start`` to ``end`` as a double."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)


def clamp01(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))
