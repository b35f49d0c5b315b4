"""Operator 9: mixing sources to target weights.

Tokens are aggregated per source, targets divide the total by weight, and each
document is emitted floor(rate) times plus one more time when a hash-seeded draw
falls below the fraction. Only built-in expressions are used.

Defined results: a null text counts no words; null sources form one source that
ranks last; a source without words has target 0 and rate 0, so its documents are
not emitted; a null doc_id draws like the text "null"; repeated rows draw alike;
an empty table gives an empty table; further input columns may have any name, those
of the working columns included, for the input row is carried as one struct.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beaconry.llm.common import WORD, cut, table

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix"
#: Sources up to this many are sent to every task (under 8 MB with names of usual length); more are joined by salted keys.
SENT_SOURCES = 50_000
SALTS = 32


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target, rate of (source, size) rows.

    Sources by code point, null last, take the weights in turn. With caps in order
    of cap over weight, the level of a source is what the others leave it per unit
    of weight; the highest level is the one at which the total is spent, and a
    source gets weight times level or its cap, whichever is smaller.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    ranked = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * cap)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(everything))
    return (
        ranked.withColumn("level", level).withColumn("target", target)
        .select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    )


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform number in [0, 1) from the id."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def with_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Two structs a document: ``_row``, its input row, and ``_mix``: size, source_size, target, rate, copies.
    Input columns are only reached through ``_row``, so none can clash with a working column."""
    sized = docs.select(F.struct("*").alias("_row"), words(F.col("text")).alias("_size"), draw(F.col("doc_id"), seed).alias("_draw"),
                        F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int").alias("_salt"))
    sources = cut(plan(docs.select("source", words(F.col("text")).alias("size")), weights, cap)).select(
        F.struct("source_size", "target", "rate").alias("_plan"), F.col("source").alias("_source")
    )
    same = F.col("_row.source").eqNullSafe(F.col("_source"))
    if sources.limit(SENT_SOURCES + 1).count() <= SENT_SOURCES:
        joined = sized.join(F.broadcast(sources), same)
    else:
        salted = sources.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sized.join(salted, same & (F.col("_salt") == F.col("_part")))
    rate = F.col("_plan.rate")
    copies = (F.floor(rate) + (F.col("_draw") < rate - F.floor(rate)).cast("long")).cast("long")
    return joined.select("_row", F.struct(F.col("_size").alias("size"), "_plan.source_size", "_plan.target", "_plan.rate", copies.alias("copies")).alias("_mix"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document as often as it was drawn."""
    return with_copies(docs, **options).select("_row", F.explode(F.expr("array_repeat(0, int(_mix.copies))"))).select("_row.*")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = with_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("_row.doc_id", "_mix.size", "_mix.source_size", "_mix.target", (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return emit(docs)


#: Common table expressions over a table {docs}; pieces serve the pipeline's twin too.
MIX_CTES = r"""
sized as (select *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as _size from {docs}),
per as (select source as _source, sum(_size)::bigint as source_size from sized group by source),
ranked as (select *, [5, 2, 1][((row_number() over (order by _source asc nulls last) - 1) % 3 + 1)::int] as weight, source_size * 3 as cap from per),
levels as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, _source asc nulls last
    rows between unbounded preceding and 1 preceding), 0))::double
  / (sum(weight) over (order by cap / weight, _source asc nulls last rows between current row and unbounded following))::double as level from ranked),
goals as (select _source, source_size, least(cap::double, weight * max(level) over ()) as target from levels),
rates as (select *, case when source_size > 0 then target / source_size else 0.0 end as rate from goals),
mixed as (select d.* exclude (_size), d._size as size, r.source_size, r.target,
    (floor(rate) + (('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':mix'), 1, 12))::ubigint::double / 281474976710656.0
      < rate - floor(rate))::int)::bigint as copies
  from sized d join rates r on d.source is not distinct from r._source)"""

ORACLE = "with " + MIX_CTES.format(docs="documents") + " select doc_id, size, source_size, target, size * copies as taken from mixed"
