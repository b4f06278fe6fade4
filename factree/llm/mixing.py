"""Mixing sources to target weights: weighted sampling without replacement by exponential keys (Efraimidis and Spirakis).

Each document gets the key -ln(u) / w, with u in (0, 1) from a digest of its id and w its quality weight; in key
order a prefix of a source is a weighted sample. A source's target is met by whole epochs (all its documents,
once each) first, then by the documents of one more epoch in key order until the words left are spent; the
document at the border gives just the words that are left, so a source's words equal its target rounded down.

Prefix sums never put a source into one task: rows are range-partitioned by source, key, id, size and row number, so slices hold
about SLICE rows each however the keys, the weights or the ids are spread (a third of the rows may share one id or
have no id). Only sums per (source, slice) and each slice by itself are put in order. The targets need one row per source in order,
which is the only step that is not spread out.

Defined results: a null text has size 0 and takes nothing; null is a source of its own and comes last; equal keys
go by id (null last), then size, then row; rows equal in id each count and get a share of their own. A weight that is null, NaN or not above 0 puts a row
behind all others of its source, so it is taken only in whole epochs or once all others are; it never drops a row. An empty table gives no
rows. Sizes of 0 everywhere give targets of 0. Other columns are not looked at; mixed() hands them on as they are and adds
taken, called _taken if the table has a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import WORD, fresh, numbered, release, scratch

#: About so many rows are put in order together.
SLICE = 50_000
#: No target is more than so many times its source.
MOST = 3


def uniform(doc_id: Column, seed: str) -> Column:
    """In (0, 1), from the first 52 bits of an MD5 digest of the id as text."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def quality_weight(text: Column) -> Column:
    """In (0, 1]: the share of the text's characters that are not marks of markup, shouting or tables; 1 for none."""
    text = F.coalesce(text, F.lit(""))
    odd = F.length(text) - F.length(F.translate(text, "#$%&*|!0123456789", ""))
    return (F.length(text) - odd + 1) / (F.length(text) + 1)


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> and weight, target: all sizes shared by weights 1, 2, 3, 1, ... with no target above
    MOST times its source's size and the excess reshared by weight.

    The shares end at min(MOST * size, level * weight) with one level for all: sources in order of MOST * size /
    weight are full up to the last whose ratio is below the level that the rest would get."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    by_ratio = Window.orderBy(F.col("source_size") * MOST / F.col("weight"), F.col("source").asc_nulls_last())
    all_of = Window.partitionBy()
    filled = (
        ranked.withColumn("rank", F.row_number().over(by_ratio))
        .withColumn("total", F.sum("source_size").over(all_of))
        .withColumn("before", F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - MOST * F.col("before")) / F.col("weights_left"))
        .withColumn("open", F.col("source_size") * MOST >= F.col("level") * F.col("weight"))
        .withColumn("final", F.max_by("level", F.when(F.col("open"), -F.col("rank"))).over(all_of))
    )
    most = (F.col("source_size") * MOST).cast("double")
    level = F.col("final") * F.col("weight")
    return filled.select("source", "source_size", "weight", F.when(F.col("final").isNull() | (most < level), most).otherwise(level).alias("target"))


def keys(doc_id: Column, weight: Column, seed: str) -> Column:
    weight = weight.cast("double")
    return F.when((weight > 0) & ~F.isnan(weight), -F.log(uniform(doc_id, seed)) / weight).otherwise(F.lit(float("inf")))


def mix(spark: SparkSession, docs: DataFrame, weight: Column | None = None, seed: str = "mix", row: str | None = None) -> DataFrame:
    """docs with columns doc_id, source, text -> doc_id, size, source_size, target, taken and rid, one row per document.

    row names a column of longs that tells rows apart and becomes rid; without it one is made."""
    weight = quality_weight(F.col("text")) if weight is None else weight
    sized = docs.select(
        (F.col(f"`{row}`") if row else F.monotonically_increasing_id()).alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        keys(F.col("doc_id"), weight, seed).alias("key"),
    )
    sized = scratch(spark, sized, "sizes")
    order = ["key", F.col("doc_id").asc_nulls_last(), "size", "rid"]
    slices = -(-max(1, sized.count()) // SLICE)
    placed = sized.repartitionByRange(slices, F.col("source").asc_nulls_last(), *order).withColumn("slice", F.spark_partition_id())
    placed = scratch(spark, placed, "slices")
    release(sized)
    sums = scratch(spark, placed.groupBy("source", "slice").agg(F.sum("size").alias("n")), "sums")

    plan = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.select(F.col("source").alias("s1"), "source_size", "target", epochs.alias("epochs"))
    plan = scratch(spark, plan.withColumn("left", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")).coalesce(1), "targets")
    up_to = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s2"), F.col("slice").alias("at"), F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("start"))
    starts = scratch(spark, starts.join(plan, F.col("s2").eqNullSafe(F.col("s1"))).drop("s1"), "starts")

    within = Window.partitionBy("source", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("upto", F.sum("size").over(within) - F.col("size"))
    summed = summed.join(F.broadcast(starts) if _small(starts) else starts, F.col("source").eqNullSafe(F.col("s2")) & (F.col("slice") == F.col("at")))
    spare = F.col("left") - F.col("start") - F.col("upto")
    part = F.greatest(F.lit(0), F.least(F.col("size"), spare))
    return summed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "rid")


def _small(table: DataFrame, most: int = 100_000) -> bool:
    return table.limit(most + 1).count() <= most


def mixed(spark: SparkSession, docs: DataFrame, weight: Column | None = None, seed: str = "mix") -> DataFrame:
    """The documents that the mix takes, with their columns and, last, the words to read of each (repeats counted)."""
    row, taken = fresh("row", docs), fresh("taken", docs)
    rows = numbered(spark, docs, row)
    key = fresh("rid", rows)
    took = mix(spark, rows, weight, seed, row).filter("taken > 0").select(F.col("rid").alias(key), F.col("taken").alias(taken))
    return rows.join(took, rows[row] == took[key]).drop(row, key)
