"""Rows in order by sampled ranges, so that one key, however large, is spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.rows import settled


def in_ranges(rows: DataFrame, by: list[str], block: str = "block") -> DataFrame:
    """rows, settled, in the order of the columns `by` (nulls first), and `block`, the number of the range that a task holds.

    Rows that agree in all of `by` lie in one range.
    """
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return settled(dealt.withColumn(block, F.spark_partition_id()))


def of_several(ranges: DataFrame, key: str, block: str = "block") -> DataFrame:
    """key, block: the values of `key`, the first column of the order, that lie in several ranges, with each of these: two rows a range at most."""
    ends = ranges.groupBy(block).agg(F.min(F.struct(key)).alias("low"), F.max(F.struct(key)).alias("high"))
    ends = ends.select(block, F.explode(F.array_distinct(F.array("low", "high"))).alias("of"))
    counted = ends.withColumn("n", F.count("*").over(Window.partitionBy("of")))
    return counted.where("n > 1").select(F.col(f"of.{key}").alias(key), block)


def spread_maxima(covers: DataFrame, key: str, value: str) -> DataFrame:
    """key, block, value: the greatest value over each block that any of `covers` (key, first, last, value) covers.

    A cover is two stretches of a power of two that overlap, and longer stretches hand their maxima down to their halves, so
    what is written grows with the covers and with blocks times the logarithm of the longest, not with covers times blocks.
    """
    sized = covers.where("first <= last").withColumn("level", F.floor(F.log2(F.col("last") - F.col("first") + 1)).cast("int"))
    starts = F.array_distinct(F.array(F.col("first").cast("int"), (F.col("last") - F.pow(F.lit(2), F.col("level")) + 1).cast("int")))
    found = settled(sized.select(key, "level", F.explode(starts).alias("at"), value).groupBy(key, "level", "at").agg(F.max(value).alias(value)))
    top = found.agg(F.max("level")).first()[0] or 0
    for level in range(top, 0, -1):
        long = found.where(F.col("level") == level)
        halves = F.explode(F.array(F.col("at"), F.col("at") + (1 << level - 1)))
        lower = found.where(F.col("level") < level).unionByName(long.select(key, F.lit(level - 1).alias("level"), halves.alias("at"), value))
        found = settled(lower.groupBy(key, "level", "at").agg(F.max(value).alias(value)))
    return found.select(key, F.col("at").alias("block"), value)


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with `name`, their number from 1 within each key (nulls are one) in the order of the columns, a key of any size spread over tasks."""
    dealt = in_ranges(rows.withColumn("_key", F.struct(key)), ["_key", *order], "_block")
    cut = F.broadcast(settled(of_several(dealt, "_key", "_block")))  # two rows a range at most
    along = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.join(cut, ["_key", "_block"]).groupBy("_key", "_block").agg(F.count("*").alias("_n"))
    before = counts.select("_key", "_block", F.sum("_n").over(along).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_block", "_key").orderBy(*order))
    met = dealt.join(F.broadcast(before), ["_key", "_block"], "left")
    return met.withColumn(name, (here + F.coalesce("_before", F.lit(0))).cast("long")).drop("_key", "_block", "_before")
