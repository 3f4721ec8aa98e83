"""Exact medians whose memory does not grow with a group: counts of ranges first, then the middle range only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FINENESS = 256  # ranges for a factor of e
LARGEST = 1 << 19  # above the range of every finite number


def range_of(value: Column) -> Column:
    """The number of the range that a double lies in: it never falls where the value rises. NaN is above all, as in Spark's order."""
    size = F.abs(value)
    step = F.when(size == float("inf"), LARGEST - 1).otherwise(F.floor(F.log(size) * FINENESS) + (LARGEST >> 1))
    return F.when(F.isnan(value), LARGEST).when(value > 0, step).when(value < 0, -step).otherwise(0)


def medians(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """``by`` and the exact median of each of ``values``, as ``F.median`` gives it; null for a group without any, groups
    without any value at all are left out.

    Rows are first counted by value, inside the tasks and then by the hash of group and value, so a hot group is divided.
    Of a group as a whole one task sees the counts of its ranges, which are a few thousand; the one or two ranges that
    hold the middle are sorted, with spill.
    """
    names = list(values)
    if len(names) == 1:
        long = rows.select(*by, F.lit(0).alias("_of"), values[names[0]].cast("double").alias("_v"))
    else:
        each = F.array(*[F.struct(F.lit(i).alias("_of"), values[n].cast("double").alias("_v")) for i, n in enumerate(names)])
        long = rows.select(*by, F.explode(each).alias("_e")).select(*by, "_e.*")
    keys = [*by, "_of"]
    counts = long.where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_range", range_of(F.col("_v")))
    mine = W.partitionBy(*keys)
    ranges = counts.groupBy(*keys, "_range").agg(F.sum("_n").alias("_in"))
    before = F.coalesce(F.sum("_in").over(mine.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*keys, "_range", "_in", before.alias("_before"), F.sum("_in").over(mine).alias("_all"))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    ranges = ranges.select("*", low.alias("_low"), high.alias("_high")).where("_before < _high AND _before + _in >= _low")
    middle = ranges.select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate([*keys, "_range"])], "_before", "_low", "_high")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate([*keys, "_range"])])
    inside = W.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    placed = counts.join(middle, same).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    at = lambda place: F.min(F.when(F.col("_upto") >= F.col(place), F.col("_v")))
    found = placed.groupBy(*keys).agg(at("_low").alias("_lo"), at("_high").alias("_hi"))
    median = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") * 0.5 + F.col("_hi") * 0.5)
    return found.groupBy(*by).agg(*[F.min(F.when(F.col("_of") == i, median)).alias(n) for i, n in enumerate(names)])
