"""Exact medians without a group's values in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with(df: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`df` with the other columns of a small table, by equal keys; nulls are equal."""
    named = groups.withColumnsRenamed({c: f"_of_{i}" for i, c in enumerate(keys)})
    return df.join(F.broadcast(named), reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(keys)]), how).drop(*[f"_of_{i}" for i in range(len(keys))])


def with_medians(df: DataFrame, by: list[str], value: str, rough: DataFrame, near: str) -> DataFrame:
    """`rough` (one row for each group of `by`) and `median`, the exact one of the values that are not null.

    `near` is a column of `rough` with a lower and an upper bound, between which the median is thought to lie. Rows below,
    between and above are counted; only the part that holds the middle ranks is ordered, by its distinct values. So bounds
    that miss the median cost time, but change nothing. What has one row for each group is broadcast.
    """
    values = df.select(*by, F.col(value).alias("_value")).where(F.col("_value").isNotNull())
    part = F.when(F.col("_value") < F.col("_near")[0], 0).when(F.col("_value") <= F.col("_near")[1], 1).otherwise(2)
    dealt = _with(values, rough.select(*by, F.col(near).alias("_near")), by).select(*by, "_value", part.alias("_part"))
    group = Window.partitionBy(*by)
    sizes = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n")).withColumns({"_upto": F.sum("_n").over(group.orderBy("_part")), "_all": F.sum("_n").over(group)})
    low, high = F.expr("(_all - 1) div 2"), F.expr("_all div 2")
    held = sizes.withColumn("_before", F.col("_upto") - F.col("_n")).where((F.col("_before") <= high) & (F.col("_upto") > low)).select(*by, "_part", "_before", "_all")
    counted = _with(dealt, held, [*by, "_part"]).groupBy(*by, "_part", "_before", "_all", "_value").agg(F.count("*").alias("_n"))
    upto = counted.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_value")))
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_value")))
    return _with(rough, upto.groupBy(*by).agg(((at(low) + at(high)) / 2).alias("median")), by, "left")
