"""Joins that Spark's SQL has no word for, as compositions of its own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with `values` of the latest right row of the same keys at or before its time (null: none).

    One shuffle by key: both sides are put together, and a window carries the last right row forward. Spark spills
    the window's sort, so a hot key costs time but no memory. Right rows that tie in time: the greatest values win.
    """
    carried = F.struct(*[F.col(v).alias(v) for v in values])
    r = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), carried.alias("_v"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in by])
    l = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), *[c for c in left.columns if c not in by])  # noqa: E741
    order = Window.partitionBy(*by).orderBy("_t", "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l).withColumn("_last", F.last("_v", ignorenulls=True).over(order))
    return both.where("_side = 1").select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high, as an equi-join on cells of `width`; a range is listed in each cell it meets."""
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    own = points.withColumn("_cell", F.floor(F.col(point) / width))
    return own.join(cells, "_cell").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_cell")


def latest(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key in an order: what `QUALIFY row_number() = 1` says in other dialects."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", first).where("_rank = 1").drop("_rank")


def append_new(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `source` whose key `target` hasn't."""
    return source.join(target.select(*key), key, "left_anti")
