"""The canonical total order, and digests of contents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LARGEST = 9223372036854775807


@F.arrow_udf(T.LongType())
def _raw_bits(values: pa.Array) -> pa.Array:
    """The 64 bits of each double, without a round through text."""
    return pa.Array.from_buffers(pa.int64(), len(values), values.buffers(), offset=values.offset)


def double_key(column: Column) -> Column:
    """A long that orders doubles as IEEE totalOrder does: -NaN < -inf < ... < -0 < +0 < ... < inf < NaN."""
    bits = _raw_bits(column)
    return F.when(column.isNotNull(), bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(F.lit(LARGEST))))


def canonical_order(df: DataFrame) -> list[Column]:
    """Sort keys over all columns from left to right, nulls first; text and binary by unsigned bytes."""
    return [(double_key(F.col(f.name)) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)).asc_nulls_first() for f in df.schema.fields]


def row_hashes(df: DataFrame, columns: list[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row. Doubles go in by their bits, so -0 and 0 differ; nulls by their own mark."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name in columns:
        c = F.col(name)
        parts += [c.isNull(), double_key(c) if isinstance(kinds[name], T.DoubleType) else c]
    return F.xxhash64(*parts), F.xxhash64(F.lit(17), *parts)


def content_digest(df: DataFrame, by: list[str], columns: list[str] | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """`by`, n_rows and digest of each group's rows as a bag, and `more` aggregates: one aggregation, no sort."""
    first, second = row_hashes(df, columns or df.columns)
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    own = [c.alias(n) for n, c in (more or {}).items()]
    sums = df.withColumns({"_a": first, "_b": second}).groupBy(*by).agg(F.count("*").alias("n_rows"), wide(F.col("_a")).alias("_s"), wide(F.col("_b")).alias("_t"), F.bit_xor("_a").alias("_x"), *own)
    return sums.select(*by, "n_rows", F.sha2(F.concat_ws(":", "n_rows", "_s", "_t", "_x"), 256).alias("digest"), *[F.col(f"`{n}`") for n in more or {}])


def canonical_places(df: DataFrame, folder: str, name: str = "place") -> DataFrame:
    """`df` with each row's place in the canonical order, from 1.

    Rows are dealt by ranges and written to `folder`, as ranges may differ when they are computed again; then they are
    sorted within their range, whose first place follows from the sizes of those before it (one row each).
    """
    keys = canonical_order(df)
    df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()).write.parquet(folder)
    ranged = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(folder)
    within = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*keys)))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return within.join(F.broadcast(before), "_range").withColumn(name, F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")
