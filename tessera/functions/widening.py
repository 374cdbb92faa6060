"""Exact widening: types are proven first, so that no cast can round, wrap or move a zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.contract import TableContract
from tessera.errors import TesseraError
from tessera.types import LogicalType, parse_type

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def widens(source: T.DataType, target: LogicalType) -> bool:
    """Whether every value of `source` has one exact value of `target`."""
    to = target.spark
    if target.unit == "ns":
        return isinstance(source, T.TimestampNTZType)
    if isinstance(to, T.LongType):
        return isinstance(source, WHOLE)
    if isinstance(to, T.DoubleType):
        return isinstance(source, (T.FloatType, T.DoubleType))
    if isinstance(to, T.DecimalType):
        return isinstance(source, T.DecimalType) and to.scale >= source.scale and to.precision - to.scale >= source.precision - source.scale
    return source == to


def widened(column: Column, source: T.DataType, target: LogicalType) -> Column:
    """The column as `target`. Milliseconds must have no finer part; nanoseconds become a count since the epoch."""
    if not widens(source, target):
        raise TesseraError("INVALID_DECLARATION", f"{source.simpleString()} does not widen exactly to {target.spelling}")
    if target.unit == "ns":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column) * F.lit(1000)
    if target.unit == "ms":
        fine = (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("long") % 1000 != 0
        return F.when(fine, F.raise_error(F.lit("INVALID_ARGUMENT: a timestamp has more than milliseconds"))).otherwise(column)
    return column.cast(target.spark)


def project(df: DataFrame, columns: list[dict]) -> DataFrame:
    """Ordered `{name, source, type}` columns: select, rename, widen. A source may feed several outputs."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in columns:
        source = c.get("source", c["name"])
        head, *path = source.split(".")
        if head not in fields:
            raise TesseraError("INVALID_DECLARATION", f"no source column {source}")
        kind = fields[head]
        for part in path:  # a path through structs; a null parent gives null
            if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
                raise TesseraError("INVALID_DECLARATION", f"no source column {source}")
            kind = kind[part].dataType
        target = parse_type(c["type"])
        out.append(widened(F.col(source), kind, target).alias(c["name"], metadata=target.metadata))
    return df.select(*out)


def conform(df: DataFrame, contract: TableContract) -> DataFrame:
    """A query's output as declared: names and order exact, types exact or exactly widened."""
    if df.columns != [n for n, _ in contract.columns]:
        raise TesseraError("INVALID_DECLARATION", f"columns {df.columns} differ from the declared {[n for n, _ in contract.columns]}")
    return project(df, [{"name": n, "type": t} for n, t in contract.columns])
