"""Logical types as declarations spell them, and their Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from tessera.errors import TesseraError

SIMPLE = {"bool": T.BooleanType(), "int64": T.LongType(), "double": T.DoubleType(), "utf8": T.StringType(), "binary": T.BinaryType(), "date32": T.DateType()}
#: Types that a store may hold but declarations refuse (fixed values).
REFUSED = ("int8", "int16", "int32", "uint8", "uint16", "uint32", "uint64", "float32", "json", "uuid", "fixed_binary", "time", "list", "map", "struct", "timestamp(ns,UTC)")


@dataclass(frozen=True)
class LogicalType:
    """A declared type. Nanoseconds have no Spark type: they are a long, marked in the column's metadata."""

    spelling: str
    spark: T.DataType
    unit: str | None = None
    utc: bool = False

    @property
    def metadata(self) -> dict:
        return {"type": self.spelling, **({"unit": self.unit, "utc": self.utc} if self.unit else {})}


def parse_type(spelling: str) -> LogicalType:
    """`bool int64 double utf8 binary date32 decimal128(p,s) timestamp(ms|us|ns) timestamp(ms|us,UTC)`."""
    if spelling in SIMPLE:
        return LogicalType(spelling, SIMPLE[spelling])
    if m := re.fullmatch(r"decimal128\(([1-9]\d?),(0|[1-9]\d?)\)", spelling):
        p, s = int(m[1]), int(m[2])
        if p <= 38 and s <= p:
            return LogicalType(spelling, T.DecimalType(p, s))
    if m := re.fullmatch(r"timestamp\((ms|us|ns)(,UTC)?\)", spelling):
        if not (m[1] == "ns" and m[2]):
            spark = T.LongType() if m[1] == "ns" else T.TimestampType() if m[2] else T.TimestampNTZType()
            return LogicalType(spelling, spark, m[1], bool(m[2]))
    raise TesseraError("INVALID_DECLARATION", f"no such column type: {spelling}")


def type_of(kind: T.DataType) -> LogicalType | None:
    """The logical type that holds a Spark type exactly; None where there is none."""
    if isinstance(kind, T.DecimalType):
        return parse_type(f"decimal128({kind.precision},{kind.scale})")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return parse_type("int64")
    if isinstance(kind, T.FloatType):
        return parse_type("double")
    if isinstance(kind, T.TimestampNTZType):
        return parse_type("timestamp(us)")
    if isinstance(kind, T.TimestampType):
        return parse_type("timestamp(us,UTC)")
    return next((LogicalType(n, t) for n, t in SIMPLE.items() if t == kind), None)
