"""Table contracts: ordered columns and partition keys, exact checks, append-only evolution."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import TesseraError
from tessera.types import parse_type

NAME = re.compile(r"[a-z0-9][a-z0-9_-]{0,63}")


@dataclass(frozen=True)
class TableContract:
    """Ordered (name, type) columns. A partition key k has its value in the utf8 column `_k_`."""

    columns: tuple[tuple[str, str], ...]
    partition_keys: tuple[str, ...] = ()
    extensions: dict = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        names = [n for n, _ in self.columns]
        if len(set(names)) != len(names):
            raise TesseraError("INVALID_DECLARATION", "a column is declared twice")
        kinds = dict(self.columns)
        for key in self.partition_keys:
            if kinds.get(f"_{key}_") != "utf8":
                raise TesseraError("INVALID_DECLARATION", f"partition key {key} needs the utf8 column _{key}_")
        if self.extensions:
            raise TesseraError("UNSUPPORTED_CAPABILITY", f"unknown extensions: {sorted(self.extensions)}")
        for _, kind in self.columns:
            parse_type(kind)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, (t := parse_type(k)).spark, True, t.metadata) for n, k in self.columns])

    @property
    def partition_columns(self) -> list[str]:
        return [f"_{k}_" for k in self.partition_keys]

    def is_prefix_of(self, other: TableContract) -> bool:
        return self.partition_keys == other.partition_keys and other.columns[: len(self.columns)] == self.columns


def evolve(baseline: TableContract | None, proposal: TableContract) -> TableContract:
    """The new baseline: the same, or with further trailing columns; anything else is refused."""
    if baseline is None or baseline.is_prefix_of(proposal):
        return proposal
    raise TesseraError("STATE_CONFLICT", "a table only gains trailing columns; renamed, retyped, reordered or dropped ones need a new table")


def assert_exact_schema(df: DataFrame, contract: TableContract) -> DataFrame:
    """`df` itself if its names, order and types are the contract's; no casts."""
    have = [(f.name, f.dataType) for f in df.schema.fields]
    want = [(f.name, f.dataType) for f in contract.schema.fields]
    if have != want:
        raise TesseraError("INVALID_DECLARATION", f"columns {have} differ from the declared {want}")
    return df


def empty(spark: SparkSession, contract: TableContract) -> DataFrame:
    """A typed relation without rows."""
    return spark.createDataFrame([], contract.schema)


def padded(df: DataFrame, contract: TableContract) -> DataFrame:
    """`df`, whose columns are a prefix of the contract's, with typed nulls for the missing tail."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = contract.schema.fields
    if df.columns != [f.name for f in want[: len(df.columns)]] or any(have[f.name] != f.dataType for f in want if f.name in have):
        raise TesseraError("INTEGRITY_FAILURE", "a file's columns are no prefix of the table's")
    return df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in want])
