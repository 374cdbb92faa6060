"""Registered queries of the engine's operators over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the equivalent SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def fresh(spark: SparkSession, kind: str = "datasets") -> str:
    """A folder of its own below the shared one; only a local session may leave spark.checkpoint.dir unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same_sql(name: str, spark_sql: str, tables: list[str], oracle: str | None = None) -> None:
    """Register a query that Spark SQL and the oracle both express; the text of Spark reads the named tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_sql, **{n: t(spark, sf_dir, n) for n in tables})

    run.__name__ = name
    query(oracle or _bare(spark_sql, tables))(run)


def _bare(text: str, tables: list[str]) -> str:
    for n in tables:
        text = text.replace("{" + n + "}", n)
    return text


from tessera.queries import lifecycle, relational, transfer  # noqa: E402, F401
