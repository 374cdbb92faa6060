"""Base-table sources: exact files, no inference of schema or partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.contract import TableContract
from tessera.errors import TesseraError


def catalog_table(spark: SparkSession, name: str) -> DataFrame:
    """A native base table of the catalog; views are refused."""
    found = spark.catalog.getTable(name)
    if found.tableType not in ("MANAGED", "EXTERNAL"):
        raise TesseraError("UNSUPPORTED_CAPABILITY", f"{name} is no base table")
    return spark.table(name)


def exact_files(spark: SparkSession, paths: list[str], contract: TableContract) -> DataFrame:
    """The named Parquet files with the declared schema; columns that a file lacks are null."""
    return spark.read.schema(contract.schema).option("mergeSchema", "false").parquet(*paths)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def altered_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files of a manifest (file, length, sha256) that are gone or have other bytes."""
    return manifest.join(file_hashes(spark, path), ["file", "length", "sha256"], "left_anti")
