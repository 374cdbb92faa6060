"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as Spark reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset, as
    there one machine's folder is shared by definition."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def packed(docs: DataFrame) -> DataFrame:
    """`row`, a struct of all columns: for operators that pass rows on, whatever their columns' names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def with_text(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """What to send to Python, and how to read the texts of a batch: `key` and the text, or `key` alone if it is a
    struct that holds the text (as `row` does `row.text`), so that no text is sent twice."""
    outer, _, inner = text.partition(".")
    if inner and outer == key:
        at = [f.name.lower() for f in docs.schema[key].dataType].index(inner.lower())
        return docs.select(key), lambda batch: batch.column(0).field(at)
    return docs.select(F.col(key), F.col(text).alias("_text")), lambda batch: batch.column(1)


#: Folders that `staged` has written, in order.
_made: list[str] = []


def staged(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: what follows survives a lost executor without computing `df` again. The folder stays, as
    results are read from it later, until `forget`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    _made.append(path)
    return spark.read.schema(schema).parquet(path)


def mark() -> int:
    """The place of what is staged from now on, for `forget`."""
    return len(_made)


def forget(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete what was staged since a mark, but for the last `keep` folders. No result that is still to be computed
    may read from it."""
    for path in _made[since : len(_made) - keep]:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    del _made[since : len(_made) - keep]
