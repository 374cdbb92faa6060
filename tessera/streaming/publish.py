"""Publish a stream's micro-batches as revisions, and windowed totals with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.contract import TableContract
from tessera.dataset import Dataset


def publish_stream(stream: DataFrame, dataset: Dataset, table: str, contract: TableContract, key: list[str], checkpoint: str) -> StreamingQuery:
    """Each micro-batch's rows with new keys are appended to the table and published as the next revision.

    Rows of partitions that the batch doesn't touch are neither read nor written: of a partitioned table only the
    touched partitions are read for their keys, so keys are told apart within a partition, and written anew. A batch
    that is delivered again after a failure has no new keys, so it publishes nothing.
    """

    def publish(batch: DataFrame, _: int) -> None:
        fresh = batch.select(*[n for n, _ in contract.columns]).dropDuplicates([*key, *contract.partition_columns])
        if table in dataset.contracts():
            touched = None
            if contract.partition_keys:  # one row per partition of the batch
                touched = [dict(zip(contract.partition_keys, r, strict=True)) for r in fresh.select(*contract.partition_columns).distinct().collect()]
            old = dataset.read(table, partitions=touched)
            fresh = old.unionByName(fresh.join(old.select(*key, *contract.partition_columns), [*key, *contract.partition_columns], "left_anti").select(*old.columns))
        dataset.push({table: (fresh, contract)}, reason="stream", infer_omissions=False)

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_totals(stream: DataFrame, time: str, value: str, by: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and key; rows later than `late` behind the newest are left out."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, length), by)
    totals = grouped.agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total"))
    return totals.select(F.col("window.start").alias("start"), by, "n", "total")
