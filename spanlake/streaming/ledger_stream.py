"""The append-only ledger as a stream sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlake.sources.ledger import latest_per_key


def append_ledger(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Append every micro-batch to the ledger. A replayed batch rewrites its own part, so records are kept once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_ledger(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The latest record per key of a ledger written by `append_ledger`."""
    return latest_per_key(spark.read.parquet(path).drop("batch"), keys, order)
