"""Run a stream over what is there now and return its result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.session import stage_root


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """Process all available input and return the emitted rows with their ``batch_id``.

    Batches and the checkpoint go to the shared folder, so nothing passes through the driver. A
    batch is written to its own folder and replaced when it is repeated after a failure.
    """
    spark = stream.sparkSession
    base = f"{stage_root(spark)}/treeloom/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = stream.schema.add("batch_id", "long")
    return spark.read.schema(schema).option("basePath", f"{base}/out").parquet(f"{base}/out")


def latest_per_key(emitted: DataFrame, key: str, value: str) -> DataFrame:
    """Last value per key of an update-mode stream."""
    return emitted.groupBy(key).agg(F.max_by(value, "batch_id").alias(value))


def latest_rows(emitted: DataFrame, keys: list[str]) -> DataFrame:
    """The last row per key of an update-mode stream: what it knows when the input ends."""
    columns = [c for c in emitted.columns if c not in (*keys, "batch_id")]
    return emitted.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch_id").alias("row")).select(*keys, "row.*")
