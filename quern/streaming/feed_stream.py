"""Recurring feed ingest: new files of a landing folder, as a stream that stops when none is left."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from quern.plans.feed import CHECKPOINT, ingest_batch
from quern.plans.newest import add_batch, settle


def run_feed(
    spark: SparkSession,
    landing: str,
    schema,
    path: str,
    typed: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    seq: Sequence[str],
    ingested: Column,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
    keep_newest: bool = False,
) -> None:
    """Ingest every file that has arrived since the last run.

    The checkpoint beside the tables remembers the files taken; a batch that is replayed after a
    failure replaces its own folder. With ``keep_newest`` the newest typed record of every key is kept as well.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, typed, path, keys, seq, ingested)
        if keep_newest:
            add_batch(typed(batch), batch_id, path, keys, seq)
            settle(batch.sparkSession, path, keys, seq)

    query = (
        reader.load(landing)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/{CHECKPOINT}")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
