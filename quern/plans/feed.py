"""Record feeds: every record to a typed table and, as JSON with its ingest time, to a raw table.

The tables are folders of batches that are only added to. A batch that runs again replaces its own
folder, and the newest record of a key is found when reading, so no stored data is rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.ordering import first_per_key

BATCH = "batch_id"
#: Compacted rows stand before every batch, in a folder that no batch writes to.
BASE_BATCH = -1
CHECKPOINT = "checkpoint"


def raw_form(records: DataFrame, keys: Sequence[str], seq: Sequence[str], ingested: Column) -> DataFrame:
    """Keys, order columns, the whole record as JSON, and the ingest time."""
    kept = list(dict.fromkeys([*keys, *seq]))
    return records.select(*kept, F.to_json(F.struct(*records.columns)).alias("payload"), ingested.alias("ingested_at"))


def ingest_batch(
    records: DataFrame,
    batch: int,
    typed: Callable[[DataFrame], DataFrame],
    path: str,
    keys: Sequence[str],
    seq: Sequence[str],
    ingested: Column,
) -> None:
    """Write one batch to both tables; the records are read once for each."""
    typed(records).write.mode("overwrite").parquet(f"{path}/typed/{BATCH}={batch}")
    raw_form(records, keys, seq, ingested).write.mode("overwrite").parquet(f"{path}/raw/{BATCH}={batch}")


def newest(records: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """One row per key, the last by the order columns."""
    return first_per_key(records, keys, [F.col(c) for c in seq], latest=True)


def read_feed(spark: SparkSession, path: str, table: str, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """The present rows of the ``typed`` or ``raw`` table: the last arrival of each key."""
    stored = spark.read.parquet(f"{path}/{table}")
    return newest(stored, keys, [BATCH, *seq]).drop(BATCH)


def compact_feed(spark: SparkSession, path: str, target: str, keys: Sequence[str], seq: Sequence[str]) -> None:
    """Both tables' present rows at a new path, before any batch that is still to come there.

    A stream's checkpoint is taken along, so that a feed that goes on at the new path neither takes a
    file twice nor gives a batch a number that was used.
    """
    for table in ("typed", "raw"):
        read_feed(spark, path, table, keys, seq).write.parquet(f"{target}/{table}/{BATCH}={BASE_BATCH}")
    _copy_folder(spark, f"{path}/{CHECKPOINT}", f"{target}/{CHECKPOINT}")


def _copy_folder(spark: SparkSession, source: str, target: str) -> None:
    """A folder with all it holds, through the file system that Spark uses for the path; none is no fault."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    old, new = hadoop.Path(source), hadoop.Path(target)
    if old.getFileSystem(conf).exists(old):
        hadoop.FileUtil.copy(old.getFileSystem(conf), old, new.getFileSystem(conf), new, False, conf)


def batch_totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/typed").groupBy(BATCH).agg(F.count(F.lit(1)).alias("n"))
