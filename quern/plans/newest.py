"""The newest record of every key, kept as a table beside a feed.

Every batch adds the newest records of its own keys as a generation, and generations of about one size are
merged. So a reader meets a few generations, whose rows are about those of the result, where the tables of
the feed hold every record ever taken. A later batch wins, and within a batch the order columns decide.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.feed import BATCH, newest
from quern.sources.changes import FANOUT, GEN, Span, due, folder_spans, sizes_of

KEPT = "newest"


def _folder(path: str, span: Span) -> str:
    return f"{path}/{KEPT}/{GEN}={span[0]}" + (f"-{span[1]}" if span[1] > span[0] else "")


def _read(spark: SparkSession, path: str, held: Sequence[Span], keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(_folder(path, s)) for s in held])
    return rows if len(held) == 1 else newest(rows, keys, [BATCH, *seq])


def add_batch(records: DataFrame, batch: int, path: str, keys: Sequence[str], seq: Sequence[str]) -> None:
    """Keep a batch's newest records; a batch that runs again replaces its own generation, or finds it merged."""
    kept = newest(records, keys, seq).withColumn(BATCH, F.lit(batch).cast("long"))
    kept.write.mode("overwrite").parquet(_folder(path, (batch, batch)))


def settle(spark: SparkSession, path: str, keys: Sequence[str], seq: Sequence[str]) -> int:
    """Merge the latest generations as long as they are of about one size; the number that are left.

    Merged generations stay for readers that have them open.
    """
    while True:
        held = folder_spans(spark, f"{path}/{KEPT}")
        if not due(sizes_of(spark, [[_folder(path, s)] for s in held])):
            return len(held)
        last = held[-FANOUT:]
        _read(spark, path, last, keys, seq).write.mode("overwrite").parquet(_folder(path, (last[0][0], last[-1][1])))


def read_newest(spark: SparkSession, path: str, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """The newest record of every key over all batches."""
    return _read(spark, path, folder_spans(spark, f"{path}/{KEPT}"), keys, seq).drop(BATCH)
