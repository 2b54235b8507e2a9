"""Declared keys, checked on the data.

Rows are counted per key before any join and before the verdicts, so a hot key is a single row there.
All verdicts of a call come from one final aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _per_key(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    null_part = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return df.withColumn("_null", null_part).groupBy(*columns, "_null").agg(F.count(F.lit(1)).alias("_n"))


def _total(condition=None):
    counted = F.col("_n") if condition is None else F.when(condition, F.col("_n"))
    return F.coalesce(F.sum(counted), F.lit(0))


def check_primary_keys(keys: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Per name: rows, rows with a null key part, keys held by more than one row, and the verdict."""
    spark = next(iter(keys.values()))[0].sparkSession
    # A row of zero for each name, so that an empty table has a verdict.
    counts = spark.createDataFrame([(name, False, 0) for name in keys], "key string, _null boolean, _n long")
    for name, (df, columns) in keys.items():
        counts = counts.unionByName(_per_key(df, columns).select(F.lit(name).alias("key"), "_null", "_n"))
    return (
        counts.groupBy("key")
        .agg(
            _total().alias("n_rows"),
            _total(F.col("_null")).alias("null_keys"),
            F.count_if(~F.col("_null") & (F.col("_n") > 1)).alias("repeated_keys"),
        )
        .withColumn("valid", (F.col("null_keys") == 0) & (F.col("repeated_keys") == 0))
    )


def check_foreign_keys(keys: Mapping[str, tuple[DataFrame, Sequence[str], DataFrame, Sequence[str]]]) -> DataFrame:
    """Per name: rows with a full reference, rows and keys whose reference has no parent, and the verdict."""
    spark = next(iter(keys.values()))[0].sparkSession
    counts = spark.createDataFrame([(name, 0, True) for name in keys], "key string, _n long, _held boolean")
    for name, (df, columns, parent, parent_columns) in keys.items():
        refs = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        held = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_columns, columns)]).distinct()
        matched = refs.join(held.withColumn("_held", F.lit(True)), list(columns), "left")
        counts = counts.unionByName(matched.select(F.lit(name).alias("key"), "_n", "_held"))
    orphan = F.col("_held").isNull()
    return (
        counts.groupBy("key")
        .agg(_total().alias("n_refs"), _total(orphan).alias("orphan_rows"), F.count_if(orphan).alias("orphan_keys"))
        .withColumn("valid", F.col("orphan_rows") == 0)
    )


def check_primary_key(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return check_primary_keys({"": (df, columns)}).drop("key")


def check_foreign_key(
    df: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]
) -> DataFrame:
    return check_foreign_keys({"": (df, columns, parent, parent_columns)}).drop("key")
