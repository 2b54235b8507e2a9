"""Numbering and ranking that never send an unbounded group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.session import durable

RUN_ROWS = 1024
SALTS = 64


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a scan with fewer splits than cores over all cores, before heavy work per row.

    For frames read straight from files; a table with enough splits is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def _offsets(counts: DataFrame, groups: Sequence[str], runs: Sequence[str]) -> DataFrame:
    """For each run of a group, the rows in the runs before it, in ``_before``."""
    before = W.partitionBy(*groups).orderBy(*runs).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def _index_within(df: DataFrame, keys: Sequence[str], within: Sequence[str], offsets: DataFrame, out: str) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*within)))
    return ranked.join(offsets, list(keys)).withColumn(out, F.col("_before") + F.col("_rank") - 1).drop("_before", "_rank")


def dense_index(df: DataFrame, groups: Sequence[str], runs: Sequence[str], within: Sequence[str], out: str) -> DataFrame:
    """0, 1, 2, … within each group, for groups of any size.

    ``runs`` are columns that grow with the wanted order and cut a group into bounded runs, such as
    the blocks of a file. Rows are ranked inside a run; a run's offset comes from the run counts,
    one small row per run.
    """
    keys = [*groups, *runs]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return _index_within(df, keys, within, _offsets(counts, groups, runs).drop("_n"), out)


def dense_index_by(df: DataFrame, groups: Sequence[str], position: str, out: str) -> DataFrame:
    """``dense_index`` by a column that is unique within its group, dense or sparse.

    Only groups and positions are sorted and numbered, over all groups at once; a group's numbers begin
    at its first one. So no window holds a group, whatever its positions look like, and the other
    columns move once, to meet their number.
    """
    places = number_rows(df.select(*groups, position), [*[F.col(g) for g in groups], F.col(position)], "_n")
    firsts = places.groupBy(*groups).agg(F.min("_n").alias("_first"))
    numbered = places.join(firsts, list(groups)).select(*groups, position, (F.col("_n") - F.col("_first")).alias(out))
    return df.join(numbered, [*groups, position])


def number_rows(df: DataFrame, order: Sequence[Column], out: str = "row_ix") -> DataFrame:
    """1, 2, 3, … over the whole result in a total order.

    Spark's range sort orders the rows; the sorted rows are kept in the shared folder once, so the
    partition that each row number is counted from cannot change between the two readings.
    """
    return number_returned(df.orderBy(*order), out)


def number_returned(df: DataFrame, out: str = "row_ix") -> DataFrame:
    """1, 2, 3, … in the order in which the frame returns its rows, a sorted one in its order."""
    placed = durable(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_at"), 33).alias("_part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return (
        placed.withColumn("_part", F.shiftright(F.col("_at"), 33))
        .join(offsets, "_part")
        .withColumn(out, F.col("_before") + local + 1)
        .drop("_at", "_part", "_before")
    )


def top_per_group(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread: Sequence[str],
    out: str = "rank",
) -> DataFrame:
    """The first ``n`` rows of each group in two rounds.

    Round one keeps the first ``n`` of each salted slice, so a group that holds most of the rows is
    spread over many tasks; round two ranks at most ``n`` times the number of slices.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    first = W.partitionBy(*groups, "_salt").orderBy(*order)
    sliced = salted.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n).drop("_r", "_salt")
    final = W.partitionBy(*groups).orderBy(*order)
    return sliced.withColumn(out, F.row_number().over(final)).filter(F.col(out) <= n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], latest: bool = False) -> DataFrame:
    """One row per key, the first (or latest) in a total order, by a combining aggregate.

    Partial results combine before the shuffle, so a key with a third of the rows costs no more.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if latest else F.min_by
    chosen = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
