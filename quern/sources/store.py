"""The stored items and chunks: snapshots in Parquet, items cut by kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import row_index


ID_FOLDERS = 1024


def save_items(items: DataFrame, path: str) -> None:
    """A new snapshot at a new path; a path that may be read is never overwritten."""
    items.write.mode("errorifexists").partitionBy("kind").parquet(path)


def id_folder(item_id: Column) -> Column:
    return F.pmod(item_id, F.lit(ID_FOLDERS)).cast("int")


def save_chunks(chunks: DataFrame, path: str, by_id: bool = False) -> None:
    """Chunks sorted by item, cut by their item's kind when they carry it.

    A search by kind then reads only those files. With ``by_id``, for large stores, folders by id as
    well: the texts of a search's final rows are read from those rows' folders alone. The range
    cut splits an item with very many chunks over several tasks.
    """
    by_id = by_id or "id_folder" in chunks.columns
    rows = chunks.withColumn("id_folder", id_folder(F.col("item_id"))) if by_id else chunks
    folders = [c for c in ("kind", "id_folder") if c in rows.columns]
    order = [*folders, "item_id", "chunk_ix"]
    placed = rows.repartitionByRange(*order) if by_id else rows
    placed.sortWithinPartitions(*order).write.mode("errorifexists").partitionBy(*folders).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def items_of(items: DataFrame, kinds: Sequence[str], dataset: str) -> DataFrame:
    """Items of the kinds whose row name belongs to exactly this dataset, with their position."""
    kept = items.filter(F.col("kind").isin(list(kinds))).filter(F.col("name").contains(f"::{dataset}::row::"))
    return kept.withColumn("row_ix", row_index(F.col("name"), F.lit(dataset))).filter(F.col("row_ix").isNotNull())


def kind_filter(kinds: Sequence[str]) -> Column:
    return F.col("kind").isin([k.strip() for k in kinds if k.strip()])


def dataset_filter(dataset: str, own_column: bool = False) -> Column:
    """The dataset must match, but only for items of kind ``info``."""
    held = F.col("dataset") if own_column else F.element_at("metadata", F.lit("dataset"))
    return (F.col("kind") != "info") | (held == dataset)
