"""Bulk commit of entry files into the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.chunks import Embed, chunk_items
from quern.operators.upsert import replace_chunks, split_upsert
from quern.sources import changes


def commit_entries(
    entries: DataFrame, items: DataFrame, chunks: DataFrame, embed: Embed, now: Column
) -> tuple[DataFrame, DataFrame]:
    """The store after the entries arrived in ``seq`` order; an empty body still gets one chunk."""
    kept, changed = split_upsert(items, entries, now)
    fresh = embed(chunk_items(changed, keep_empty=True, with_kind="kind" in chunks.columns))
    return kept.unionByName(changed), replace_chunks(chunks, changed.select(F.col("id").alias("item_id")), fresh)


def commit_to_store(spark: SparkSession, path: str, entries: DataFrame, embed: Embed, now: Column) -> int:
    """The same as a change to a store of generations: only the entries' items and chunks are written."""
    items, chunks = changes.read(spark, path)
    _, changed = split_upsert(items, entries, now)
    fresh = embed(chunk_items(changed, keep_empty=True, with_kind="kind" in chunks.columns)).select(*chunks.columns)
    number = changes.change(spark, path, changed, fresh, changed.select(F.col("id").alias("item_id")))
    changes.settle(spark, path)
    return number
