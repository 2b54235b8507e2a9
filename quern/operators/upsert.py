"""Changes to the item and chunk store, as new tables made from the old ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.operators.sizes import is_small, sent_if_small
from quern.session import staged
from quern.sources.store import id_folder

ITEM_COLUMNS = ["id", "kind", "name", "body", "metadata", "version", "created_at", "updated_at"]
ID_BUCKETS = 4096


def assign_ids(rows: DataFrame, keys: Sequence[str], after: int) -> DataFrame:
    """Unique ids after ``after``, like a sequence: hash buckets of keys, numbered bucket by bucket."""
    bucketed = rows.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(ID_BUCKETS)))
    sizes = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    # At most ID_BUCKETS rows, whatever the input.
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = bucketed.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(*keys)))
    return (
        ranked.join(F.broadcast(offsets), "_b")
        .withColumn("id", F.lit(after) + F.col("_before") + F.col("_r"))
        .drop("_b", "_before", "_r")
    )


def split_upsert(current: DataFrame, incoming: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Items that no arrival touches, and items updated or inserted by (kind, name).

    Each arrival of an existing item raises its version by one; the last in ``seq`` order gives body
    and metadata. ``incoming`` has kind, name, body, metadata and seq. Arrivals of one item are
    combined before any join, so an item that arrives very often does not pile up.

    When few items arrive, only their keys travel and the store is not shuffled; otherwise both
    sides meet in one full outer join.
    """
    last = F.max_by(F.struct("body", "metadata"), F.col("seq")).alias("_new")
    arrived = incoming.groupBy("kind", "name").agg(last, F.count(F.lit(1)).cast("int").alias("_times"))
    keys = incoming.select("kind", "name").distinct()
    if is_small(keys):
        kept = current.join(F.broadcast(keys), ["kind", "name"], "left_anti")
        touched = current.join(F.broadcast(keys), ["kind", "name"], "left_semi")
        joined = touched.join(arrived, ["kind", "name"], "full_outer")
    else:
        everything = current.join(arrived, ["kind", "name"], "full_outer")
        kept = everything.filter(F.col("_times").isNull())
        joined = everything.filter(F.col("_times").isNotNull())
    known = F.col("id").isNotNull()
    changed = joined.select(
        "id",
        "kind",
        "name",
        F.col("_new.body").alias("body"),
        F.col("_new.metadata").alias("metadata"),
        (F.coalesce("version", F.lit(0)) + F.col("_times")).alias("version"),
        F.when(known, F.col("created_at")).otherwise(now).alias("created_at"),
        now.alias("updated_at"),
    )
    after = current.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = assign_ids(changed.filter(~known).drop("id"), ["kind", "name"], after)
    written = changed.filter(known).unionByName(fresh.select(*ITEM_COLUMNS))
    # Items, chunks and ids are all read from the changed rows.
    return kept.select(*ITEM_COLUMNS), staged(written, "changed-items")


def upsert_items(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """The store's items after the arrivals."""
    kept, changed = split_upsert(current, incoming, now)
    return kept.unionByName(changed)


def replace_chunks(chunks: DataFrame, changed_ids: DataFrame, fresh: DataFrame) -> DataFrame:
    """Drop all chunks of the changed items, then add the new ones."""
    if "id_folder" in chunks.columns:
        fresh = fresh.withColumn("id_folder", id_folder(F.col("item_id")))
    return without_items(chunks, changed_ids).unionByName(fresh.select(*chunks.columns))


def without_items(chunks: DataFrame, gone_ids: DataFrame) -> DataFrame:
    return chunks.join(sent_if_small(gone_ids.select("item_id").distinct()), "item_id", "left_anti").select(*chunks.columns)


def delete_items(items: DataFrame, chunks: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove items by (kind, name), and with them their chunks."""
    names = sent_if_small(doomed.select("kind", "name").distinct())
    gone = items.join(names, ["kind", "name"], "left_semi").select(F.col("id").alias("item_id"))
    return items.join(names, ["kind", "name"], "left_anti").select(*items.columns), without_items(chunks, gone)


def replace_kinds(
    items: DataFrame, chunks: DataFrame, kinds: Sequence[str], new_items: DataFrame, new_chunks: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Replace every item of the given kinds, and their chunks, by a new snapshot."""
    old = F.col("kind").isin(list(kinds))
    gone = items.filter(old).select(F.col("id").alias("item_id"))
    kept = items.filter(~old)
    return kept.unionByName(new_items.select(*items.columns)), replace_chunks(chunks, gone, new_chunks)
