"""Audit of the store: listings, gaps, stitched texts, totals and the nested snapshot.

Chunks are grouped by item only where the result holds an item's whole text, which was one row
before it was cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import utc_stamp
from quern.sinks.files import write_audit_csv, write_json


def chunk_listing(chunks: DataFrame) -> DataFrame:
    return chunks.select("item_id", "chunk_ix", "chunk_text", F.length("chunk_text").alias("chars"), *_times(chunks))


def _times(chunks: DataFrame) -> list[str]:
    """The times that chunks carry, where their store keeps them."""
    return [c for c in ("created_at", "updated_at") if c in chunks.columns]


def missing_items(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items that no search can find, as they have no chunk."""
    held = chunks.select(F.col("item_id").alias("id")).distinct()
    return items.select("id", "kind", "name").join(held, "id", "left_anti")


def missing_head(items: DataFrame, chunks: DataFrame, n: int = 10) -> DataFrame:
    """The first missing items by kind and name."""
    return missing_items(items, chunks).orderBy("kind", "name").limit(n)


def nested_chunks(chunks: DataFrame) -> DataFrame:
    """(id, chunks, full_text, chunk_count): chunks in order, and their texts end to end."""
    entry = F.struct("chunk_ix", "chunk_text", F.length("chunk_text").alias("chars"), *_times(chunks))
    grouped = chunks.groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("chunks"))
    return grouped.select(
        "id",
        "chunks",
        F.array_join(F.transform("chunks", lambda x: x["chunk_text"]), "").alias("full_text"),
        F.size("chunks").alias("chunk_count"),
    )


def stitched_segments(chunks: DataFrame, segment_chunks: int = 1024) -> DataFrame:
    """(item_id, segment, text, chunk_count): texts end to end in segments of bounded length.

    For sequences that were never one row, so that an item with very many chunks stays in many groups.
    """
    segment = F.floor(F.col("chunk_ix") / segment_chunks).cast("long").alias("segment")
    entries = F.array_sort(F.collect_list(F.struct("chunk_ix", "chunk_text"))).alias("_c")
    grouped = chunks.groupBy("item_id", segment).agg(entries)
    text = F.array_join(F.transform("_c", lambda x: x["chunk_text"]), "")
    return grouped.select("item_id", "segment", text.alias("text"), F.size("_c").alias("chunk_count"))


def full_texts(items: DataFrame, chunks: DataFrame) -> DataFrame:
    stitched = nested_chunks(chunks).select("id", "full_text", "chunk_count")
    return (
        items.select("id", "kind", "name")
        .join(stitched, "id", "left")
        .fillna("", ["full_text"])
        .fillna(0, ["chunk_count"])
    )


def snapshot(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per item with its fields, chunks, stitched text and chunk count."""
    joined = items.join(nested_chunks(chunks), "id", "left")
    none = F.array().cast(joined.schema["chunks"].dataType)
    return joined.select(
        "id",
        "kind",
        "name",
        "version",
        "created_at",
        "updated_at",
        "metadata",
        F.col("body").alias("item_body"),
        F.coalesce("chunks", none).alias("chunks"),
        F.coalesce("full_text", F.lit("")).alias("full_text"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
    )


def items_by_kind(items: DataFrame) -> DataFrame:
    return items.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def totals(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: items, chunks, and items without chunks."""
    parts = (
        items.select(F.lit("items").alias("what"))
        .unionByName(chunks.select(F.lit("chunks").alias("what")))
        .unionByName(missing_items(items, chunks).select(F.lit("missing").alias("what")))
    )
    return parts.agg(
        F.count_if(F.col("what") == "items").alias("items"),
        F.count_if(F.col("what") == "chunks").alias("chunks"),
        F.count_if(F.col("what") == "missing").alias("missing_items"),
    )


def previews(items: DataFrame, chunks: DataFrame, n: int = 5, chars: int = 200) -> DataFrame:
    """The first items by kind and name, with the beginning of their text."""
    head = items.select("id", "kind", "name", "body").orderBy("kind", "name").limit(n)
    # At most n rows, hence the broadcast; only their chunks are stitched.
    theirs = chunks.join(F.broadcast(head.select(F.col("id").alias("item_id"))), "item_id", "left_semi")
    joined = head.join(nested_chunks(theirs).select("id", "full_text", "chunk_count"), "id", "left")
    stitched = F.when(F.col("full_text") != "", F.col("full_text"))
    text = F.coalesce(stitched, F.col("body"), F.lit(""))
    shown = F.replace(F.substring(text, 1, chars), F.lit("\n"), F.lit(" "))
    return joined.select("kind", "name", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), shown.alias("preview"))


def embedding_width(chunks: DataFrame) -> DataFrame:
    """One row: element type, least and greatest vector width, and vectors that are missing."""
    element = chunks.schema["embedding"].dataType.elementType.simpleString()
    return chunks.agg(
        F.lit(element).alias("element_type"),
        F.min(F.size("embedding")).alias("min_width"),
        F.max(F.size("embedding")).alias("max_width"),
        F.count_if(F.col("embedding").isNull()).alias("missing"),
    )


def write_audit(items: DataFrame, chunks: DataFrame, outdir: str, now: Column) -> str:
    """Items and chunks as CSV, the nested snapshot and the missing items as JSON, and the totals.

    Every audit has a folder of its own in ``outdir``, named by its UTC time; the folder is returned.
    """
    stamp = items.sparkSession.range(1).select(utc_stamp(now)).first()[0]
    path = f"{outdir}/audit-{stamp}"
    write_audit_csv(items, f"{path}/items", ["kind", "name"])
    write_audit_csv(chunk_listing(chunks), f"{path}/chunks", ["item_id", "chunk_ix"])
    write_json(snapshot(items, chunks), f"{path}/snapshot", ["kind", "name"])
    write_json(missing_items(items, chunks), f"{path}/missing", ["kind", "name"])
    write_json(totals(items, chunks).withColumn("generated_at_utc", F.lit(stamp)), f"{path}/totals")
    if "embedding" in chunks.columns:
        write_json(embedding_width(chunks), f"{path}/embedding")
    return path
