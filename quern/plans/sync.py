"""Keeping the store in step with CSV files: plan, counts, apply, export."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import CHUNK_CHARS, normalize, row_name, utc_time
from quern.operators.chunks import Embed, chunk_items
from quern.operators.ordering import RUN_ROWS
from quern.operators.sizes import sent_if_small
from quern.operators.upsert import delete_items, replace_chunks, split_upsert
from quern.session import durable, staged
from quern.sinks.files import write_item_files, write_json
from quern.sources import changes
from quern.sources.csv_items import read_item_files
from quern.sources.store import items_of

CREATE, UPDATE, DELETE, KEEP = "CREATE", "UPDATE", "DELETE", "KEEP"


def desired_rows(rows: DataFrame) -> DataFrame:
    """(kind, row_ix, body) with normalised bodies; a body that becomes empty is not desired."""
    return rows.select("kind", "row_ix", normalize(F.col("body")).alias("body")).filter(F.col("body") != "")


def current_rows(items: DataFrame) -> DataFrame:
    """The store's rows in the same shape; ``items`` carry the position parsed from their name."""
    return items.select("kind", "row_ix", normalize(F.coalesce("body", F.lit(""))).alias("body"))


def plan_sync(desired: DataFrame, current: DataFrame) -> DataFrame:
    """(kind, row_ix, action) for every position held by either side.

    Bodies are compared by digest, so no text is shuffled; (kind, row_ix) is unique on both sides.
    """

    def digest(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("kind", "row_ix", F.sha2("body", 256).alias(name))

    joined = digest(desired, "_want").join(digest(current, "_have"), ["kind", "row_ix"], "full_outer")
    want, have = F.col("_want"), F.col("_have")
    action = (
        F.when(want.isNull(), F.lit(DELETE))
        .when(have.isNull(), F.lit(CREATE))
        .when(want != have, F.lit(UPDATE))
        .otherwise(F.lit(KEEP))
    )
    return joined.select("kind", "row_ix", action.alias("action"))


def sync_counts(plan: DataFrame) -> DataFrame:
    """Counts per kind, and over all kinds in the row whose kind is null."""
    action = F.col("action")
    return plan.rollup("kind").agg(
        F.count_if(action != DELETE).alias("desired"),
        F.count_if(action != CREATE).alias("current"),
        F.count_if(action == CREATE).alias("creates"),
        F.count_if(action == UPDATE).alias("updates"),
        F.count_if(action == DELETE).alias("deletes"),
    )


def sync_record(plan: DataFrame, dataset: str, stamp: Column, model: str, applied: bool) -> DataFrame:
    """The audit record's rows: run settings with the counts of one kind, or of all kinds."""
    return sync_counts(plan).select(
        F.lit(dataset).alias("dataset"),
        stamp.alias("ts_utc"),
        F.lit(model).alias("embedding_model"),
        F.lit(applied).alias("apply"),
        "*",
    )


def sync_actions(
    plan: DataFrame, desired: DataFrame, dataset: str, applied: bool, size: int = CHUNK_CHARS, current: DataFrame | None = None
) -> DataFrame:
    """(kind, row_ix, name, action, chunks) for every position that changes, as the audit lists them.

    With ``current``, the rows that the store held before, applied deletes have the number of items that went in ``rows``.
    """
    suffix = "_APPLIED" if applied else ""
    changes = plan.filter(F.col("action") != KEEP)
    lengths = desired.select("kind", "row_ix", F.length("body").alias("_length"))
    listed = changes.join(lengths, ["kind", "row_ix"], "left")
    upserted = F.col("action") != DELETE
    more = []
    if current is not None:
        held = current.groupBy("kind", "row_ix").agg(F.count(F.lit(1)).alias("_held"))
        listed = listed.join(held, ["kind", "row_ix"], "left")
        more = [F.when(~upserted & F.lit(applied), F.coalesce("_held", F.lit(0))).alias("rows")]
    return listed.select(
        "kind",
        "row_ix",
        row_name(F.col("kind"), F.lit(dataset), F.col("row_ix")).alias("name"),
        F.when(upserted, F.lit(f"UPSERT{suffix}")).otherwise(F.lit(f"DELETE{suffix}")).alias("action"),
        F.when(upserted, F.ceil(F.col("_length") / size).cast("int")).alias("chunks"),
        *more,
    )


def write_sync_audit(record: DataFrame, actions: DataFrame, path: str) -> None:
    """The record's rows and the list of actions, as JSON."""
    write_json(record, f"{path}/record", ["kind"])
    write_json(actions, f"{path}/actions", ["kind", "action", "row_ix"])


def _arrivals(plan: DataFrame, desired: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """Created and updated rows as arriving items, and (kind, name) of the deleted ones."""
    lit_dataset = F.lit(dataset)
    touched = sent_if_small(plan.filter(F.col("action").isin(CREATE, UPDATE)).select("kind", "row_ix"))
    incoming = desired.join(touched, ["kind", "row_ix"], "left_semi").select(
        "kind",
        row_name(F.col("kind"), lit_dataset, F.col("row_ix")).alias("name"),
        "body",
        F.create_map(
            F.lit("dataset"), lit_dataset, F.lit("identity"), F.lit("position"), F.lit("row"), F.col("row_ix").cast("string")
        ).alias("metadata"),
        F.lit(0).alias("seq"),
    )
    doomed = plan.filter(F.col("action") == DELETE).select(
        "kind", row_name(F.col("kind"), lit_dataset, F.col("row_ix")).alias("name")
    )
    return incoming, doomed


def apply_sync(
    plan: DataFrame, desired: DataFrame, items: DataFrame, chunks: DataFrame, dataset: str, embed: Embed, now: Column
) -> tuple[DataFrame, DataFrame]:
    """The new items and chunks. Only created and updated rows are chunked and embedded."""
    incoming, doomed = _arrivals(plan, desired, dataset)
    left_items, left_chunks = delete_items(items, chunks, doomed)
    kept, changed = split_upsert(left_items, incoming, now)
    fresh = embed(chunk_items(changed, with_kind="kind" in chunks.columns))
    ids = changed.select(F.col("id").alias("item_id"))
    return kept.unionByName(changed), replace_chunks(left_chunks, ids, fresh)


def change_store(
    spark: SparkSession, path: str, plan: DataFrame, desired: DataFrame, dataset: str, embed: Embed, now: Column
) -> int:
    """Apply a plan to a store of generations: only changed rows are written. Returns the new generation."""
    items, chunks = changes.read(spark, path)
    incoming, doomed = _arrivals(plan, desired, dataset)
    _, changed = split_upsert(items, incoming, now)
    fresh = embed(chunk_items(changed, with_kind="kind" in chunks.columns)).select(*chunks.columns)
    removed = items.join(sent_if_small(doomed.distinct()), ["kind", "name"], "left_semi").select(F.col("id").alias("item_id"))
    number = changes.change(spark, path, changed, fresh, changed.select(F.col("id").alias("item_id")).union(removed))
    changes.settle(spark, path)
    return number


def export_rows(current: DataFrame) -> DataFrame:
    """(kind, row_ix, body) for every position from 0 to a kind's highest; gaps hold empty text.

    Positions are made in bounded runs, so a kind of any size is spread over many tasks.
    """
    highest = current.groupBy("kind").agg(F.max("row_ix").alias("_max"))
    runs = highest.select(
        "kind", "_max", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_max") / RUN_ROWS))).alias("_run")
    ).repartition("kind", "_run")
    last = F.least(F.col("_max"), (F.col("_run") + 1) * RUN_ROWS - 1)
    positions = runs.select("kind", F.explode(F.sequence(F.col("_run") * RUN_ROWS, last)).alias("row_ix"))
    return positions.join(current, ["kind", "row_ix"], "left").select(
        "kind", "row_ix", F.coalesce("body", F.lit("")).alias("body")
    )


def run_sync(
    spark: SparkSession,
    paths: Mapping[str, str],
    items: DataFrame,
    chunks: DataFrame,
    dataset: str,
    embed: Embed,
    now: Column,
    *,
    has_header: bool = False,
    dedupe: bool = False,
    apply: bool = False,
    export_path: str | None = None,
    audit_path: str | None = None,
    model: str = "",
    multiline: bool = True,
    store: str | None = None,
) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """The whole job over one file or folder per kind: the plan, and the new store when applied.

    A dry run reads and compares only; nothing is embedded. With ``store``, the path of a store of
    generations that ``items`` and ``chunks`` were read from, the changes are added there and it is read again.
    """
    desired = staged(desired_rows(read_item_files(spark, paths, has_header, dedupe, multiline)), "desired-rows")
    current = current_rows(items_of(items, list(paths), dataset))
    if export_path:
        write_item_files(export_rows(current), export_path)
    plan = durable(plan_sync(desired, current))
    if audit_path:
        record = sync_record(plan, dataset, utc_time(now), model, apply)
        write_sync_audit(record, sync_actions(plan, desired, dataset, apply, current=current), audit_path)
    if not apply:
        return plan, None
    if store is not None:
        change_store(spark, store, plan, desired, dataset, embed, now)
        return plan, changes.read(spark, store)
    return plan, apply_sync(plan, desired, items, chunks, dataset, embed, now)
