"""Grounding items made from table schemas and verified keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.chunks import Embed, chunk_items
from quern.operators.keys import check_foreign_keys, check_primary_keys
from quern.operators.upsert import ITEM_COLUMNS, assign_ids, replace_kinds
from quern.session import durable, staged
from quern.sources import changes
from quern.sources.catalog import SYSTEM_SCHEMAS, catalog_columns

SCHEMA_KINDS = ["table", "column", "key"]
PRIMARY, FOREIGN = "PRIMARY KEY", "FOREIGN KEY"


@dataclass(frozen=True)
class Key:
    """A declared key; a foreign key names its parent table and that table's columns."""

    schema: str
    table: str
    columns: tuple[str, ...]
    parent: tuple[str, str] | None = None
    parent_columns: tuple[str, ...] = ()

    @property
    def type(self) -> str:
        return FOREIGN if self.parent else PRIMARY


def _metadata(**columns: Column) -> Column:
    return F.create_map(*[part for name, value in columns.items() for part in (F.lit(name), value)])


def table_items(columns: DataFrame) -> DataFrame:
    """One item per table; its lines are as many as the table has columns."""
    qualified = F.concat_ws(".", "table_schema", "table_name")
    line = F.concat(F.lit("- "), F.col("column_name"), F.lit(" ("), F.col("data_type"), F.lit(")"))
    grouped = columns.groupBy("table_schema", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("_lines")
    )
    lines = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    return grouped.select(
        F.lit("table").alias("kind"),
        qualified.alias("name"),
        F.concat(F.lit("Table "), qualified, F.lit(" has columns:\n"), lines).alias("body"),
        _metadata(schema=F.col("table_schema"), table=F.col("table_name")).alias("metadata"),
    )


def column_items(columns: DataFrame) -> DataFrame:
    name = F.concat_ws(".", "table_schema", "table_name", "column_name")
    return columns.select(
        F.lit("column").alias("kind"),
        name.alias("name"),
        F.concat(F.lit("Column "), name, F.lit(" has type "), F.col("data_type"), F.lit(".")).alias("body"),
        _metadata(
            schema=F.col("table_schema"), table=F.col("table_name"), column=F.col("column_name"), type=F.col("data_type")
        ).alias("metadata"),
    )


def key_items(keys: DataFrame) -> DataFrame:
    """Items of (table_schema, table_name, column_name, constraint_type)."""
    table = F.concat_ws(".", "table_schema", "table_name")
    return keys.select(
        F.lit("key").alias("kind"),
        F.concat_ws(".", "table_schema", "table_name", "constraint_type", "column_name").alias("name"),
        F.concat(F.col("constraint_type"), F.lit(" on "), table, F.lit(" column "), F.col("column_name"), F.lit(".")).alias("body"),
        _metadata(
            schema=F.col("table_schema"),
            table=F.col("table_name"),
            column=F.col("column_name"),
            type=F.col("constraint_type"),
        ).alias("metadata"),
    )


def verified_keys(tables: Mapping[tuple[str, str], DataFrame], declared: Sequence[Key]) -> DataFrame:
    """Columns of the declared keys that hold on the data; files carry no enforced constraints."""
    checked = [key for key in declared if key.schema not in SYSTEM_SCHEMAS]
    primary, foreign, columns = {}, {}, []
    for key in checked:
        df = tables[(key.schema, key.table)]
        name = f"{key.schema}.{key.table}.{key.type}.{','.join(key.columns)}"
        if key.parent:
            foreign[name] = (df, key.columns, tables[key.parent], key.parent_columns)
        else:
            primary[name] = (df, key.columns)
        columns += [(name, key.schema, key.table, c, key.type) for c in key.columns]
    schema = "key string, table_schema string, table_name string, column_name string, constraint_type string"
    named = next(iter(tables.values())).sparkSession.createDataFrame(columns, schema)
    checks = ((check_primary_keys, primary), (check_foreign_keys, foreign))
    verdicts = [check(keys).select("key", "valid") for check, keys in checks if keys]
    if not verdicts:
        return named.drop("key")
    held = reduce(DataFrame.unionByName, verdicts).filter("valid")
    return named.join(held, "key", "left_semi").drop("key")


def schema_items(
    spark: SparkSession, tables: Mapping[tuple[str, str], DataFrame], declared: Sequence[Key] = ()
) -> DataFrame:
    """(kind, name, body, metadata) of all tables, columns and verified keys."""
    columns = catalog_columns(spark, tables)
    items = table_items(columns).unionByName(column_items(columns))
    return items.unionByName(key_items(verified_keys(tables, declared))) if declared else items


def schema_ddl(columns: DataFrame) -> DataFrame:
    """One line ``table(column type)`` per column, joined per table in column order."""
    line = F.concat("table_name", F.lit("("), "column_name", F.lit(" "), "data_type", F.lit(")"))
    grouped = columns.groupBy("table_schema", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("_lines")
    )
    return grouped.select(
        "table_schema", "table_name", F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("ddl")
    )


# Fixed value: the first line of the schema text.
DDL_HEAD = "-- Tables and columns (sample snapshot)\n"


def ddl_snapshot(columns: DataFrame) -> DataFrame:
    """One row with the schema text of all tables, as large as their metadata."""
    tables = F.array_sort(F.collect_list(F.struct("table_schema", "table_name", "ddl")))
    listed = schema_ddl(columns).agg(tables.alias("_tables"))
    lines = F.array_join(F.transform("_tables", lambda x: x["ddl"]), "\n")
    return listed.select(F.concat(F.lit(DDL_HEAD), lines).alias("schema_text"))


def refresh_schema(
    spark: SparkSession,
    tables: Mapping[tuple[str, str], DataFrame],
    declared: Sequence[Key],
    items: DataFrame,
    chunks: DataFrame,
    embed: Embed,
    now: Column,
) -> tuple[DataFrame, DataFrame]:
    """The store with its schema kinds replaced by the tables' present state."""
    after = items.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    # The key checks run once; the result has one row per table, column and key.
    found = durable(schema_items(spark, tables, declared))
    fresh = assign_ids(found, ["kind", "name"], after).select(
        "*", F.lit(1).alias("version"), now.alias("created_at"), now.alias("updated_at")
    ).select(*ITEM_COLUMNS)
    cut = chunk_items(fresh, keep_empty=True, with_kind="kind" in chunks.columns)
    return replace_kinds(items, chunks, SCHEMA_KINDS, fresh, embed(cut))


def refresh_in_store(
    spark: SparkSession,
    path: str,
    tables: Mapping[tuple[str, str], DataFrame],
    declared: Sequence[Key],
    embed: Embed,
    now: Column,
) -> int:
    """The same as a change to a store of generations: items that stay as they are keep their ids and are not written."""
    items, chunks = changes.read(spark, path)
    metadata = F.to_json(F.sort_array(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>")))))
    same = ["kind", "name", "_digest"]
    mark = F.sha2(F.concat_ws("\n", F.sha2("body", 256), metadata), 256)
    found = durable(schema_items(spark, tables, declared).withColumn("_digest", mark))
    held = durable(items.filter(F.col("kind").isin(SCHEMA_KINDS)).select("id", "kind", "name", mark.alias("_digest")))
    after = items.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = assign_ids(found.join(held, same, "left_anti").drop("_digest"), ["kind", "name"], after).select(
        "*", F.lit(1).alias("version"), now.alias("created_at"), now.alias("updated_at")
    )
    fresh = staged(fresh.select(*ITEM_COLUMNS), "schema-items")
    gone = held.join(found, same, "left_anti").select(F.col("id").alias("item_id"))
    cut = embed(chunk_items(fresh, keep_empty=True, with_kind="kind" in chunks.columns)).select(*chunks.columns)
    number = changes.change(spark, path, fresh, cut, gone)
    changes.settle(spark, path)
    return number
