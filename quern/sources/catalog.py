"""The column catalog of a set of tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schemas that hold no user tables.
SYSTEM_SCHEMAS = ["pg_catalog", "information_schema", "pg_toast", "rag"]

CATALOG = "table_schema string, table_name string, ordinal int, column_name string, data_type string"


def session_tables(spark: SparkSession) -> dict[tuple[str, str], DataFrame]:
    """Base tables of the session's databases, without views and system schemas."""
    found = {}
    for database in spark.catalog.listDatabases():
        if database.name in SYSTEM_SCHEMAS:
            continue
        for table in spark.catalog.listTables(database.name):
            if table.tableType in ("MANAGED", "EXTERNAL"):
                found[(database.name, table.name)] = spark.table(f"`{database.name}`.`{table.name}`")
    return found


def catalog_columns(spark: SparkSession, tables: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """One row per column, from the tables' schemas alone; ``ordinal`` counts from 1."""
    rows = [
        (schema, table, ordinal, field.name, field.dataType.simpleString())
        for (schema, table), df in tables.items()
        if schema not in SYSTEM_SCHEMAS
        for ordinal, field in enumerate(df.schema.fields, 1)
    ]
    if not rows:
        raise ValueError("no columns found")
    return spark.createDataFrame(rows, CATALOG)


def column_nulls(tables: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """Whether each column holds a null: what a constraint would state, read from the data.

    Only rows with a null are asked for, so file statistics let Spark skip row groups without any.
    Nested columns have no such statistics and are read apart.
    """

    def of_columns(schema: str, table: str, df: DataFrame, columns: list[str]) -> DataFrame:
        some_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
        held = df.filter(some_null).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("n")) for c in columns]))
        return held.select(pairs.alias("x")).select(
            F.lit(schema).alias("table_schema"),
            F.lit(table).alias("table_name"),
            F.col("x.c").alias("column_name"),
            (F.col("x.n") > 0).alias("has_nulls"),
        )

    frames = []
    for (schema, table), df in tables.items():
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        plain = [c for c in df.columns if c not in nested]
        frames += [of_columns(schema, table, df, part) for part in (plain, nested) if part]
    return reduce(DataFrame.unionByName, frames)
