"""Catalog, key checks, schema items and column examples over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.chunks import chunk_items, embed_hashed
from quern.operators.keys import check_foreign_keys, check_primary_keys
from quern.operators.ordering import spread_out
from quern.plans.examples import column_examples
from quern.plans.schema_grounding import FOREIGN, PRIMARY, Key, refresh_schema, schema_items
from quern.sources.catalog import catalog_columns, column_nulls
from quern.workload import tables as t
from quern.workload.registry import query

DECLARED = [
    Key("main", "region", ("r_regionkey",)),
    Key("main", "nation", ("n_nationkey",)),
    Key("main", "customer", ("c_custkey",)),
    Key("main", "supplier", ("s_suppkey",)),
    Key("main", "part", ("p_partkey",)),
    Key("main", "orders", ("o_orderkey",)),
    Key("main", "lineitem", ("l_orderkey", "l_linenumber")),
    Key("main", "events", ("event_id",)),
    Key("main", "documents", ("doc_id",)),
    Key("main", "embeddings", ("vec_id",)),
    Key("main", "pages", ("url",)),
    Key("main", "benchmark", ("item_id",)),
    Key("main", "labels", ("doc_id",)),
    Key("main", "conversations", ("conv_id", "turn")),
    Key("main", "nation", ("n_regionkey",), ("main", "region"), ("r_regionkey",)),
    Key("main", "customer", ("c_nationkey",), ("main", "nation"), ("n_nationkey",)),
    Key("main", "supplier", ("s_nationkey",), ("main", "nation"), ("n_nationkey",)),
    Key("main", "orders", ("o_custkey",), ("main", "customer"), ("c_custkey",)),
    Key("main", "lineitem", ("l_orderkey",), ("main", "orders"), ("o_orderkey",)),
    Key("main", "lineitem", ("l_partkey",), ("main", "part"), ("p_partkey",)),
    Key("main", "lineitem", ("l_suppkey",), ("main", "supplier"), ("s_suppkey",)),
    Key("main", "labels", ("doc_id",), ("main", "documents"), ("doc_id",)),
    Key("main", "events", ("user_id",), ("main", "customer"), ("c_custkey",)),
]


# --- the same in SQL -----------------------------------------------------------------------------

_TYPES = {
    "VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double",
    "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>",
}
_TYPE_CASE = "CASE column_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " ELSE column_type END"


def sql_catalog() -> str:
    parts = [
        f"SELECT 'main' AS table_schema, '{n}' AS table_name, row_number() OVER () AS ordinal, column_name, {_TYPE_CASE} AS data_type "
        f"FROM (DESCRIBE {n})"
        for n in t.NAMES
    ]
    return "catalog AS (" + " UNION ALL ".join(parts) + ")"


def _sql_nulls() -> str:
    parts = [
        f"SELECT '{n}' AS table_name, column_name, has_nulls FROM "
        f"(UNPIVOT (SELECT bool_or(COLUMNS(*) IS NULL) AS '\\0' FROM {n}) ON COLUMNS(*) INTO NAME column_name VALUE has_nulls)"
        for n in t.NAMES
    ]
    return "nulls AS (" + " UNION ALL ".join(parts) + ")"


def _sql_pk(key: Key) -> str:
    columns = ", ".join(key.columns)
    missing = " OR ".join(f"{c} IS NULL" for c in key.columns)
    return f"""SELECT '{key.table}' AS table_name, '{columns}' AS key_columns, CAST(sum(n) AS BIGINT) AS n_rows,
      CAST(coalesce(sum(n) FILTER (missing), 0) AS BIGINT) AS null_keys, count(*) FILTER (NOT missing AND n > 1) AS repeated_keys
    FROM (SELECT {columns}, {missing} AS missing, count(*) AS n FROM {key.table} GROUP BY ALL)"""


def _sql_fk(key: Key) -> str:
    column, parent = key.columns[0], key.parent[1]
    orphan = f"{column} NOT IN (SELECT {key.parent_columns[0]} FROM {parent})"
    return f"""SELECT '{key.table}' AS table_name, '{column}' AS key_columns, count({column}) AS n_refs,
      count(*) FILTER ({orphan}) AS orphan_rows, count(DISTINCT {column}) FILTER ({orphan}) AS orphan_keys FROM {key.table}"""


_PKS, _FKS = [k for k in DECLARED if not k.parent], [k for k in DECLARED if k.parent]
SQL_PK = " UNION ALL ".join(f"SELECT *, null_keys = 0 AND repeated_keys = 0 AS valid FROM ({_sql_pk(k)})" for k in _PKS)
SQL_FK = " UNION ALL ".join(f"SELECT *, orphan_rows = 0 AS valid FROM ({_sql_fk(k)})" for k in _FKS)
SQL_SCHEMA_ITEMS = f"""{sql_catalog()}, held AS (
  SELECT table_name, unnest(string_split(key_columns, ', ')) AS column_name, '{PRIMARY}' AS type FROM ({SQL_PK}) WHERE valid
  UNION ALL SELECT table_name, key_columns, '{FOREIGN}' FROM ({SQL_FK}) WHERE valid),
schema_items AS (
  SELECT 'table' AS kind, 'main.' || table_name AS name, 'Table main.' || table_name || ' has columns:' || chr(10)
    || string_agg('- ' || column_name || ' (' || data_type || ')', chr(10) ORDER BY ordinal) AS body FROM catalog GROUP BY table_name
  UNION ALL SELECT 'column', 'main.' || table_name || '.' || column_name,
    'Column main.' || table_name || '.' || column_name || ' has type ' || data_type || '.' FROM catalog
  UNION ALL SELECT 'key', 'main.' || table_name || '.' || type || '.' || column_name,
    type || ' on main.' || table_name || ' column ' || column_name || '.' FROM held)"""


@query(
    "catalog_columns",
    f"""WITH {sql_catalog()}, {_sql_nulls()} SELECT table_schema, table_name, CAST(ordinal AS INTEGER) AS ordinal, column_name, data_type, has_nulls
    FROM catalog JOIN nulls USING (table_name, column_name)""",
)
def catalog(spark, sf):
    """Columns in order, with whether the data holds nulls there."""
    tables = t.all_tables(spark, sf)
    keys = ["table_schema", "table_name", "column_name"]
    return catalog_columns(spark, tables).join(column_nulls(tables), keys)


def _union(frames):
    return reduce(DataFrame.unionByName, frames)


def _named(verdicts):
    """The name of a check, as table and columns."""
    table = F.split_part(F.col("key"), F.lit(":"), F.lit(1)).alias("table_name")
    columns = F.split_part(F.col("key"), F.lit(":"), F.lit(2)).alias("key_columns")
    return verdicts.select(table, columns, "*").drop("key")


def _name(key):
    return f"{key.table}:{', '.join(key.columns)}"


@query("key_check_pk", SQL_PK)
def key_check_pk(spark, sf):
    return _named(check_primary_keys({_name(k): (t.table(spark, sf, k.table), k.columns) for k in _PKS}))


@query("key_check_fk", SQL_FK)
def key_check_fk(spark, sf):
    def tables(key):
        return t.table(spark, sf, key.table), key.columns, t.table(spark, sf, key.parent[1]), key.parent_columns

    return _named(check_foreign_keys({_name(k): tables(k) for k in _FKS}))


@query("schema_items", f"WITH {SQL_SCHEMA_ITEMS} SELECT kind, name, body FROM schema_items")
def schema_items_query(spark, sf):
    return schema_items(spark, t.all_tables(spark, sf), DECLARED).select("kind", "name", "body")


@query(
    "kind_replace",
    f"""WITH {SQL_SCHEMA_ITEMS}, {t.SQL_ITEMS}, kept AS (SELECT * FROM items WHERE kind NOT IN ('table', 'column', 'key')),
    {t.sql_chunks('kept')}
    SELECT kind, name, 0 AS chunk_ix, body AS chunk_text FROM schema_items
    UNION ALL SELECT k.kind, k.name, c.chunk_ix, c.chunk_text FROM kept k JOIN chunks c ON c.item_id = k.id""",
)
def kind_replace(spark, sf):
    """The document store with its schema kinds replaced by the tables' present schema."""
    items = spread_out(t.items(spark, sf), "id")
    now = t.moment("2024-06-01 00:00:00")
    new_items, new_chunks = refresh_schema(
        spark, t.all_tables(spark, sf), DECLARED, items, embed_hashed(chunk_items(items)), embed_hashed, now
    )
    names = new_items.select(F.col("id").alias("item_id"), "kind", "name")
    return new_chunks.join(names, "item_id").select("kind", "name", "chunk_ix", "chunk_text")


# Every column that is a whole number or a text.
_EXAMPLES = [
    ("region", ["r_regionkey", "r_name"]),
    ("nation", ["n_nationkey", "n_name", "n_regionkey"]),
    ("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]),
    ("supplier", ["s_suppkey", "s_name", "s_nationkey"]),
    ("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]),
    ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]),
    ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]),
    ("events", ["event_id", "user_id", "event_type", "props"]),
    ("documents", ["doc_id", "text", "lang", "source", "n_chars"]),
    ("embeddings", ["vec_id", "label"]),
    ("pages", ["page_id", "url", "html"]),
    ("benchmark", ["item_id", "text"]),
    ("labels", ["doc_id", "quality", "toxic"]),
    ("conversations", ["conv_id", "turn", "role", "text"]),
]


def _sql_examples(table: str, column: str) -> str:
    return f"""SELECT 'example' AS kind, 'main.{table}.{column}' AS name,
      'Frequent values of main.{table}.{column}: ' || string_agg(value || ' (' || n || ')', ', ' ORDER BY n DESC, value) || '.' AS body
    FROM (SELECT CAST({column} AS VARCHAR) AS value, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 5)"""


@query("column_examples", " UNION ALL ".join(f"SELECT * FROM ({_sql_examples(n, c)})" for n, cs in _EXAMPLES for c in cs))
def examples(spark, sf):
    frames = [column_examples(t.table(spark, sf, n), "main", n, cs) for n, cs in _EXAMPLES]
    return _union(frames).select("kind", "name", "body")
