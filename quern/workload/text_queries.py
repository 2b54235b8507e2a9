"""Text and vector expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import vectors as vx
from quern.operators.chunks import chunk_items, complete_with
from quern.operators.ordering import spread_out
from quern.workload import tables as t
from quern.workload.registry import query


@query("normalize_text", f"SELECT doc_id, {t.sql_normalize('text')} AS norm FROM documents")
def normalize_text(spark, sf):
    return spread_out(t.table(spark, sf, "documents"), "doc_id").select("doc_id", tx.normalize(F.col("text")).alias("norm"))


@query("chunk_docs", f"WITH {t.SQL_ITEMS}, {t.sql_chunks()} SELECT item_id, chunk_ix, chunk_text FROM chunks")
def chunk_docs(spark, sf):
    return chunk_items(spread_out(t.items(spark, sf), "id"))


@query(
    "preview_trim",
    """SELECT doc_id, CASE WHEN length(f) <= 60 THEN f ELSE substr(f, 1, 59) || '…' END AS preview
       FROM (SELECT doc_id, replace(text, chr(10), ' ') AS f FROM documents)""",
)
def preview_trim(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", tx.preview(F.col("text"), 60).alias("preview"))


@query(
    "row_name_parse",
    f"""WITH {t.SQL_ITEMS}, broken AS (
      SELECT id, dataset, name FROM items
      UNION ALL SELECT page_id, 'web', url FROM pages
      UNION ALL SELECT id, 'other', name FROM items)
    SELECT id, dataset, name,
      CASE WHEN regexp_matches(name, '^[^:]+::[^:]+::row::[0-9]+$') AND split_part(name, '::', 2) = dataset
           THEN CAST(split_part(name, '::', 4) AS BIGINT) END AS row_ix
    FROM broken""",
)
def row_name_parse(spark, sf):
    source = F.element_at("metadata", F.lit("dataset"))
    position = F.element_at("metadata", F.lit("row"))
    items = t.items(spark, sf).select("id", source.alias("dataset"), tx.row_name(F.col("kind"), source, position).alias("name"))
    pages = t.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("web").alias("dataset"), F.col("url").alias("name"))
    others = items.withColumn("dataset", F.lit("other"))
    names = items.unionByName(pages).unionByName(others)
    return names.withColumn("row_ix", tx.row_index(F.col("name"), F.col("dataset")))


@query(
    "vector_text",
    """SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: format('{:.8f}', CAST(x AS DOUBLE))), ',') || ']' AS vec
       FROM embeddings""",
)
def vector_text(spark, sf):
    return t.table(spark, sf, "embeddings").select("vec_id", vx.vector_text(F.col("embedding")).alias("vec"))


@query(
    "hash_embed",
    f"""WITH {t.SQL_TEXT_STORE}
    SELECT item_id, chunk_ix, array_to_string(list_transform(embedding, lambda x: CAST(CAST(x * 1024 AS INTEGER) AS VARCHAR)), ',') AS steps
    FROM vectors""",
)
def hash_embed(spark, sf):
    steps = F.transform("embedding", lambda x: (x * vx.STEPS).cast("int").cast("string"))
    return t.chunks(spark, sf).select("item_id", "chunk_ix", F.array_join(steps, ",").alias("steps"))


_REPLIES = """replies AS (
  SELECT o_orderkey AS id,
    CASE WHEN o_orderpriority = '1-URGENT' THEN '```sql' || chr(10) || 'SELECT o_totalprice::int FROM orders WHERE o_orderkey = ' || o_orderkey || ';' || chr(10) || '```'
         WHEN o_orderpriority = '2-HIGH' THEN '  SQL: SELECT * FROM customer WHERE c_custkey = ' || o_custkey
         WHEN o_orderpriority = '3-MEDIUM' THEN '`DELETE FROM orders WHERE o_custkey = ' || o_custkey || '; SELECT 1`'
         WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'I cannot answer ' || o_orderkey
         ELSE chr(10) || 'select count(*) from orders where o_orderstatus = ''' || o_orderstatus || '''; ' END AS reply
  FROM orders)"""


def replies(spark, sf):
    """Replies as a model might give them, one per order, filled with the order's values."""
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    priority = F.col("o_orderpriority")
    text = (
        F.when(priority == "1-URGENT", F.concat(F.lit("```sql\nSELECT o_totalprice::int FROM orders WHERE o_orderkey = "), key, F.lit(";\n```")))
        .when(priority == "2-HIGH", F.concat(F.lit("  SQL: SELECT * FROM customer WHERE c_custkey = "), customer))
        .when(priority == "3-MEDIUM", F.concat(F.lit("`DELETE FROM orders WHERE o_custkey = "), customer, F.lit("; SELECT 1`")))
        .when(priority == "4-NOT SPECIFIED", F.concat(F.lit("I cannot answer "), key))
        .otherwise(F.concat(F.lit("\nselect count(*) from orders where o_orderstatus = '"), F.col("o_orderstatus"), F.lit("'; ")))
    )
    return t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.alias("reply"))


@query(
    "sql_clean",
    f"""WITH {_REPLIES}
    SELECT id, trim(regexp_replace(trim(regexp_replace(trim(reply, E' \\t\\n\\r'), '^`+|`+$', '', 'g'), E' \\t\\n\\r'),
                                   '^(?i)sql([ \\t\\r\\n]*:|[ \\t\\r\\n])', ''), E' \\t\\n\\r') AS clean_sql
    FROM replies""",
)
def sql_clean(spark, sf):
    return replies(spark, sf).select("id", tx.clean_sql(F.col("reply")).alias("clean_sql"))


@query(
    "sql_first_select",
    f"""WITH {_REPLIES}
    SELECT id, CASE WHEN lower(head) LIKE 'select%' THEN head || ';' ELSE 'SELECT 1;' END AS first_sql
    FROM (SELECT id, trim(split_part(reply, ';', 1), E' \\t\\n\\r') AS head FROM replies)""",
)
def sql_first_select(spark, sf):
    return replies(spark, sf).select("id", tx.first_select(F.col("reply")).alias("first_sql"))


@query(
    "complete_prompts",
    """SELECT item_id, 'SELECT name FROM users WHERE country = ''USA''' AS reply FROM benchmark""",
)
def complete_prompts(spark, sf):
    prompts = t.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("prompt"))
    return complete_with(prompts).select("item_id", "reply")
