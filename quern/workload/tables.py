"""The given tables, and the items, chunks and questions that Spark derives from them.

Each derived table has a SQL counterpart (a list of CTEs) for checking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.vectors import DIMS, hash_embedding
from quern.operators.chunks import chunk_items, embed_hashed
from quern.operators.ordering import spread_out

NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
EPOCH = "2024-01-01 00:00:00"
KINDS = ["table", "column", "key", "info", "example"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def all_tables(spark: SparkSession, sf: str) -> dict[tuple[str, str], DataFrame]:
    return {("main", name): table(spark, sf, name) for name in NAMES}


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def kind_of_lang(lang: Column) -> Column:
    return (
        F.when(lang == "en", "info").when(lang == "fr", "example").when(lang == "de", "table").when(lang == "es", "column").otherwise("key")
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as items: the language gives the kind, the source the dataset."""
    docs = table(spark, sf, "documents")
    kind = kind_of_lang(F.col("lang"))
    position = F.col("doc_id").cast("string")
    return docs.select(
        F.col("doc_id").alias("id"),
        kind.alias("kind"),
        F.concat_ws("::", kind, F.col("source"), F.lit("row"), position).alias("name"),
        F.col("text").alias("body"),
        F.create_map(
            F.lit("dataset"), F.col("source"), F.lit("identity"), F.lit("position"), F.lit("row"), position
        ).alias("metadata"),
        F.lit(1).alias("version"),
        moment(EPOCH).alias("created_at"),
        moment(EPOCH).alias("updated_at"),
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return embed_hashed(chunk_items(spread_out(items(spark, sf), "id"), with_kind=True))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts as questions."""
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return rows.withColumn("embedding", hash_embedding(F.col("question")))


def vector_items(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the given vectors as items, five kinds, three datasets."""
    label = F.col("label").cast("long")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (label % 5 + 1).cast("int"))
    dataset = F.concat(F.lit("set"), (label % 3).cast("string"))
    found = table(spark, sf, "embeddings").select("label").distinct()
    return found.select(
        label.alias("id"),
        kind.alias("kind"),
        F.concat_ws("::", kind, dataset, F.lit("row"), label.cast("string")).alias("name"),
        F.create_map(F.lit("dataset"), dataset).alias("metadata"),
    )


def vector_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The given vectors as chunks of their label's item."""
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("long").alias("item_id"), F.col("vec_id").cast("int").alias("chunk_ix"), "embedding"
    )


def vector_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector of each label as a question."""
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).cast("float").alias("x"))
    grouped = means.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")
    )
    return grouped.select("query_id", F.transform("v", lambda p: p["x"]).alias("embedding"))


# --- the same in SQL -----------------------------------------------------------------------------

_WIDE = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SQL_BLANK = rf"\t-\r\x1c- \x{{85}}\x{{a0}}{_WIDE}"
SQL_BLANK_IN_LINE = rf"\t\x0b-\r\x1c- \x{{85}}\x{{a0}}{_WIDE}"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SQL_BLANK}]+|[{SQL_BLANK}]+\\z', '', 'g')"


def sql_normalize(x: str) -> str:
    unix = f"replace(replace({sql_strip(x)}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return sql_strip(f"regexp_replace({unix}, '[{SQL_BLANK_IN_LINE}]+\\n', chr(10), 'g')")


SQL_KIND = (
    "CASE lang WHEN 'en' THEN 'info' WHEN 'fr' THEN 'example' WHEN 'de' THEN 'table' WHEN 'es' THEN 'column' ELSE 'key' END"
)
SQL_ITEMS = f"""items AS (
  SELECT doc_id AS id, {SQL_KIND} AS kind, {SQL_KIND} || '::' || source || '::row::' || doc_id AS name,
         text AS body, source AS dataset, 1 AS version
  FROM documents)"""


def sql_chunks(source: str = "items", key: str = "id", body: str = "body", out: str = "chunks") -> str:
    return f"""{out}_text AS (SELECT {key} AS item_id, {sql_strip(body)} AS t FROM {source}),
{out} AS (
  SELECT item_id, CAST(ix AS INTEGER) AS chunk_ix, substr(t, ix * 1500 + 1, 1500) AS chunk_text
  FROM (SELECT item_id, t, unnest(range(0, CAST(ceil(length(t) / 1500.0) AS BIGINT))) AS ix FROM {out}_text))"""


def sql_embed(source: str, keys: str, text: str, out: str) -> str:
    """CTEs that give ``out`` the keys and the hashed embedding of ``text``."""
    on = " AND ".join(f"d.{k.strip()} = h.{k.strip()}" for k in keys.split(","))
    listed = ", ".join(f"d.{k.strip()}" for k in keys.split(","))
    return f"""{out}_words AS (
  SELECT {keys}, unnest(list_filter(string_split_regex(lower({text}), '[ \\t\\r\\n]+'), lambda w: w <> '')) AS w FROM {source}),
{out}_hits AS (
  SELECT {keys}, CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {DIMS} AS INTEGER) AS b, count(*) AS c
  FROM {out}_words GROUP BY ALL),
{out}_dense AS (
  SELECT {listed}, d.i, coalesce(h.c, 0) AS c
  FROM (SELECT {keys}, i FROM {source}, range({DIMS}) r(i)) d LEFT JOIN {out}_hits h ON {on} AND h.b = d.i),
{out}_norm AS (SELECT {keys}, greatest(sqrt(CAST(sum(c * c) AS DOUBLE)), 1.0) AS norm FROM {out}_dense GROUP BY ALL),
{out} AS (
  SELECT {listed}, list(CAST(floor(d.c / h.norm * 1024 + 0.5) / 1024.0 AS FLOAT) ORDER BY d.i) AS embedding
  FROM {out}_dense d JOIN {out}_norm h ON {on} GROUP BY ALL)"""


SQL_TEXT_STORE = f"{SQL_ITEMS}, {sql_chunks()}, {sql_embed('chunks', 'item_id, chunk_ix', 'chunk_text', 'vectors')}"
SQL_QUESTIONS = f"asked AS (SELECT item_id AS query_id, text AS question FROM benchmark), {sql_embed('asked', 'query_id', 'question', 'questions')}"

SQL_VECTOR_STORE = """items AS (
  SELECT id, kind, dataset, kind || '::' || dataset || '::row::' || id AS name
  FROM (SELECT DISTINCT CAST(label AS BIGINT) AS id, ['table', 'column', 'key', 'info', 'example'][label % 5 + 1] AS kind,
               'set' || (label % 3) AS dataset FROM embeddings)),
vectors AS (SELECT CAST(label AS BIGINT) AS item_id, CAST(vec_id AS INTEGER) AS chunk_ix, embedding FROM embeddings),
means AS (
  SELECT label, pos, CAST(avg(x) AS FLOAT) AS x
  FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
  GROUP BY ALL),
questions AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY pos) AS embedding FROM means GROUP BY ALL)"""

L2 = "list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"
COSINE = (
    "1 - list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / "
    "(sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * "
    "sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))))"
)


def sql_candidates(k: int = 80, metric: str = L2, where: str = "true", pairs: str = "questions q, vectors c") -> str:
    """CTE ``cands``: the k nearest chunks per question with their item."""
    return f"""pairs AS (
  SELECT q.query_id, c.item_id, c.chunk_ix, {metric} AS dist FROM {pairs} JOIN items i ON i.id = c.item_id WHERE {where}),
cands AS (
  SELECT p.*, 1 - p.dist AS sim, i.kind, i.name
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, item_id, chunk_ix) AS cand_ix FROM pairs) p
  JOIN items i ON i.id = p.item_id WHERE cand_ix <= {k})"""


def sql_mmr(source: str = "cands", out: str = "final", topk: int = 12, cap: int = 2, lam: float = 0.5, kind_cap: tuple[str, int] | None = None) -> str:
    kept = "true"
    if kind_cap:
        kept = f"pos = 1 OR kind <> '{kind_cap[0]}' OR in_kind <= {kind_cap[1]}"
    return f"""{out}_a AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY cand_ix) AS in_item FROM {source}),
{out}_b AS (
  SELECT *, CAST({lam} AS DOUBLE) * sim - CAST({1 - lam} AS DOUBLE) * (CASE WHEN in_item > 1 THEN 1 ELSE 0 END) AS score
  FROM {out}_a WHERE in_item <= {cap}),
{out}_c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_ix) AS pos FROM {out}_b),
{out}_d AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind, pos > 1 ORDER BY pos) AS in_kind FROM {out}_c),
{out} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM {out}_d WHERE {kept})
  WHERE rank <= {topk})"""
