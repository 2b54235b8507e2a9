"""Retrieval over the document store (benchmark texts ask) and the vector store (label means ask)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.vectors import DIMS
from quern.operators import nearest as ann
from quern.operators.rerank import mmr
from quern.operators.gate import REFUSED
from quern.plans import answer as answering
from quern.plans import prompts, results, retrieve
from quern.plans.retrieve import Knobs
from quern.plans.schema_grounding import ddl_snapshot
from quern.sources.catalog import catalog_columns
from quern.session import scratch_path, staged
from quern.sinks.files import write_json, write_prompts
from quern.workload import tables as t
from quern.workload.registry import query
from quern.workload.schema_queries import sql_catalog

CAND_COLUMNS = ["query_id", "item_id", "kind", "name", "chunk_ix", "cand_ix"]
SQL_CANDS = "query_id, item_id, kind, name, chunk_ix, CAST(cand_ix AS INTEGER) AS cand_ix, round(dist, 6) AS dist, round(sim, 6) AS sim"
SQL_RANKED = "query_id, item_id, kind, name, chunk_ix, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score"


COSINE = Knobs(metric="cosine")


def _shown(df):
    return df.select(*CAND_COLUMNS, F.round("dist", 6).alias("dist"), F.round("sim", 6).alias("sim"))


def _ranked(df):
    return df.select("query_id", "item_id", "kind", "name", "chunk_ix", "rank", F.round("score", 6).alias("score"))


def _vector_candidates(spark, sf, knobs=Knobs()):
    batch = ann.prepare(t.vector_questions(spark, sf))
    return retrieve.candidates(batch, t.vector_items(spark, sf), t.vector_chunks(spark, sf), knobs)


def _text_candidates(spark, sf, knobs=Knobs()):
    batch = ann.prepare(t.questions(spark, sf))
    return retrieve.candidates(batch, t.items(spark, sf), t.chunks(spark, sf), knobs)


@query("retrieve_topk", f"WITH {t.SQL_VECTOR_STORE}, {t.sql_candidates()} SELECT {SQL_CANDS} FROM cands")
def retrieve_topk(spark, sf):
    return _shown(_vector_candidates(spark, sf))


@query("retrieve_cosine", f"WITH {t.SQL_VECTOR_STORE}, {t.sql_candidates(metric=t.COSINE)} SELECT {SQL_CANDS} FROM cands")
def retrieve_cosine(spark, sf):
    return _shown(_vector_candidates(spark, sf, Knobs(metric="cosine")))


@query("retrieve_text_topk", f"WITH {t.SQL_TEXT_STORE}, {t.SQL_QUESTIONS}, {t.sql_candidates()} SELECT {SQL_CANDS} FROM cands")
def retrieve_text_topk(spark, sf):
    return _shown(_text_candidates(spark, sf))


_KIND_WHERE = "i.kind IN ('table', 'column', 'key', 'info')"


@query("retrieve_kinds", f"WITH {t.SQL_VECTOR_STORE}, {t.sql_candidates(where=_KIND_WHERE)} SELECT {SQL_CANDS} FROM cands")
def retrieve_kinds(spark, sf):
    return _shown(_vector_candidates(spark, sf, Knobs(kinds="table, column,key,,info".split(","))))


_DATASET_WHERE = "(i.kind <> 'info' OR i.dataset = 'set0')"


@query("retrieve_dataset", f"WITH {t.SQL_VECTOR_STORE}, {t.sql_candidates(where=_DATASET_WHERE)} SELECT {SQL_CANDS} FROM cands")
def retrieve_dataset(spark, sf):
    return _shown(_vector_candidates(spark, sf, Knobs(dataset="set0")))


@query(
    "retrieve_min_sim",
    f"WITH {t.SQL_TEXT_STORE}, {t.SQL_QUESTIONS}, {t.sql_candidates(metric=t.COSINE)} SELECT {SQL_CANDS} FROM cands WHERE sim >= 0.7",
)
def retrieve_min_sim(spark, sf):
    return _shown(retrieve.above(_text_candidates(spark, sf, COSINE), 0.7))


@query(
    "retrieve_answer_context",
    f"""WITH {t.SQL_TEXT_STORE}, {t.SQL_QUESTIONS}, {t.sql_candidates(metric=t.COSINE)}
    SELECT {SQL_CANDS} FROM cands WHERE sim > 0.6 AND kind IN ('info', 'example')""",
)
def retrieve_answer_context(spark, sf):
    return _shown(retrieve.answer_candidates(_text_candidates(spark, sf, COSINE), ["info", "example"]))


@query("mmr_rerank", f"WITH {t.SQL_VECTOR_STORE}, {t.sql_candidates()}, {t.sql_mmr()} SELECT {SQL_RANKED} FROM final")
def mmr_rerank(spark, sf):
    return _ranked(mmr(_vector_candidates(spark, sf)))


@query(
    "mmr_kind_cap",
    f"""WITH {t.SQL_VECTOR_STORE}, {t.sql_candidates()}, {t.sql_mmr(cap=8, lam=0.7, kind_cap=('example', 2))}
    SELECT {SQL_RANKED} FROM final""",
)
def mmr_kind_cap(spark, sf):
    return _ranked(mmr(_vector_candidates(spark, sf), lam=0.7, per_item_cap=8, kind_caps={"example": 2}))


@query(
    "retrieve_funnel",
    f"""WITH {t.SQL_TEXT_STORE}, {t.SQL_QUESTIONS}, {t.sql_candidates(metric=t.COSINE)},
    kept AS (SELECT * FROM cands WHERE sim >= 0.7), {t.sql_mmr(source='kept')}
    SELECT c.query_id, c.candidates, c.after_threshold, coalesce(f.n, 0) AS final
    FROM (SELECT query_id, count(*) AS candidates, count(*) FILTER (sim >= 0.7) AS after_threshold FROM cands GROUP BY 1) c
    LEFT JOIN (SELECT query_id, count(*) AS n FROM final GROUP BY 1) f USING (query_id)""",
)
def retrieve_funnel(spark, sf):
    knobs = Knobs(min_sim=0.7, metric="cosine")
    return retrieve.funnel(_text_candidates(spark, sf, knobs), knobs)


@query(
    "retrieve_two_contexts",
    f"""WITH {t.SQL_TEXT_STORE}, {t.SQL_QUESTIONS}, {t.sql_candidates(metric=t.COSINE)},
    strong AS (SELECT * FROM cands WHERE sim > 0.6 AND kind IN ('info', 'example')),
    {t.sql_mmr(out='forsql', topk=6, cap=8, kind_cap=('example', 2))},
    {t.sql_mmr(source='strong', out='foranswer', topk=12, cap=8, kind_cap=('example', 2))}
    SELECT 'sql' AS context, {SQL_RANKED} FROM forsql UNION ALL SELECT 'answer' AS context, {SQL_RANKED} FROM foranswer""",
)
def retrieve_two_contexts(spark, sf):
    both = retrieve.two_contexts(_text_candidates(spark, sf, COSINE), ["info", "example"])
    return both.select("context", "query_id", "item_id", "kind", "name", "chunk_ix", "rank", F.round("score", 6).alias("score"))


_SQL_PARTS = "string_agg('[' || f.kind || ':' || f.name || '#' || f.chunk_ix || ']' || chr(10) || k.chunk_text, chr(10) || chr(10) ORDER BY f.rank)"
SQL_PROMPT = f"""prompts AS (
  SELECT f.query_id,
    '{prompts.HEADER}' || chr(10) || chr(10) || chr(10) || '--- Retrieved context ---' || chr(10) || chr(10) || {_SQL_PARTS}
    || chr(10) || chr(10) || chr(10) || '--- Instructions ---' || chr(10) || chr(10) || '{prompts.FOOTER}' AS prompt
  FROM final f JOIN chunks k ON k.item_id = f.item_id AND k.chunk_ix = f.chunk_ix GROUP BY f.query_id)"""


@query(
    "retrieve_prompt",
    f"""WITH {t.SQL_TEXT_STORE}, {t.SQL_QUESTIONS}, {t.sql_candidates()}, {t.sql_mmr()}, {SQL_PROMPT}
    SELECT query_id, prompt FROM prompts""",
)
def retrieve_prompt(spark, sf):
    return retrieve.retrieve_prompts(t.questions(spark, sf), t.items(spark, sf), t.chunks(spark, sf))


_CONTEXT_ONLY = f"""contexts AS (
  SELECT f.query_id, {_SQL_PARTS} AS context
  FROM final f JOIN chunks k ON k.item_id = f.item_id AND k.chunk_ix = f.chunk_ix GROUP BY f.query_id)"""


def _context(spark, sf, topk):
    knobs = Knobs(topk=topk, per_item_cap=retrieve.CONTEXT_PER_ITEM_CAP, kind_caps=retrieve.KIND_CAPS)
    ranked = retrieve.retrieve(t.questions(spark, sf), t.items(spark, sf), t.chunks(spark, sf), knobs)
    return prompts.context_prompt(ranked, header=None, footer=None, mark=False)


@query(
    "prompt_build",
    f"""WITH {t.SQL_TEXT_STORE}, {t.SQL_QUESTIONS}, {t.sql_candidates()}, {t.sql_mmr(cap=8, kind_cap=('example', 2))}, {_CONTEXT_ONLY}
    SELECT query_id, context AS prompt FROM contexts""",
)
def prompt_build(spark, sf):
    return _context(spark, sf, retrieve.TOPK)


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_DDL = f"""(WITH {sql_catalog()} SELECT '-- Tables and columns (sample snapshot)' || chr(10)
  || string_agg(table_name || '(' || column_name || ' ' || data_type || ')', chr(10) ORDER BY table_name, ordinal) FROM catalog)"""


@query(
    "sql_prompt",
    f"""WITH {t.SQL_TEXT_STORE}, {t.SQL_QUESTIONS}, {t.sql_candidates()}, {t.sql_mmr(topk=6, cap=8, kind_cap=('example', 2))}, {_CONTEXT_ONLY}
    SELECT a.query_id, {_sql_text(prompts.SQL_INSTRUCTIONS + prompts.SQL_QUESTION)} || a.question
      || {_sql_text(prompts.SQL_SCHEMA)} || {_DDL} || {_sql_text(prompts.SQL_CONTEXT)} || coalesce(x.context, '(none)') || chr(10) AS prompt
    FROM asked a LEFT JOIN contexts x USING (query_id)""",
)
def sql_prompt(spark, sf):
    context = _context(spark, sf, retrieve.SQL_TOPK).withColumnRenamed("prompt", "context")
    ddl = ddl_snapshot(catalog_columns(spark, t.all_tables(spark, sf))).first()["schema_text"]
    asked = t.questions(spark, sf).select("query_id", "question").join(context, "query_id", "left")
    return asked.select("query_id", prompts.sql_prompt(F.col("question"), F.lit(ddl), F.col("context")).alias("prompt"))


@query(
    "answer_prompt",
    f"""WITH {t.SQL_TEXT_STORE}, {t.SQL_QUESTIONS}, {t.sql_candidates(metric=t.COSINE)},
    strong AS (SELECT * FROM cands WHERE sim > 0.6 AND kind IN ('info', 'example')),
    {t.sql_mmr(source='strong', cap=8, kind_cap=('example', 2))}, {_CONTEXT_ONLY},
    shown AS (SELECT {_sql_text('The following data was retrieved from the database:' + chr(10) + chr(10))}
        || string_agg('--- Row ' || i || ' ---' || chr(10) || 'r_regionkey: ' || r_regionkey || chr(10) || 'customers: ' || customers || chr(10) || chr(10), '' ORDER BY i) AS rows_text
      FROM (SELECT n_regionkey AS r_regionkey, count(*) AS customers, row_number() OVER (ORDER BY n_regionkey) AS i
            FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1))
    SELECT a.query_id, {_sql_text(prompts.ANSWER_INSTRUCTIONS + 'Question: ')} || a.question
      || {_sql_text(chr(10) + 'SQL return statement: ')} || s.rows_text || {_sql_text(chr(10) + 'Context: ')} || coalesce(x.context, '(none)') AS prompt
    FROM asked a LEFT JOIN contexts x USING (query_id), shown s""",
)
def answer_prompt(spark, sf):
    t.table(spark, sf, "customer").createOrReplaceTempView("customer")
    t.table(spark, sf, "nation").createOrReplaceTempView("nation")
    rows = spark.sql(
        "SELECT n_regionkey AS r_regionkey, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"
    )
    # One short text for a result of one row per region.
    shown = results.rows_text(results.numbered(rows, [F.col("r_regionkey")])).first()["rows_text"]
    batch = ann.prepare(t.questions(spark, sf))
    chunks = t.chunks(spark, sf)
    scored = retrieve.candidates(batch, t.items(spark, sf), chunks, COSINE)
    strong = retrieve.answer_candidates(scored, ["info", "example"])
    ranked = mmr(strong, retrieve.TOPK, 0.5, retrieve.CONTEXT_PER_ITEM_CAP, retrieve.KIND_CAPS)
    context = prompts.context_prompt(retrieve.with_text(batch, chunks, ranked), None, None, mark=False)
    asked = t.questions(spark, sf).select("query_id", "question").join(context.withColumnRenamed("prompt", "context"), "query_id", "left")
    return asked.select("query_id", prompts.answer_prompt(F.col("question"), F.lit(shown), F.col("context")).alias("prompt"))


# --- questions to answers ------------------------------------------------------------------------

_SELECT = "SELECT count(*) AS n, min(c_name) AS first FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = "


def _sql_side(source: str, topk: int) -> str:
    """(query_id, question, context) of one of the two contexts."""
    strong = "strong AS (SELECT * FROM cands WHERE sim > 0.6 AND kind IN ('info', 'example')), " if source == "strong" else ""
    return f"""(WITH {t.SQL_TEXT_STORE}, {t.SQL_QUESTIONS}, {t.sql_candidates(metric=t.COSINE)}, {strong}
      {t.sql_mmr(source=source, topk=topk, cap=8, kind_cap=('example', 2))}, {_CONTEXT_ONLY}
      SELECT a.query_id, a.question, coalesce(x.context, '(none)') AS context FROM asked a LEFT JOIN contexts x USING (query_id))"""


def _model():
    """Stands in for a model: what it proposes and answers depends on the question and on both contexts."""

    def reply(prompt: str) -> str:
        if prompt.startswith(prompts.ANSWER_INSTRUCTIONS):
            row = prompt.split("--- Row 1 ---\n")[1].split("\n\n")[0]
            return f" {row}, context {len(prompt.split(chr(10) + 'Context: ', 1)[1])}"
        question, rest = prompt.split(prompts.SQL_QUESTION)[1].split(prompts.SQL_SCHEMA)
        schema, context = rest.split(prompts.SQL_CONTEXT)
        if "lineitem(l_shipdate" not in schema or "region(r_name" not in schema:
            return "no schema"
        region = (len(question) + len(context[:-1])) % 6
        return "DROP TABLE nation" if region == 5 else f"```sql\n{_SELECT}{region}\n```"

    return lambda texts: [reply(text) for text in texts]


@query(
    "answer_questions",
    f"""WITH sql_side AS {_sql_side('cands', 6)}, answer_side AS {_sql_side('strong', 12)},
    proposed AS (SELECT query_id, (length(question) + length(context)) % 6 AS r FROM sql_side),
    counted AS (SELECT n_regionkey AS r, count(*) AS n, min(c_name) AS first FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT query_id, CASE WHEN r = 5 THEN 'DROP TABLE nation' ELSE '{_SELECT}' || r END AS clean_sql, CASE WHEN r = 5 THEN '{REFUSED}' END AS reason,
      'Found 1 rows. Example: {{"n":' || n || ',"first":"' || first || '"}}' AS draft,
      'n: ' || n || chr(10) || 'first: ' || first || ', context ' || length(a.context) AS answer
    FROM proposed LEFT JOIN counted USING (r) JOIN answer_side a USING (query_id)""",
)
def answer_questions(spark, sf):
    for name in ("customer", "nation"):
        t.table(spark, sf, name).createOrReplaceTempView(name)
    grounded = answering.contexts(t.questions(spark, sf), t.items(spark, sf), t.chunks(spark, sf), ["info", "example"], COSINE)
    schema = ddl_snapshot(catalog_columns(spark, t.all_tables(spark, sf))).first()["schema_text"]
    proposed = answering.propose(grounded, schema, lambda: _model())
    return answering.answer(proposed, lambda: _model()).select("query_id", "clean_sql", "reason", "draft", "answer")


_MANY = [
    ("SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 12 ORDER BY c_custkey DESC", "c_custkey", "c_name", "customer WHERE c_nationkey < 12", "c_custkey DESC"),
    ("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey", "o_orderkey", "o_orderpriority", "orders", "o_orderpriority, o_orderkey"),
    ("SELECT p_partkey, p_name FROM part WHERE p_size > 1000 ORDER BY p_partkey", "p_partkey", "p_name", "part WHERE p_size > 1000", "p_partkey"),
]


def _sql_many(sql: str, key: str, value: str, source: str, order: str) -> str:
    return f"""SELECT '{sql}' AS clean_sql, row_number() OVER (ORDER BY {order}) AS row_ix, {key} || '|' || {value} AS cells,
      'Found ' || count(*) OVER () || ' rows. Example: {{"{key}":' || first_value({key}) OVER (ORDER BY {order}) || ',"{value}":"' || first_value({value}) OVER (ORDER BY {order}) || '"}}' AS draft
    FROM {source}"""


@query("answer_rows", " UNION ALL ".join(f"SELECT * FROM ({_sql_many(*m)})" for m in _MANY))
def answer_rows(spark, sf):
    """All rows of statements that return many, each with its statement's count and first row."""
    for name in ("customer", "orders", "part"):
        t.table(spark, sf, name).createOrReplaceTempView(name)
    statements = spark.createDataFrame([(m[0], m[0]) for m in _MANY], "stmt_id string, sql string")
    rows, _ = answering.run_statements(spark, statements)
    drafts = answering.drafts(rows).select("clean_sql", "draft")
    shown = rows.filter("row_ix > 0").select("clean_sql", "row_ix", F.array_join("cells", "|").alias("cells"))
    return shown.join(drafts, "clean_sql")


_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate"


@query(
    "answer_segments",
    f"""WITH blocks AS (
      SELECT row_ix, '--- Row ' || row_ix || ' ---' || chr(10) || 'l_orderkey: ' || l_orderkey || chr(10) || 'l_linenumber: ' || l_linenumber || chr(10)
        || 'l_partkey: ' || l_partkey || chr(10) || 'l_shipdate: ' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') || chr(10) || chr(10) AS block
      FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate) AS row_ix FROM lineitem)),
    placed AS (SELECT *, strlen(block) AS size, sum(strlen(block)) OVER (ORDER BY row_ix) - strlen(block) AS begins FROM blocks)
    SELECT CAST(floor(begins / {results.SEGMENT_BYTES}) AS BIGINT) AS segment, CAST(min(begins) AS BIGINT) AS start, CAST(max(begins + size) AS BIGINT) AS stop,
      md5(string_agg(block, '' ORDER BY row_ix)) AS digest
    FROM placed GROUP BY 1""",
)
def answer_segments(spark, sf):
    """The text of all lines of all orders as a model reads it, in segments with their places."""
    t.table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    rows, _ = answering.run_statements(spark, spark.createDataFrame([(_LINES, _LINES)], "stmt_id string, sql string"))
    return answering.row_segments(rows).select("segment", "start", "stop", F.md5("text").alias("digest"))


def _sql_draft(sql: str, key: str, value: str, source: str, order: str) -> str:
    head = f"{prompts.DRAFT_INSTRUCTIONS}Question: how many\nSQL: {sql}\nRows JSON: ".replace("'", "''")
    return f"""SELECT '{sql}' AS clean_sql, md5('{head}' || substr('[' || coalesce(string_agg('{{"{key}":' || {key} || ',"{value}":"' || {value} || '"}}', ',' ORDER BY {order}), '') || ']', 1, {prompts.DRAFT_CHARS})) AS digest
    FROM {source}"""


@query("draft_prompts", " UNION ALL ".join(f"SELECT * FROM ({_sql_draft(*m)})" for m in _MANY))
def draft_prompts(spark, sf):
    """Prompts for drafts over statements with many rows: as much of the rows' JSON as stands in them."""
    for name in ("customer", "orders", "part"):
        t.table(spark, sf, name).createOrReplaceTempView(name)
    rows, _ = answering.run_statements(spark, spark.createDataFrame([(m[0], m[0]) for m in _MANY], "stmt_id string, sql string"))
    asked = spark.createDataFrame([(i, "how many", m[0]) for i, m in enumerate(_MANY)], "query_id long, question string, clean_sql string")
    return answering.draft_prompts(asked, rows).select("clean_sql", F.md5("prompt").alias("digest"))


@query(
    "prompts_file",
    f"""WITH {t.SQL_TEXT_STORE}, {t.SQL_QUESTIONS}, {t.sql_candidates()}, {t.sql_mmr()}, {SQL_PROMPT}
    SELECT query_id, md5(prompt) AS digest FROM prompts""",
)
def prompts_file(spark, sf):
    """The prompts of all questions as the file that is saved of them, read back."""
    path = scratch_path(spark, "prompts")
    write_prompts(retrieve.retrieve_prompts(t.questions(spark, sf), t.items(spark, sf), t.chunks(spark, sf)), path)
    return spark.read.schema("query_id long, prompt string").json(path).select("query_id", F.md5("prompt").alias("digest"))


@query(
    "final_json_file",
    f"""WITH {t.SQL_TEXT_STORE}, {t.SQL_QUESTIONS}, {t.sql_candidates()}, {t.sql_mmr()}
    SELECT f.query_id, CAST(f.rank AS INTEGER) AS rank, f.item_id, f.chunk_ix, md5(k.chunk_text) AS digest
    FROM final f JOIN chunks k ON k.item_id = f.item_id AND k.chunk_ix = f.chunk_ix""",
)
def final_json_file(spark, sf):
    """The final chunks of all questions as JSON documents in a file, read back field by field."""
    path = scratch_path(spark, "final")
    write_json(retrieve.final_json(retrieve.retrieve(t.questions(spark, sf), t.items(spark, sf), t.chunks(spark, sf))), path, ["query_id", "rank"])
    found = spark.read.schema("query_id long, rank int, json string").json(path)
    fields = F.from_json("json", "item_id long, chunk_ix int, chunk_text string").alias("j")
    return found.select("query_id", "rank", fields).select("query_id", "rank", "j.item_id", "j.chunk_ix", F.md5("j.chunk_text").alias("digest"))


# --- approximate forms ---------------------------------------------------------------------------

PROBES = 4
_CELLS = """cell_means AS (
  SELECT dense_rank() OVER (ORDER BY dataset) - 1 AS cell, pos, avg(x) AS x
  FROM (SELECT i.dataset, generate_subscripts(v.embedding, 1) AS pos, CAST(unnest(v.embedding) AS DOUBLE) AS x
        FROM vectors v JOIN items i ON i.id = v.item_id) GROUP BY dataset, pos),
cells AS (SELECT cell, list(x ORDER BY pos) AS embedding FROM cell_means GROUP BY cell),
placed AS (
  SELECT item_id, chunk_ix, arg_min(cell, list_distance(CAST(v.embedding AS DOUBLE[]), c.embedding)) AS cell, any_value(v.embedding) AS embedding
  FROM vectors v, cells c GROUP BY item_id, chunk_ix),
probed AS (
  SELECT query_id, cell, embedding FROM (
    SELECT q.query_id, c.cell, q.embedding, row_number() OVER (PARTITION BY q.query_id
      ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), c.embedding), c.cell) AS r
    FROM questions q, cells c) WHERE r <= {probes})"""


def _sql_probed(probes):
    return f"""WITH {t.SQL_TEXT_STORE}, {t.SQL_QUESTIONS}, {_CELLS.format(probes=probes)},
    {t.sql_candidates(pairs='probed q JOIN placed c ON q.cell = c.cell')} SELECT {SQL_CANDS} FROM cands"""


def _source_centroids(chunks):
    """Mean chunk vector of every source, as cells 0, 1, … in source order."""
    parts = chunks.select("dataset", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("dataset", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = means.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return ann.centroid_matrix(vectors.select("dataset", F.transform("v", lambda p: p["x"]).alias("embedding")), "dataset")


def _by_cells(spark, sf, probes):
    chunks = staged(t.chunks(spark, sf), "chunks")
    centroids = _source_centroids(chunks)
    index = ann.CellIndex(ann.assign_cells(chunks, centroids), centroids)
    batch = ann.prepare(t.questions(spark, sf))
    return _shown(retrieve.candidates(batch, t.items(spark, sf), chunks, Knobs(probes=probes or len(centroids)), index))


@query("retrieve_ivf", _sql_probed(PROBES))
def retrieve_ivf(spark, sf):
    return _by_cells(spark, sf, PROBES)


@query("retrieve_ivf_all_cells", f"WITH {t.SQL_TEXT_STORE}, {t.SQL_QUESTIONS}, {t.sql_candidates()} SELECT {SQL_CANDS} FROM cands")
def retrieve_ivf_all_cells(spark, sf):
    return _by_cells(spark, sf, None)


@query("retrieve_ivf_kmeans", f"WITH {t.SQL_VECTOR_STORE}, {t.sql_candidates()} SELECT {SQL_CANDS} FROM cands")
def retrieve_ivf_kmeans(spark, sf):
    """Trained cells, stored and read back; with all of them probed the search is exact, whatever they are."""
    chunks = t.vector_chunks(spark, sf)
    path = scratch_path(spark, "cells")
    ann.build_cells(chunks, 16).save(path)
    batch = ann.prepare(t.vector_questions(spark, sf))
    return _shown(retrieve.candidates(batch, t.vector_items(spark, sf), chunks, Knobs(probes=16), ann.CellIndex.load(spark, path)))


TABLES, BITS = 8, 6


def _sql_signatures(source: str, keys: str, out: str) -> str:
    """Signature per table of every vector, with planes by the md5 rule."""
    return f"""{out} AS (
  SELECT {keys}, tab, sum(CASE WHEN side >= 0 THEN 1 << CAST(bit AS INTEGER) ELSE 0 END) AS sig FROM (
    SELECT {keys}, tab, bit, list_dot_product(CAST(v.embedding AS DOUBLE[]), p.plane) AS side FROM {source} v, planes p)
  GROUP BY {keys}, tab)"""


_PLANES = f"""planes AS (
  SELECT tab, bit, list(CASE WHEN substr(md5(tab || ':' || bit || ':' || dim), 1, 1) >= '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY dim) AS plane
  FROM range({TABLES}) a(tab), range({BITS}) b(bit), range({DIMS}) d(dim) GROUP BY tab, bit)"""
_MATCHED = """matched AS (
  SELECT DISTINCT q.query_id, c.item_id, c.chunk_ix FROM q_sig q JOIN c_sig c ON q.tab = c.tab AND q.sig = c.sig)"""


@query(
    "retrieve_lsh",
    f"""WITH {t.SQL_TEXT_STORE}, {t.SQL_QUESTIONS}, {_PLANES}, {_sql_signatures('questions', 'query_id', 'q_sig')},
    {_sql_signatures('vectors', 'item_id, chunk_ix', 'c_sig')}, {_MATCHED},
    {t.sql_candidates(pairs='matched m JOIN questions q USING (query_id) JOIN vectors c USING (item_id, chunk_ix)').replace('c.item_id, c.chunk_ix,', 'm.item_id, m.chunk_ix,').replace('i.id = c.item_id', 'i.id = m.item_id').replace('q.query_id', 'm.query_id')}
    SELECT {SQL_CANDS} FROM cands""",
)
def retrieve_lsh(spark, sf):
    return _shown(_text_candidates(spark, sf, Knobs(sign_tables=TABLES)))
