"""Guarded statements over the given tables, and the packaging of their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quern.operators import gate as g
from quern.plans import results
from quern.plans.guarded import USUAL_LIMIT, run_all, run_guarded
from quern.workload import tables as t
from quern.workload.registry import query

# Statements as a model might write them, one per order: a shared expression of both dialects.
_STATEMENTS = """CASE o_orderpriority || o_orderstatus
  WHEN '1-URGENTF' THEN 'SELECT * FROM orders WHERE o_orderkey = ' || o_orderkey
  WHEN '1-URGENTO' THEN 'with t as (select ' || o_custkey || ' as c) select c from t;'
  WHEN '1-URGENTP' THEN 'DELETE FROM orders WHERE o_custkey = ' || o_custkey
  WHEN '2-HIGHF' THEN 'SELECT ' || chr(39) || 'drop table t; --' || chr(39) || ' AS note, ' || o_orderkey
  WHEN '2-HIGHO' THEN 'SELECT 1 /* drop ' || o_orderkey || ' */ -- delete; insert' || chr(10) || ' FROM orders'
  WHEN '2-HIGHP' THEN 'SELECT ' || o_orderkey || '; DROP TABLE orders'
  WHEN '3-MEDIUMF' THEN 'VALUES (' || o_orderkey || ')'
  WHEN '3-MEDIUMO' THEN 'SELECT update_ts, ' || chr(34) || 'create' || chr(34) || ' FROM t WHERE k = ' || o_orderkey
  WHEN '3-MEDIUMP' THEN 'MERGE INTO t USING s ON t.k = ' || o_orderkey || ' WHEN MATCHED THEN DELETE'
  WHEN '4-NOT SPECIFIEDF' THEN 'SET x = ' || o_orderkey
  WHEN '4-NOT SPECIFIEDO' THEN 'SELECT reflect(' || chr(39) || 'java.lang.System' || chr(39) || ', ' || o_orderkey || ')'
  WHEN '4-NOT SPECIFIEDP' THEN 'SELECT * FROM parquet.' || chr(96) || '/data/' || o_orderkey || chr(96)
  WHEN '5-LOWF' THEN '  ;  '
  WHEN '5-LOWO' THEN chr(96) || chr(96) || chr(96) || 'sql' || chr(10) || '(SELECT ' || o_orderkey || ')' || chr(10) || chr(96) || chr(96) || chr(96)
  ELSE 'SELECT * INTO copy_of FROM orders WHERE o_orderkey = ' || o_orderkey END"""

_CALL = "A function of the statement is not allowed."
_PATH = "Reading files by path is not allowed."
_MANY = "Only a single statement is allowed."
_EMPTY = "The statement is empty."


@query(
    "gate_statements",
    f"""WITH s AS (SELECT o_orderkey AS stmt_id, o_orderpriority || o_orderstatus AS p, {_STATEMENTS} AS sql FROM orders)
    SELECT stmt_id, CASE WHEN p = '5-LOWF' THEN ';' WHEN p = '5-LOWO' THEN replace(replace(sql, '```sql' || chr(10), ''), chr(10) || '```', '') ELSE sql END AS clean_sql,
      CASE WHEN p IN ('1-URGENTP', '3-MEDIUMP', '4-NOT SPECIFIEDF') OR p NOT LIKE '%O' AND p LIKE '5-LOWP' THEN '{g.REFUSED}'
           WHEN p = '2-HIGHP' THEN '{_MANY}' WHEN p = '4-NOT SPECIFIEDO' THEN '{_CALL}' WHEN p = '4-NOT SPECIFIEDP' THEN '{_PATH}'
           WHEN p = '5-LOWF' THEN '{_EMPTY}' END AS reason,
      p IN ('1-URGENTF', '1-URGENTO', '2-HIGHF', '2-HIGHO', '3-MEDIUMF', '3-MEDIUMO', '5-LOWO') AS allowed,
      CASE WHEN p = '3-MEDIUMF' THEN '{g.NO_SELECT}' ELSE '' END AS warnings
    FROM s""",
)
def gate_statements(spark, sf):
    statements = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("stmt_id"), F.expr(_STATEMENTS).alias("sql"))
    judged = g.gate(statements)
    return judged.select("stmt_id", "clean_sql", "reason", "allowed", F.array_join("warnings", ",").alias("warnings"))


# Statements that only their shape tells apart, one per customer: a shared expression of both dialects.
_SHAPES = """CASE c_mktsegment
  WHEN 'AUTOMOBILE' THEN 'SELECT 1 AS a) UNION ALL SELECT * FROM (SELECT ' || c_custkey
  WHEN 'BUILDING' THEN 'SELECT csv.' || chr(96) || 'name' || chr(96) || ' FROM t AS csv WHERE k = ' || c_custkey
  WHEN 'FURNITURE' THEN 'SELECT a, text.' || chr(96) || 'value' || chr(96) || ' FROM text WHERE (k = ' || c_custkey || ')'
  WHEN 'HOUSEHOLD' THEN 'SELECT a FROM t, json.' || chr(96) || '/data/' || c_custkey || chr(96)
  ELSE 'SELECT TRANSFORM(a) USING ' || chr(39) || 'cat ' || c_custkey || chr(39) || ' FROM t' END"""


@query(
    "gate_shapes",
    f"""SELECT c_custkey AS stmt_id, {_SHAPES} AS clean_sql, c_mktsegment IN ('BUILDING', 'FURNITURE') AS allowed,
      CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '{g.UNBALANCED.replace("'", "''")}' WHEN 'HOUSEHOLD' THEN '{_PATH}'
        WHEN 'BUILDING' THEN NULL WHEN 'FURNITURE' THEN NULL ELSE '{_CALL}' END AS reason
    FROM customer""",
)
def gate_shapes(spark, sf):
    statements = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("stmt_id"), F.expr(_SHAPES).alias("sql"))
    return g.gate(statements).select("stmt_id", "clean_sql", "allowed", "reason")


def _views(spark, sf, *names):
    for name in names:
        t.table(spark, sf, name).createOrReplaceTempView(name)


TOP_N = "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5"


@query("guarded_topn", TOP_N)
def guarded_topn(spark, sf):
    _views(spark, sf, "orders")
    return run_guarded(spark, f"```sql\n{TOP_N};\n```")[0]


MOST = "SELECT p_brand, count(*) AS n_lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY n_lines DESC, p_brand LIMIT 10"


@query("guarded_most", MOST)
def guarded_most(spark, sf):
    _views(spark, sf, "lineitem", "part")
    return run_guarded(spark, MOST)[0]


JOIN_AGG = """SELECT r_name, c_mktsegment, count(*) AS n_orders, round(sum(CAST(o_totalprice AS DECIMAL(18, 2))), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, c_mktsegment"""


@query("guarded_join_agg", JOIN_AGG)
def guarded_join_agg(spark, sf):
    _views(spark, sf, "orders", "customer", "nation", "region")
    return run_guarded(spark, JOIN_AGG)[0]


WINDOWED = """WITH ranked AS (
  SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM ranked WHERE r <= 2"""


@query("guarded_window", WINDOWED)
def guarded_window(spark, sf):
    _views(spark, sf, "orders")
    return run_guarded(spark, WINDOWED)[0]


@query("guarded_limit", f"SELECT count(*) AS n FROM (SELECT * FROM lineitem WHERE l_quantity > 10 LIMIT {USUAL_LIMIT})")
def guarded_limit(spark, sf):
    """The default limit, which takes any rows, hence the count."""
    _views(spark, sf, "lineitem")
    rows, _ = run_guarded(spark, "SELECT * FROM lineitem WHERE l_quantity > 10", USUAL_LIMIT)
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query(
    "guarded_verdicts",
    """SELECT 'F' AS status, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders
    UNION ALL SELECT 'O', count(*) FILTER (o_orderstatus = 'O') FROM orders UNION ALL SELECT 'P', count(*) FILTER (o_orderstatus = 'P') FROM orders""",
)
def guarded_verdicts(spark, sf):
    """One statement per order status found in the data, each gated and run."""
    _views(spark, sf, "orders")
    status = F.col("o_orderstatus")
    text = F.concat(F.lit("SELECT '"), status, F.lit("' AS status, count(*) AS n FROM orders WHERE o_orderstatus = '"), status, F.lit("'"))
    statements = t.table(spark, sf, "orders").select(status.alias("stmt_id")).distinct().withColumnRenamed("stmt_id", "o_orderstatus")
    statements = statements.select(status.alias("stmt_id"), text.alias("sql"))
    frames = [rows for _, rows, _, refusal in run_all(spark, statements) if refusal is None]
    return reduce(lambda a, b: a.unionByName(b), frames)


# --- packaging ----------------------------------------------------------------------------------

CUSTOMERS = """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || ', "vip"' ELSE c_name END AS c_name,
  CASE WHEN c_nationkey > 3 THEN c_mktsegment END AS segment, CAST(c_acctbal AS DECIMAL(12, 2)) AS balance FROM customer"""


def _customers(spark, sf):
    _views(spark, sf, "customer")
    rows, _ = run_guarded(spark, CUSTOMERS)
    return results.numbered(rows, [F.desc("balance"), F.asc("c_custkey")])


SQL_NUMBERED = f"numbered AS (SELECT *, row_number() OVER (ORDER BY balance DESC, c_custkey) AS row_ix FROM ({CUSTOMERS}))"


@query(
    "result_rows",
    f"WITH {SQL_NUMBERED} SELECT row_ix, c_custkey || '|' || c_name || '|' || coalesce(segment, '(null)') || '|' || balance AS cells FROM numbered",
)
def result_rows(spark, sf):
    _, rows = results.result_rows(_customers(spark, sf))
    return rows.select("row_ix", F.array_join("cells", "|", "(null)").alias("cells"))


@query(
    "rows_to_text",
    f"""WITH {SQL_NUMBERED} SELECT row_ix, '--- Row ' || row_ix || ' ---' || chr(10) || 'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name
      || chr(10) || 'segment: ' || coalesce(segment, 'null') || chr(10) || 'balance: ' || balance || chr(10) || chr(10) AS block FROM numbered""",
)
def rows_to_text(spark, sf):
    return results.row_blocks(_customers(spark, sf))


@query(
    "draft_answer",
    f"""WITH {SQL_NUMBERED} SELECT 'Found ' || (SELECT count(*) FROM numbered) || ' rows. Example: ' || to_json({{'c_custkey': c_custkey, 'c_name': c_name}}) AS answer
    FROM numbered WHERE row_ix = 1""",
)
def draft_answer(spark, sf):
    return results.draft_answer(_customers(spark, sf).select("row_ix", "c_custkey", "c_name"))


_ASKED, _ANSWER, _WARNED = 'Which customers, by "balance"?', "All of them,\nin order.", ["First warning", "Second, with comma"]


@query(
    "result_csv_lines",
    f"""WITH {SQL_NUMBERED}, e AS (
      SELECT row_ix, CASE WHEN regexp_matches(c_name, '[",]') THEN '"' || replace(c_name, '"', '""') || '"' ELSE c_name END AS c_name,
        c_custkey, coalesce(segment, '') AS segment, balance FROM numbered)
    SELECT 2 AS section, row_ix AS line_ix, c_custkey || ',' || c_name || ',' || segment || ',' || balance AS line FROM e
    UNION ALL SELECT 1, 0, '0,1,2,3'
    UNION ALL SELECT 0, 0, 'Section,Key,Value' UNION ALL SELECT 0, 1, 'Meta,Question,"Which customers, by ""balance""?"'
    UNION ALL SELECT 0, 2, 'Meta,SQL,SELECT' UNION ALL SELECT 0, 3, 'Meta,Answer,"All of them,' || chr(10) || 'in order."'
    UNION ALL SELECT 0, 4, 'Meta,Warning 1,First warning' UNION ALL SELECT 0, 5, 'Meta,Warning 2,"Second, with comma"'
    UNION ALL SELECT 0, 6, '' UNION ALL SELECT 0, 7, 'Rows Table'""",
)
def result_csv_lines(spark, sf):
    return results.csv_lines(_customers(spark, sf), _ASKED, "SELECT", _ANSWER, _WARNED)


@query(
    "result_json_lines",
    f"""WITH {SQL_NUMBERED}
    SELECT 1 AS section, row_ix AS line_ix, CASE WHEN row_ix > 1 THEN ',' ELSE '' END || '[' || c_custkey || ',' || to_json(c_name) || ','
      || coalesce(CAST(to_json(segment) AS VARCHAR), 'null') || ',' || balance || ']' AS line FROM numbered
    UNION ALL SELECT 0, 0, '{{"question":"q","sql":"SELECT","answer":"a","warnings":["w"],"rows":['
    UNION ALL SELECT 2, 0, ']}}'""",
)
def result_json_lines(spark, sf):
    return results.json_lines(_customers(spark, sf), "q", "SELECT", "a", ["w"])
