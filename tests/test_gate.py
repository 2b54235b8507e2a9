import json

import pytest
from pyspark.sql import functions as F

from quern.operators import gate as g
from quern.plans import results
from quern.plans.guarded import Refused, _run, run_all, run_guarded

ACCEPTED = [
    "SELECT * FROM t",
    "with a as (select 1 as x) select x from a;",
    "(SELECT k FROM t) UNION (SELECT 2)",
    "SELECT 'drop; delete' AS s, \"insert\" FROM t -- update",
    "SELECT 1 /* create\n table; */",
    "SELECT update_ts, dropped FROM t",
    "VALUES (1)",
    "TABLE t",
    "SELECT 'it''s; drop' AS s",
    "SELECT truncate(1.5, 0)",
    "SELECT copy FROM t",
    "SELECT t.update FROM t",
    "FROM t SELECT a",
    "SELECT 'reflect'",
    "SELECT 'it\\'s; ok'",
    "SELECT reflect FROM t -- reflect(",
    "SELECT 'csv.`x`', \"reflect('a')\"",
    "SELECT r'\\' AS a, ';' AS b",
    "SELECT csv.`name` FROM t AS csv",
    "SELECT text.`value` FROM text",
    "SELECT a, json.`b` FROM t json WHERE json.`c` = 1",
    "SELECT ')' AS a, \"((\" AS b -- (",
    "SELECT * FROM a JOIN b USING (k)",
]
REJECTED = [
    "INSERT INTO t VALUES (1)",
    "update t set k = 1",
    "DELETE FROM t",
    "DROP TABLE t",
    "ALTER TABLE t ADD c int",
    "TRUNCATE t",
    "CREATE TABLE x AS SELECT 1",
    "EXECUTE p",
    "BEGIN; DELETE FROM t; COMMIT",
    "SELECT 1; SELECT 2",
    "WITH x AS (DELETE FROM t RETURNING *) SELECT * FROM x",
    "SELECT * INTO y FROM t",
    "MERGE INTO t USING s ON true WHEN MATCHED THEN DELETE",
    "GRANT ALL ON t TO u",
    "SET a = 1",
    "SHOW TABLES",
    "EXPLAIN SELECT 1",
    "CALL f()",
    "",
    " ; ",
    "I do not know",
    "SELECT reflect('java.lang.Math', 'max', 1, 2)",
    "SELECT `reflect`('java.lang.Math', 'max', 1, 2)",
    "SELECT '\\'', reflect('java.lang.Math', 'max', 1, 2)",
    "SELECT java_method /* x */ ('a', 'b')",
    "SELECT * FROM parquet.`/etc/x`",
    "SELECT * FROM `parquet`.`/etc/x`",
    "SELECT * FROM  csv . `x`",
    "SELECT IDENTIFIER('ref' || 'lect')('java.lang.Math', 'abs', -3)",
    "SELECT identifier /* x */ ('a')",
    "SELECT r'\\', reflect('java.lang.Math', 'abs', -3), '\\''",
    "SELECT * FROM parquet./* hidden */`/etc/x`",
    "SELECT * FROM `org.apache.spark.sql.execution.datasources.csv.CSVFileFormat`.`x`",
    "SELECT 1 FROM (DELETE FROM t)",
    "SELECT /* ' */ reflect('java.lang.Math', 'abs', -3) /* ' */",
    "SELECT 1 AS a) UNION ALL SELECT * FROM (SELECT 2",
    "SELECT (1",
    "SELECT * FROM t, parquet.`/etc/x`",
    "SELECT * FROM t JOIN json.`/etc/x` USING (a)",
    "SELECT TRANSFORM(a) USING 'cat' FROM t",
    "SELECT TRANSFORM(a) USING\"cat\" FROM t",
]


def _gate(spark, texts):
    rows = g.gate(spark.createDataFrame(list(enumerate(texts)), "stmt_id long, sql string")).orderBy("stmt_id")
    return rows.collect()


def test_corpus(spark):
    assert [r.sql for r in _gate(spark, ACCEPTED) if not r.allowed] == []
    assert [r.sql for r in _gate(spark, REJECTED) if r.allowed] == []


def test_verdicts(spark):
    values, drop, many = _gate(spark, ["VALUES (1)", "DROP TABLE t", "SELECT 1; SELECT 2"])
    assert values.warnings == [g.NO_SELECT] and values.reason is None
    assert drop.reason == g.REFUSED and drop.warnings == []
    assert many.reason == "Only a single statement is allowed."


def test_long_literals_do_not_break_the_gate(spark):
    text = "SELECT '" + "x''" * 20000 + "' AS s /* " + "y\n" * 20000 + " */"
    assert _gate(spark, [text])[0].allowed


def test_run(spark):
    spark.range(200).createOrReplaceTempView("t")
    rows, warnings = run_guarded(spark, "```sql\nSELECT id FROM t WHERE id >= 50;\n```")
    assert rows.count() == 150 and warnings == []
    assert run_guarded(spark, "SELECT id FROM t", limit=100)[0].count() == 100
    assert run_guarded(spark, "VALUES (1), (2)")[1] == [g.NO_SELECT]
    for bad in ["DROP VIEW t", "SELECT 1) x; DROP VIEW t; SELECT * FROM (SELECT 1", "SELECT missing FROM t", "SELECT FROM WHERE"]:
        with pytest.raises(Refused):
            run_guarded(spark, bad)
    assert spark.catalog.tableExists("t")


def test_paths_are_no_tables_however_they_are_written(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    before = spark.conf.get("spark.sql.runSQLOnFiles")
    for text in (f"SELECT * FROM parquet./* hidden */`{tmp_path}/p`", f"SELECT * FROM `parquet`.`{tmp_path}/p`"):
        assert spark.sql(text).count() == 3
        with pytest.raises(Refused):
            run_guarded(spark, text)
    assert spark.conf.get("spark.sql.runSQLOnFiles") == before


def test_denied_expressions_are_found_after_resolution(spark):
    spark.range(3).createOrReplaceTempView("t")
    call = "reflect('java.lang.Math', 'abs', -3)"
    for text in (f"SELECT {call}", f"SELECT (SELECT {call})", f"SELECT 1 FROM t WHERE EXISTS (SELECT {call})"):
        with pytest.raises(Refused, match="function"):
            _run(spark, text, None)
    assert _run(spark, "SELECT 'org.apache.spark.sql.catalyst.expressions.CallMethodViaReflection' AS s", None).count() == 1


def test_the_parsed_plan_decides(spark, tmp_path):
    """What the text alone cannot tell, or a text gate would not see: statements are judged by their parsed plan."""
    spark.range(3).write.parquet(str(tmp_path / "p"))
    spark.range(3).withColumnRenamed("id", "value").createOrReplaceTempView("text")
    bad = [
        "SELECT 1 AS a) UNION ALL SELECT * FROM (SELECT 2", "SELECT TRANSFORM(value) USING 'cat' FROM text", "FROM text INSERT INTO u SELECT value",
        f"SELECT * FROM (SELECT 1 AS a) x, parquet.`{tmp_path}/p`", f"SELECT (SELECT max(id) FROM parquet.`{tmp_path}/p`)",
        f"WITH q AS (SELECT * FROM `parquet`.`{tmp_path}/p`) SELECT * FROM q", "SELECT * FROM IDENTIFIER('text')", "SET a = 1", "SELECT FROM",
    ]
    for text in bad:
        with pytest.raises(Refused):
            _run(spark, text, None)
    good = ["SELECT text.`value` FROM text", "SELECT csv.`value` FROM text AS csv", "WITH q AS (SELECT value FROM text) SELECT (SELECT max(value) FROM q) FROM q", "SELECT value FROM default.kept"]
    spark.range(3).withColumnRenamed("id", "value").write.mode("overwrite").option("path", str(tmp_path / "kept")).saveAsTable("default.kept")
    try:
        assert [run_guarded(spark, text)[0].count() for text in good] == [3] * len(good)
    finally:
        spark.sql("DROP TABLE default.kept")


def test_run_all(spark):
    spark.range(3).createOrReplaceTempView("t")
    statements = spark.createDataFrame([(1, "SELECT count(*) AS n FROM t"), (2, "DELETE FROM t"), (3, "SELECT nope FROM t")], "stmt_id long, sql string")
    found = {i: (rows and rows.first().n, refusal) for i, rows, _, refusal in run_all(spark, statements)}
    assert found[1] == (3, None) and found[2] == (None, g.REFUSED) and "nope" in found[3][1]


def _numbered(spark, n=25):
    df = spark.range(n).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit('a"b,'), F.col("id").cast("string"))).alias("name"),
        F.array(F.col("id")).alias("list"),
    ).repartition(5)
    return results.numbered(df, [F.asc("k")])


def test_result_forms(spark):
    rows = _numbered(spark)
    headers, cells = results.result_rows(rows)
    assert headers == ["k", "name", "list"]
    assert cells.orderBy("row_ix").first().cells == ["0", 'a"b,0', "[0]"]
    text = results.rows_text(rows).first().rows_text
    assert text.startswith(results.ROWS_HEAD + '--- Row 1 ---\nk: 0\nname: a"b,0\nlist: [0]\n\n--- Row 2 ---\nk: 1\nname: null\n')
    assert [tuple(r) for r in results.rows_text(_numbered(spark, 0)).collect()] == [(0, results.NO_DATA)]
    parts = [r.rows_text for r in results.rows_text(rows, 7).orderBy("part").collect()]
    assert len(parts) == 4 and "".join(parts) == text
    assert results.draft_answer(rows.select("row_ix", "k")).first().answer == 'Found 25 rows. Example: {"k":0}'
    assert results.draft_answer(_numbered(spark, 0)).first().answer == "Found 0 rows. Example: {}"


def _document(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_export_documents(spark, tmp_path):
    from quern.sinks.files import write_lines

    rows = _numbered(spark)
    write_lines(results.csv_lines(rows, "q, 1", "SELECT 1", "", ["w"]), str(tmp_path / "csv"))
    lines = _document(tmp_path / "csv").splitlines()
    assert lines[:8] == ["Section,Key,Value", 'Meta,Question,"q, 1"', "Meta,SQL,SELECT 1", "Meta,Answer,", "Meta,Warning 1,w", "", "Rows Table", "0,1,2"]
    assert lines[8:10] == ['0,"a""b,0",[0]', "1,,[1]"] and len(lines) == 33
    named = results.csv_lines(rows, "q", "s", "a", names=True).filter("section = 1").first().line
    assert named == "k,name,list"
    assert results.csv_lines(_numbered(spark, 0), "q", "s", "a").filter("section > 0").first().line == "No rows"
    write_lines(results.json_lines(rows, 'q "1"\n', "SELECT 1", "yes", ["w"]), str(tmp_path / "json"))
    document = json.loads(_document(tmp_path / "json"))
    assert (document["question"], document["warnings"]) == ('q "1"\n', ["w"])
    assert document["rows"][:2] == [[0, 'a"b,0', "[0]"], [1, None, "[1]"]] and len(document["rows"]) == 25
