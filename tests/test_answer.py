import pytest
from pyspark.sql import functions as F

from quern.functions.vectors import hash_embedding

from quern.operators.chunks import chunk_items, complete_parts, embed_hashed, reads_parts
from quern.plans import answer, prompts, results
from quern.plans.retrieve import Knobs


def test_questions_to_answers(spark):
    answering, schema = prompts.ANSWER_INSTRUCTIONS, prompts.SQL_SCHEMA

    def model(texts):
        out = []
        for text in texts:
            if text.startswith(answering):
                out.append("" if "No data found" in text else f"read {text.count('--- Row')} rows")
            elif "delete" in text.split(schema)[0]:
                out.append("DELETE FROM users")
            elif "missing" in text:
                out.append("SELECT nope FROM users")
            elif "broken" in text:
                out.append("SELECT name, 1 / length(substr(name, 2)) AS r FROM users")
            elif "nobody" in text:
                out.append("SELECT name FROM users WHERE name = 'z'")
            else:
                out.append("SQL: SELECT name FROM users ORDER BY name DESC")
        return out

    spark.createDataFrame([("a",), ("b",), ("c",)], "name string").repartition(3).createOrReplaceTempView("users")
    texts = ["who uses this", "please delete them", "a missing column", "is nobody here", "who uses that", "something broken"]
    questions = spark.createDataFrame(list(enumerate(texts)), "query_id long, question string")
    questions = questions.withColumn("embedding", hash_embedding(F.col("question")))
    items = spark.createDataFrame([(1, "info", "who", "who uses this"), (2, "table", "t", "Table t")], "id long, kind string, name string, body string")
    chunks = embed_hashed(chunk_items(items))
    grounded = answer.contexts(questions, items, chunks, ["info"], Knobs(metric="cosine"))
    first = grounded.filter("query_id = 0").first()
    assert first.sql_context.startswith("[info:who#0]\nwho uses this") and first.answer_context == "[info:who#0]\nwho uses this"
    proposed = answer.propose(grounded, "users(name string)", lambda: model)
    got = {r.query_id: r for r in answer.answer(proposed, lambda: model, limit=2).collect()}
    assert got[0].answer == "read 2 rows" and got[0].draft == 'Found first 2 of 3 rows. Example: {"name":"c"}'
    assert got[4].clean_sql == got[0].clean_sql == "SELECT name FROM users ORDER BY name DESC"
    assert got[1].reason.startswith("Only SELECT") and got[1].answer is None
    assert "nope" in got[2].reason and got[2].answer is None
    assert "DIVIDE_BY_ZERO" in got[5].reason and got[5].answer is None
    assert got[3].answer == "No model answer was produced." and got[3].draft == "Found 0 rows. Example: {}"


def test_the_stand_in_model(spark):
    spark.createDataFrame([("x", "USA"), ("y", "PE")], "name string, country string").createOrReplaceTempView("users")
    grounded = spark.createDataFrame([(1, "q", None, None)], "query_id long, question string, sql_context string, answer_context string")
    row = answer.answer(answer.propose(grounded, None)).first()
    assert row.clean_sql == "SELECT name FROM users WHERE country = 'USA'"
    assert row.draft == 'Found 1 rows. Example: {"name":"x"}'


def test_all_rows_are_counted_and_worded(spark):
    spark.range(2500).repartition(7).createOrReplaceTempView("many")
    sql = "SELECT id AS k, id % 7 AS r FROM many ORDER BY id DESC"
    grounded = spark.createDataFrame([(1, "q", None, None)], "query_id long, question string, sql_context string, answer_context string")

    def model(texts):
        return [f"{t.count('--- Row')} rows" if t.startswith(prompts.ANSWER_INSTRUCTIONS) else sql for t in texts]

    answers, rows = answer.answer_with_rows(answer.propose(grounded, None, lambda: model), lambda: model)
    got = answers.first()
    assert got.draft == 'Found 2500 rows. Example: {"k":2499,"r":0}' and got.answer == "2500 rows"
    found = rows.orderBy("row_ix").collect()
    assert [(r.row_ix, r.cells) for r in found] == [(i + 1, [str(2499 - i), str((2499 - i) % 7)]) for i in range(2500)]
    assert found[0].headers == ["k", "r"]


def test_segments_are_the_text_in_bounded_cells(spark):
    """Long rows and many rows, two groups; a segment has at most its size and one piece."""
    rows = [("a", i, f"row {i} " + "é" * (i % 9)) for i in range(1, 5000)] + [("b", 1, "x" * 100_000), ("b", 2, "漢" * 40_000), ("b", 3, "end")]
    frame = spark.createDataFrame(rows, "g string, row_ix long, block string").repartition(7)
    found = results.text_segments(frame, ["g"], 2_000).orderBy("g", "segment").collect()
    for group in ("a", "b"):
        own = [r for r in found if r.g == group]
        assert "".join(r.text for r in own) == "".join(b for g, _, b in rows if g == group)
        assert [r.start for r in own] == [0, *(r.stop for r in own[:-1])]
        assert all(r.stop - r.start == len(r.text.encode()) <= 2_000 + 3 * results.PIECE_CHARS for r in own)
        assert [r.segment for r in own] == sorted({r.start // 2_000 for r in own})
    assert results.text_segments(frame.limit(0), ["g"]).count() == 0


def test_offsets_over_spans_of_runs(spark, monkeypatch):
    monkeypatch.setattr(results, "RUN_ROWS", 3)
    monkeypatch.setattr(results, "RUNS_ADDED", 4)
    frame = spark.range(1, 101).selectExpr("'g' AS g", "id AS row_ix", "concat(id, ';') AS block")
    found = results.text_segments(frame, ["g"], 20).orderBy("segment").collect()
    assert "".join(r.text for r in found) == "".join(f"{i};" for i in range(1, 101)) and found[-1].stop == 292


def test_a_model_may_read_parts(spark):
    def load():
        return lambda parts: " ".join(str(len(p)) for p in parts)

    parts = spark.createDataFrame([(q, s, "x" * (s + 1)) for q in (1, 2, 3) for s in range(q * 2)], "query_id long, segment long, text string").repartition(5)
    got = {r.query_id: r.reply for r in complete_parts(parts, reads_parts(load)).collect()}
    assert got == {q: " ".join(str(s + 1) for s in range(q * 2)) for q in (1, 2, 3)}
    whole = {r.query_id: r.reply for r in complete_parts(parts, lambda: lambda texts: [str(len(t)) for t in texts]).collect()}
    assert whole == {1: "3", 2: "10", 3: "21"}


@pytest.mark.parametrize("by_part", [False, True])
def test_long_results(spark, monkeypatch, by_part):
    """A text of rows that is too long to put together reaches only a model that reads parts; the others are told why."""
    monkeypatch.setattr(answer, "MOST_PROMPT_BYTES", 10_000)
    spark.range(2000).createOrReplaceTempView("many")
    sql = "SELECT id AS k FROM many ORDER BY id"
    rows = [(1, "q", sql, True, None, [], None, None), (2, "q", "SELECT 7 AS k", True, None, [], None, "ctx")]
    proposed = spark.createDataFrame(rows, "query_id long, question string, clean_sql string, allowed boolean, reason string, warnings array<string>, sql_context string, answer_context string")

    def whole():
        return lambda texts: [f"{t.count('--- Row')} rows" for t in texts]

    @reads_parts
    def in_parts():
        return lambda parts: f"{sum(p.count('--- Row') for p in parts)} rows"

    answers, found = answer.answer_with_rows(proposed, in_parts if by_part else whole)
    got = {r.query_id: r for r in answers.collect()}
    assert got[2].answer == "1 rows" and got[2].reason is None and found.count() == 2001
    assert got[1].draft == 'Found 2000 rows. Example: {"k":0}'
    if by_part:
        assert got[1].answer == "2000 rows" and got[1].reason is None
    else:
        assert got[1].answer is None and "bytes, more than a model takes" in got[1].reason
