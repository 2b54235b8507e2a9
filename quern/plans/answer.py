"""Questions to answers: grounded prompts, proposed statements, gated runs, worded rows."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.operators.chunks import complete_parts, complete_with, stand_in_model
from quern.operators.gate import gate
from quern.operators.nearest import prepare
from quern.plans import prompts, results, retrieve
from quern.plans.guarded import run_all
from quern.session import durable, scratch_path, staged


def contexts(
    questions: DataFrame,
    items: DataFrame,
    chunks: DataFrame,
    answer_kinds: Sequence[str],
    knobs: retrieve.Knobs = retrieve.Knobs(),
) -> DataFrame:
    """(query_id, question, sql_context, answer_context) from one candidate pass; null when nothing fits."""
    batch = prepare(questions)
    scored = retrieve.candidates(batch, items, chunks, knobs)
    both = retrieve.two_contexts(scored, answer_kinds, knobs=knobs)
    ranked = retrieve.with_text(batch, chunks, both, knobs.candidates)

    def text_of(name: str) -> DataFrame:
        found = prompts.context_prompt(ranked.filter(F.col("context") == name), None, None, mark=False)
        return found.withColumnRenamed("prompt", f"{name}_context")

    asked = questions.select("query_id", "question")
    return asked.join(text_of("sql"), "query_id", "left").join(text_of("answer"), "query_id", "left")


def propose(grounded: DataFrame, schema_text: str | None, load_model=stand_in_model) -> DataFrame:
    """One statement per grounded question, cleaned and gated: adds clean_sql, allowed, reason, warnings."""
    prompt = prompts.sql_prompt(F.col("question"), F.lit(schema_text).cast("string"), F.col("sql_context"))
    replies = complete_with(grounded.withColumn("prompt", prompt), load_model, "sql")
    return gate(replies.drop("prompt"))


_ROWS = "clean_sql string, headers array<string>, row_ix long, cells array<string>, block string, json string"
#: Statements that run side by side.
AT_ONCE = 4
#: Rows whose JSON one run adds up for a draft.
DRAFT_RUN = 16
#: The longest text of rows that is put together for a model that takes whole prompts.
MOST_PROMPT_BYTES = 16 << 20


def run_statements(spark: SparkSession, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of all statements, (clean_sql, headers, row_ix, cells, block, json), and (clean_sql, refusal).

    A statement that ran has a row 0 with its headers. Every statement writes a folder of its own; rows do
    not pass the driver. accepted: stmt_id (the statement), sql.
    """
    path = scratch_path(spark, "outcomes")
    spark.createDataFrame([], _ROWS).write.parquet(f"{path}/s=-1")  # the folder exists even when nothing runs

    def run(number: int, sql: str, rows: DataFrame) -> tuple[str, str | None]:
        try:
            found = results.packaged(results.returned(rows))
            head = spark.createDataFrame([(rows.columns, 0, None, None, None)], _ROWS.split(", ", 1)[1])
            found.unionByName(head).withColumn("clean_sql", F.lit(sql)).write.parquet(f"{path}/s={number}")
        except PySparkException as error:
            # A statement may also fail on the data; the others still run.
            return sql, str(error).splitlines()[0]
        return sql, None

    refusals, running = [], []
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for number, (sql, rows, _, refusal) in enumerate(run_all(spark, accepted)):
            if refusal is not None:
                refusals.append((sql, refusal))
                continue
            running.append(pool.submit(run, number, sql, rows))
            if len(running) > 2 * AT_ONCE:
                refusals.append(running.pop(0).result())
        refusals += [job.result() for job in running]
    refused = spark.createDataFrame([r for r in refusals if r[1] is not None], "clean_sql string, refusal string")
    return spark.read.schema(_ROWS).parquet(path), refused


def drafts(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(clean_sql, n, draft) of every statement that ran; rows: as of run_statements.

    The draft counts all rows and shows the first. Where the caller bounds what a model is to read, it says so.
    """
    counts = rows.groupBy("clean_sql").agg(
        F.count_if(F.col("row_ix") > 0).alias("n"), F.min_by("json", F.when(F.col("row_ix") > 0, F.col("row_ix"))).alias("first")
    )
    number = F.col("n").cast("string")
    if limit is not None:
        number = F.when(F.col("n") > limit, F.concat(F.lit(f"first {limit} of "), number)).otherwise(number)
    draft = F.concat(F.lit("Found "), number, F.lit(" rows. Example: "), F.coalesce("first", F.lit("{}")))
    return counts.select("clean_sql", "n", draft.alias("draft"))


def row_segments(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(clean_sql, segment, start, stop, text): the text of all rows, or of the first ``limit``, in bounded segments."""
    shown = rows.filter("row_ix > 0" if limit is None else f"row_ix BETWEEN 1 AND {int(limit)}")
    return results.text_segments(shown.select("clean_sql", "row_ix", "block"), ["clean_sql"])


def draft_prompts(asked: DataFrame, rows: DataFrame, chars: int = prompts.DRAFT_CHARS) -> DataFrame:
    """asked (query_id, question, clean_sql) with the prompt for a draft answer, which shows ``chars`` of the rows' JSON.

    Only as many rows are gathered as may stand in so many characters.
    """
    few = rows.filter(f"row_ix BETWEEN 1 AND {int(chars)}").select("clean_sql", "row_ix", F.substring("json", 1, chars).alias("json"))
    sized = few.withColumn("_run", F.floor(F.col("row_ix") / DRAFT_RUN))
    # A run begins too late when the runs before it, with a comma a row, have filled the characters.
    runs = sized.groupBy("clean_sql", "_run").agg(F.sum(F.length("json") + 1).alias("_n"))
    before = W.partitionBy("clean_sql").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)  # at most chars / DRAFT_RUN rows
    first = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < chars)
    listed = F.array_sort(F.collect_list(F.struct("row_ix", "json")))
    shown = sized.join(first, ["clean_sql", "_run"]).groupBy("clean_sql").agg(F.array_join(F.transform(listed, lambda x: x["json"]), ",").alias("_json"))
    held = F.concat(F.lit("["), F.coalesce("_json", F.lit("")), F.lit("]"))
    prompt = prompts.draft_prompt(F.col("question"), F.col("clean_sql"), held, chars)
    return asked.join(shown, "clean_sql", "left").select(*asked.columns, prompt.alias("prompt"))


def draft_with_model(asked: DataFrame, rows: DataFrame, load_model=stand_in_model, chars: int = prompts.DRAFT_CHARS) -> DataFrame:
    """asked with a model's draft of each answer, in place of the count and first row that drafts() gives."""
    return complete_with(draft_prompts(asked, rows, chars), load_model, "draft").drop("prompt")


def prompt_parts(asked: DataFrame, segments: DataFrame) -> DataFrame:
    """(query_id, segment, text): the prompts for answers, whose rows come in segments.

    asked: query_id, question, answer_context, clean_sql and n, the statement's rows.
    """
    shown = F.when(F.col("n") > 0, F.lit(results.ROWS_HEAD)).otherwise(F.lit(results.NO_DATA))
    head = asked.select("query_id", F.lit(-1).cast("long").alias("segment"), F.concat(prompts.answer_head(F.col("question")), shown).alias("text"))
    tail = asked.select("query_id", F.lit(2**62).alias("segment"), prompts.answer_tail(F.col("answer_context")).alias("text"))
    body = asked.select("query_id", "clean_sql").join(segments, "clean_sql").select("query_id", "segment", "text")
    return head.unionByName(body).unionByName(tail)


def answer_with_rows(proposed: DataFrame, load_model=stand_in_model, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The answers, and the rows of every statement that ran: (clean_sql, headers, row_ix, cells).

    answers: (query_id, question, clean_sql, reason, warnings, draft, answer) for every proposed statement.
    Equal statements run once. A statement that is refused, by the gate or by Spark, has a reason and
    no answer. ``limit`` bounds the rows that a model reads, not those that are run, counted and returned.
    The rows' text is kept in segments: a model that reads parts gets them one by one, whatever their number,
    and one that takes whole prompts is not asked about rows of more than MOST_PROMPT_BYTES.
    """
    spark = proposed.sparkSession
    # Kept, so that the model is asked once.
    kept = durable(proposed)
    accepted = kept.filter("allowed").select(F.col("clean_sql").alias("stmt_id"), F.col("clean_sql").alias("sql")).distinct()
    rows, refused = run_statements(spark, accepted)
    segments = staged(row_segments(rows, limit), "row-segments")
    sizes = segments.groupBy("clean_sql").agg(F.max("stop").alias("_size"))
    outcomes = drafts(rows, limit).join(sizes, "clean_sql", "left").join(refused, "clean_sql", "full")
    reason = F.coalesce("reason", "refusal")
    if not getattr(load_model, "reads_parts", False):
        too_long = F.concat(F.lit("The text of the rows has "), F.col("_size").cast("string"), F.lit(" bytes, more than a model takes at once."))
        reason = F.coalesce(reason, F.when(F.col("_size") > MOST_PROMPT_BYTES, too_long))
    known = kept.join(outcomes, "clean_sql", "left").withColumn("reason", reason)
    asked = known.filter(F.col("reason").isNull())
    answered = complete_parts(prompt_parts(asked, segments), load_model, "answer")
    final = known.join(answered, "query_id", "left").select(
        "query_id",
        "question",
        "clean_sql",
        "reason",
        "warnings",
        "draft",
        F.when(F.col("reason").isNull(), prompts.final_answer(F.col("answer"))).alias("answer"),
    )
    return final, rows.filter("row_ix > 0").select("clean_sql", "headers", "row_ix", "cells")


def answer(proposed: DataFrame, load_model=stand_in_model, limit: int | None = None) -> DataFrame:
    """The answers of answer_with_rows."""
    return answer_with_rows(proposed, load_model, limit)[0]
