"""Prompt texts built from ranked chunks, rows and schema text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import citation, strip

# Wording that readers of the prompts depend on.
HEADER = "Use only the facts below. If something is missing, say so."
FOOTER = "Answer succinctly; cite sources like [kind:name#ix] when you use them."
CONTEXT_MARK = "\n--- Retrieved context ---"
INSTRUCTION_MARK = "\n--- Instructions ---"
NOTHING = "(none)"
NO_SCHEMA = "(schema omitted)"
SQL_INSTRUCTIONS = (
    "You are an expert data analyst producing a single, safe PostgreSQL SELECT query.\n"
    "- Only output a single SQL statement; no explanations.\n"
    "- Use existing columns; do not invent.\n"
    "- Prefer LIMIT 100 unless the question requests exact counts.\n"
)
SQL_QUESTION = "User Provided question you are meant to answer: "
SQL_SCHEMA = " \n\nSchema of tables:\n"
SQL_CONTEXT = (
    "\n\nContext from RAG, the Examples below teach structure only. Do not copy any literal values from them "
    "unless explicitly provided by the user; prefer user-provided values and schema grounding:\n"
)
ANSWER_INSTRUCTIONS = (
    "You are a data assistant. Given a natural language question and the result rows (JSON), the result of the "
    "relvant SQL question is given to you for you to use, write a short, clear answer in one or two sentences. "
    "Do not talk about SQL in your answer you are not meant to create queries.\n\n"
)
DRAFT_INSTRUCTIONS = (
    "You are a data assistant. Given a natural language question, the SQL used, and the result rows (JSON), "
    "write a short, clear answer in one or two sentences.\n\n"
)
# Fixed value: what stands in for a blank reply.
NO_ANSWER = "No model answer was produced."


def context_prompt(
    ranked: DataFrame, header: str | None = HEADER, footer: str | None = FOOTER, cite: bool = True, mark: bool = True
) -> DataFrame:
    """(query_id, prompt) from ranked chunks; a question has at most its top-k rows here.

    ``mark`` writes the context line even without a header.
    """
    tag = citation(F.col("kind"), F.col("name"), F.col("chunk_ix")) if cite else F.lit("")
    part = F.concat(tag, F.lit("\n"), F.col("chunk_text")).alias("part")
    grouped = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part))).alias("_parts"))
    before = ([header.strip()] if header else []) + ([CONTEXT_MARK] if header or mark else [])
    after = [INSTRUCTION_MARK, footer.strip()] if footer else []
    lines = F.concat(
        F.array(*[F.lit(x) for x in before]).cast("array<string>"),
        F.transform("_parts", lambda x: x["part"]),
        F.array(*[F.lit(x) for x in after]).cast("array<string>"),
    )
    return grouped.select("query_id", F.array_join(lines, "\n\n").alias("prompt"))


def _or(col: Column, fallback: str) -> Column:
    return F.when(col.isNull() | (col == ""), F.lit(fallback)).otherwise(col)


def sql_prompt(question: Column, schema_text: Column, context: Column) -> Column:
    return F.concat(
        F.lit(SQL_INSTRUCTIONS + SQL_QUESTION),
        question,
        F.lit(SQL_SCHEMA),
        _or(schema_text, NO_SCHEMA),
        F.lit(SQL_CONTEXT),
        _or(context, NOTHING),
        F.lit("\n"),
    )


def answer_head(question: Column) -> Column:
    """What stands before the rows' text in the prompt for an answer."""
    return F.concat(F.lit(ANSWER_INSTRUCTIONS + "Question: "), question, F.lit("\nSQL return statement: "))


def answer_tail(context: Column) -> Column:
    """What stands behind it."""
    return F.concat(F.lit("\nContext: "), _or(context, NOTHING))


def answer_prompt(question: Column, rows_text: Column, context: Column) -> Column:
    return F.concat(answer_head(question), rows_text, answer_tail(context))


# Fixed value: so many characters of the rows' JSON stand in the prompt for a draft.
DRAFT_CHARS = 4000


def draft_prompt(question: Column, sql: Column, rows_json: Column, chars: int | None = None) -> Column:
    """The prompt for a draft answer; ``chars`` bounds the rows' JSON where a model takes no more."""
    return F.concat(
        F.lit(DRAFT_INSTRUCTIONS + "Question: "),
        question,
        F.lit("\nSQL: "),
        sql,
        F.lit("\nRows JSON: "),
        rows_json if chars is None else F.substring(rows_json, 1, chars),
    )


def final_answer(answer: Column) -> Column:
    """A model's answer, or a fixed text when it is blank."""
    return F.when(F.coalesce(strip(answer), F.lit("")) == "", F.lit(NO_ANSWER)).otherwise(strip(answer))
