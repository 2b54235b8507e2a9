"""The statement gate: which texts are a single read-only query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import clean_sql, strip

# Refusal and warning texts, statements refused, words a query may begin with.
REFUSED = "Only SELECT queries are allowed by the guardrail."
NO_SELECT = "No SELECT found; query may not return rows."
DENIED = [
    "insert", "update", "delete", "drop", "alter", "truncate", "create", "execute",
    "merge", "copy", "grant", "revoke", "into",
]
OPENERS = ["select", "with", "values", "table", "from"]
# Functions that reach into the JVM, and file formats that can be read by path.
DENIED_CALLS = ["reflect", "java_method", "try_reflect"]
CALL_REFUSED = "A function of the statement is not allowed."
PATH_REFUSED = "Reading files by path is not allowed."
UNBALANCED = "The statement's parentheses do not match."
PATH_FORMATS = ["parquet", "json", "csv", "orc", "text", "avro", "binaryfile", "delta", "image", "libsvm", "xml", "jdbc"]

# Raw literals first: in them a backslash is no escape. The loops give nothing back, so long literals are fine.
_LITERAL = r"""\b[rR]'[^']*+'|\b[rR]"[^"]*+"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+\""""
_COMMENT = r"--[^\n]*+|/\*[\s\S]*?\*/"
_NAME = "`[^`]*+`"


def bare(sql: Column) -> Column:
    """The statement in lower case, its literals as ``''`` and its comments as a space; quoted names stay.

    What begins first is found first, so a quote inside a comment or a name opens no literal: names and
    comments are wrapped in marks, then comments go and names lose their marks.
    """
    plain = F.translate(sql, "\u0001\u0002\u0003", "   ")
    marked = F.regexp_replace(plain, rf"({_NAME})|({_COMMENT})|(?:{_LITERAL})", "\u0001$1\u0002$2\u0003")
    # A literal has left both groups empty.
    literal = F.replace(marked, F.lit("\u0001\u0002\u0003"), F.lit("''"))
    names = F.regexp_replace(literal, "\u0001(`[^`]*+`)\u0002\u0003", "$1")
    return F.lower(F.regexp_replace(names, "\u0001\u0002[^\u0003]*+\u0003", " "))


def _words(words: list[str]) -> str:
    return rf"\b(?:{'|'.join(words)})\b"


def balanced(plain: Column) -> Column:
    """Whether every parenthesis is closed, and none before it was opened."""
    step = lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
    begin = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("below"))
    marks = F.split(F.regexp_replace(plain, "[^()]+", ""), "")
    depth = lambda acc, c: acc["depth"] + step(c)
    end = F.aggregate(marks, begin, lambda acc, c: F.struct(depth(acc, c).alias("depth"), (acc["below"] | (depth(acc, c) < 0)).alias("below")))
    return (end["depth"] == 0) & ~end["below"]


def refusal(sql: Column, plain: Column, named: Column) -> Column:
    """Why a cleaned statement is refused, or null when it may run.

    Only a query can stand where a statement is run, inside FROM; so words that begin other statements
    are refused where a statement begins, and are column names elsewhere. plain: without literals,
    comments and quoted names; named: with quoted names. What a text cannot tell for sure is left to the
    parsed plan of an accepted statement, which is searched before it runs.
    """
    statements = F.filter(F.split(plain, ";"), lambda part: strip(part) != "")
    nested = r"\(\s*(?:insert\s+(?:into|overwrite)|delete\s+from|merge\s+into|update\s+\S+\s+set)\b"
    # Where a relation stands: a format before a quoted name, or a quoted class name before any name.
    clauses = _words(["where", "group", "order", "having", "limit", "select", "on", "using", "window", "union", "except", "intersect"])
    relation = rf"\b(?:from|join|table)\b[\s(]*(?:(?:(?!{clauses})[^();])*?,\s*)?"
    by_path = rf"{relation}(?:`?(?:{'|'.join(PATH_FORMATS)})`?\s*\.\s*[`'\"]|`[^`]*\.[^`]*`\s*\.\s*[`'\"])"
    script = r"\busing\s*''"
    calls = rf"(?:\b(?:{'|'.join(DENIED_CALLS)})`?|\bidentifier)\s*\("
    return (
        F.when(F.size(statements) == 0, F.lit("The statement is empty."))
        .when(F.size(statements) > 1, F.lit("Only a single statement is allowed."))
        .when(plain.rlike(rf"^[\s(;]*{_words(DENIED)}") | plain.rlike(nested) | plain.rlike(r"\binto\b"), F.lit(REFUSED))
        .when(~plain.rlike(rf"^[\s(;]*{_words(OPENERS)}"), F.lit(REFUSED))
        .when(named.rlike(calls) | named.rlike(script), F.lit(CALL_REFUSED))
        .when(named.rlike(by_path), F.lit(PATH_REFUSED))
        .when(~balanced(plain), F.lit(UNBALANCED))
    )


def gate(statements: DataFrame) -> DataFrame:
    """(stmt_id, sql) with clean_sql, allowed, reason and warnings. Row by row, without a shuffle."""
    cleaned = statements.withColumn("clean_sql", clean_sql(F.col("sql")))
    named = cleaned.withColumn("_named", bare(F.col("clean_sql")))
    plain = named.withColumn("_plain", F.regexp_replace(F.col("_named"), f"{_NAME}|''", " "))
    judged = plain.withColumn("reason", refusal(F.col("clean_sql"), F.col("_plain"), F.col("_named")))
    allowed = F.col("reason").isNull()
    no_select = allowed & ~F.col("_plain").rlike(r"\bselect\b")
    return judged.withColumn("allowed", allowed).withColumn(
        "warnings", F.when(no_select, F.array(F.lit(NO_SELECT))).otherwise(F.array().cast("array<string>"))
    ).drop("_plain", "_named")
