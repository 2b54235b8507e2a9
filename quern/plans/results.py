"""Packaging a query's rows: cells, texts, drafts, and export documents.

Every form keeps one row per result row, so a result of any size stays distributed; a document is
the part files of its lines in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions.text import csv_cell
from quern.operators.ordering import number_returned, number_rows
from quern.sinks.files import flat

# Wording of the texts.
NO_DATA = "No data found for the query."
TEXT_PART_ROWS = 1000
#: A segment of a text begins within so many bytes; it ends with its last piece of so many characters.
SEGMENT_BYTES = 256 << 10
PIECE_CHARS = 16 << 10
#: Rows whose sizes one window adds up, and runs of them that the next one does.
RUN_ROWS = 1024
RUNS_ADDED = 4096
ROWS_HEAD = "The following data was retrieved from the database:\n\n"


def numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows with ``row_ix`` from 1 in the given total order, nested columns as JSON."""
    return number_rows(flat(rows), order)


def returned(rows: DataFrame) -> DataFrame:
    """All rows as the query returned them, numbered from 1 in ``row_ix``, nested columns as JSON."""
    return number_returned(flat(rows))


def _values(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c != "row_ix"]


def result_rows(rows: DataFrame) -> tuple[list[str], DataFrame]:
    """Headers, and (row_ix, cells) with the cells in header order."""
    headers = _values(rows)
    return headers, rows.select("row_ix", F.array(*[F.col(h).cast("string") for h in headers]).alias("cells"))


def row_blocks(rows: DataFrame, *more: Column) -> DataFrame:
    """(row_ix, block): the text of each numbered row, one ``column: value`` line per column."""
    lines = [F.concat(F.lit(f"{h}: "), F.coalesce(F.col(h).cast("string"), F.lit("null")), F.lit("\n")) for h in _values(rows)]
    head = F.concat(F.lit("--- Row "), F.col("row_ix").cast("string"), F.lit(" ---\n"))
    return rows.select("row_ix", F.concat(head, *lines, F.lit("\n")).alias("block"), *more)


def rows_text(rows: DataFrame, part_rows: int = TEXT_PART_ROWS) -> DataFrame:
    """(part, rows_text): the whole text in parts of bounded length, to be read one after another.

    A result under a row limit has one part. An empty result has one part that says so.
    """
    part = F.floor((F.col("row_ix") - 1) / part_rows).cast("long").alias("part")
    blocks = F.array_sort(F.collect_list(F.struct("row_ix", "block")))
    text = F.array_join(F.transform("_blocks", lambda x: x["block"]), "")
    head = F.when(F.col("part") == 0, F.lit(ROWS_HEAD)).otherwise(F.lit(""))
    texts = row_blocks(rows).groupBy(part).agg(blocks.alias("_blocks")).select("part", F.concat(head, text).alias("rows_text"))
    empty = rows.limit(1).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0)
    return texts.unionByName(empty.select(F.lit(0).cast("long").alias("part"), F.lit(NO_DATA).alias("rows_text")))


def text_segments(blocks: DataFrame, groups: Sequence[str], size: int = SEGMENT_BYTES) -> DataFrame:
    """(groups, segment, start, stop, text): the texts of the groups' rows, one after another, cut into segments.

    blocks: groups, row_ix, block. ``start`` and ``stop`` are bytes of the group's whole text, which is never
    put together: a segment has at most ``size`` bytes and one piece, however many rows and however long cells
    a result has. A long row is cut into pieces; the segments, read in order, are the text.
    """
    groups = list(groups)
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("block") / PIECE_CHARS).cast("int") - 1)),
        lambda i: F.substring(F.col("block"), i * PIECE_CHARS + 1, F.lit(PIECE_CHARS)),
    )
    pieces = blocks.select(*groups, "row_ix", F.posexplode(cut).alias("_piece", "text")).withColumns(
        {"_bytes": F.octet_length("text").cast("long"), "_run": F.floor(F.col("row_ix") / RUN_ROWS), "_span": F.floor(F.col("row_ix") / (RUN_ROWS * RUNS_ADDED))}
    )

    def before(total: str, over: Sequence[str], order: Sequence[str]) -> Column:
        window = W.partitionBy(*over).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(total).over(window), F.lit(0))

    runs = pieces.groupBy(*groups, "_span", "_run").agg(F.sum("_bytes").alias("_of_run"))
    spans = runs.groupBy(*groups, "_span").agg(F.sum("_of_run").alias("_of_span")).withColumn("_to_span", before("_of_span", groups, ["_span"]))
    runs = runs.withColumn("_to_run", before("_of_run", [*groups, "_span"], ["_run"])).join(spans, [*groups, "_span"])
    offset = F.col("_to_span") + F.col("_to_run") + before("_bytes", [*groups, "_span", "_run"], ["row_ix", "_piece"])
    placed = pieces.join(runs.select(*groups, "_span", "_run", "_to_run", "_to_span"), [*groups, "_span", "_run"]).withColumn("_at", offset)
    listed = F.array_sort(F.collect_list(F.struct("_at", "text")))
    segments = placed.groupBy(*groups, F.floor(F.col("_at") / size).alias("segment")).agg(
        F.min("_at").alias("start"), F.max(F.col("_at") + F.col("_bytes")).alias("stop"), listed.alias("_texts")
    )
    return segments.select(*groups, "segment", "start", "stop", F.array_join(F.transform("_texts", lambda x: x["text"]), "").alias("text"))


def draft_answer(rows: DataFrame) -> DataFrame:
    """One row: the number of rows, and the first row as JSON."""
    first = F.min_by(F.to_json(F.struct(*_values(rows))), F.col("row_ix"))
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(first, F.lit("{}")).alias("first"))
    return counted.select(
        F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" rows. Example: "), F.col("first")).alias("answer")
    )


def packaged(rows: DataFrame) -> DataFrame:
    """(headers, row_ix, cells, block, json) of numbered rows: every form of a result, a row per row."""
    headers = _values(rows)
    cells = F.array(*[F.col(h).cast("string") for h in headers]).alias("cells")
    shown = row_blocks(rows, cells, F.to_json(F.struct(*headers)).alias("json"))
    return shown.select(F.array(*[F.lit(h) for h in headers]).alias("headers"), "row_ix", "cells", "block", "json")


def _meta(spark: SparkSession, lines: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(
        [(0, i, line) for i, line in enumerate(lines)], "section int, line_ix long, line string"
    )


def csv_lines(
    rows: DataFrame, question: str, sql: str, answer: str, warnings: Sequence[str] = (), names: bool = False
) -> DataFrame:
    """(section, line_ix, line) of the export document: settings, a blank line, then the table.

    Rows are lists of cells, so the table is headed by cell numbers unless ``names`` is set.
    """
    spark = rows.sparkSession

    def cell(text: str) -> str:
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in '",\n') else text

    head = ["Section,Key,Value", f"Meta,Question,{cell(question)}", f"Meta,SQL,{cell(sql)}", f"Meta,Answer,{cell(answer)}"]
    head += [f"Meta,Warning {i},{cell(w)}" for i, w in enumerate(warnings, 1)]
    columns = _values(rows)
    titles = ",".join(cell(c) if names else str(i) for i, c in enumerate(columns))
    any_row = rows.limit(1).agg(F.count(F.lit(1)).alias("n"))
    table_head = any_row.select(
        F.lit(1).alias("section"),
        F.lit(0).cast("long").alias("line_ix"),
        F.when(F.col("n") > 0, F.lit(titles)).otherwise(F.lit("No rows")).alias("line"),
    )
    body = rows.select(
        F.lit(2).alias("section"),
        F.col("row_ix").alias("line_ix"),
        F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns]).alias("line"),
    )
    return _meta(spark, [*head, "", "Rows Table"]).unionByName(table_head).unionByName(body)


def json_lines(rows: DataFrame, question: str, sql: str, answer: str, warnings: Sequence[str] = ()) -> DataFrame:
    """(section, line_ix, line) of one JSON document whose ``rows`` are lists of cells."""
    spark = rows.sparkSession
    settings = spark.createDataFrame(
        [(question, sql, answer, list(warnings))], "question string, sql string, answer string, warnings array<string>"
    ).select(F.to_json(F.struct("*")).alias("j"))
    opening = settings.select(
        F.lit(0).alias("section"),
        F.lit(0).cast("long").alias("line_ix"),
        F.concat(F.substring("j", F.lit(1), F.length("j") - 1), F.lit(',"rows":[')).alias("line"),
    )
    cells = [F.regexp_extract(F.to_json(F.array(F.col(c))), r"(?s)^\[(.*)\]$", 1) for c in _values(rows)]
    comma = F.when(F.col("row_ix") > 1, F.lit(",")).otherwise(F.lit(""))
    body = rows.select(
        F.lit(1).alias("section"),
        F.col("row_ix").alias("line_ix"),
        F.concat(comma, F.lit("["), F.concat_ws(",", *cells), F.lit("]")).alias("line"),
    )
    closing = spark.createDataFrame([(2, 0, "]}")], "section int, line_ix long, line string")
    return opening.unionByName(body).unionByName(closing)
