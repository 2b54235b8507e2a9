"""File sinks. Ordered output is one folder of part files whose names follow the order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_audit_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Header and rows; no header when there are no rows."""
    rows = flat(df).orderBy(*order)
    as_they_are = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.option("header", not df.isEmpty()).options(**as_they_are).csv(path)


def write_json(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    (df.orderBy(*order) if order else df).write.option("ignoreNullFields", False).json(path)


def write_item_files(rows: DataFrame, path: str) -> None:
    """(kind, row_ix, body) as headerless one-column CSV, a folder ``kind=…`` per kind, in row order.

    Line feeds inside a body are quoted, and an empty body is written as an empty quoted cell.
    """
    placed = rows.repartitionByRange("kind", "row_ix").sortWithinPartitions("kind", "row_ix")
    options = {
        "escape": '"',
        "quoteAll": True,
        "emptyValue": "",
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }
    placed.select("kind", "body").write.partitionBy("kind").options(**options).csv(path)


def write_prompts(prompts: DataFrame, path: str) -> None:
    """(query_id, prompt) of all questions as JSON lines, by id: as few files as the prompts need."""
    write_json(prompts.select("query_id", "prompt"), path, ["query_id"])


def write_lines(lines: DataFrame, path: str) -> None:
    """(section, line_ix, line) as text; the part files together are the document."""
    lines.orderBy("section", "line_ix").select(F.col("line").alias("value")).write.text(path)
