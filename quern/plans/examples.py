"""Grounding items made from the most frequent values of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.ordering import top_per_group


def column_examples(df: DataFrame, schema: str, table: str, columns: Sequence[str], n: int = 5) -> DataFrame:
    """(kind, name, body, metadata): the ``n`` most frequent values of each column, ties by value.

    Values are counted before the shuffle, so a value that fills a third of the rows stays cheap;
    columns with very many values are ranked in salted slices.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    counts = (
        df.select(pairs.alias("x"))
        .select("x.column_name", "x.value")
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = top_per_group(counts, ["column_name"], [F.desc("n"), F.asc("value")], n, ["value"])
    shown = F.concat(F.col("value"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("shown")
    listed = top.groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("rank", shown))).alias("_top"))
    name = F.concat(F.lit(f"{schema}.{table}."), F.col("column_name"))
    values = F.array_join(F.transform("_top", lambda x: x["shown"]), ", ")
    return listed.select(
        F.lit("example").alias("kind"),
        name.alias("name"),
        F.concat(F.lit("Frequent values of "), name, F.lit(": "), values, F.lit(".")).alias("body"),
        F.create_map(
            F.lit("schema"), F.lit(schema), F.lit("table"), F.lit(table), F.lit("column"), F.col("column_name")
        ).alias("metadata"),
    )
