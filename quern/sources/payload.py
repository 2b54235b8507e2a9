"""Payload texts of a feed, as rows."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import strip

ROW = T.MapType(T.StringType(), T.StringType())
ROWS = T.ArrayType(ROW)


@F.pandas_udf(ROWS)
def _csv_rows(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    csv.field_size_limit(2**31 - 1)  # a cell may be as long as its text
    for batch in texts:
        yield pd.Series(
            [
                None
                if text is None
                else [{k: v for k, v in row.items() if k is not None} for row in csv.DictReader(io.StringIO(text))]
                for text in batch
            ],
            dtype=object,
        )


def payload_rows(payload: Column) -> Column:
    """The rows of a payload: a JSON list, one JSON object, or CSV text with a header line.

    Text that begins like JSON but is malformed is read as CSV. JSON stays inside the JVM; only the
    remaining texts go through Python, where a header may name any columns.
    """
    text = strip(payload)
    options = {"mode": "PERMISSIVE"}
    listed = F.when(text.startswith("["), F.from_json(text, ROWS, options))
    single = F.when(text.startswith("{"), F.from_json(text, ROW, options))
    as_csv = _csv_rows(F.when(listed.isNull() & single.isNull(), text))
    return F.coalesce(listed, F.when(single.isNotNull(), F.array(single)), as_csv)


def coerce_rows(df: DataFrame, payload: str, out: str = "record") -> DataFrame:
    """One output row per record of each payload, as map<string,string>; null payloads give none."""
    return df.withColumn(out, F.explode(payload_rows(F.col(payload)))).drop(payload)


def read_landing(spark: SparkSession, path: str, schema, fmt: str = "json", **options) -> DataFrame:
    """Files of a landing folder, read with a fixed schema so that nothing is inferred."""
    return spark.read.format(fmt).schema(schema).options(**options).load(path)
