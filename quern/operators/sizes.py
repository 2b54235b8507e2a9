"""Broadcasts that are checked before they are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 500_000
SMALL_BYTES = 64 << 20


def is_small(keys: DataFrame) -> bool:
    """Whether the key table is proven small; counts at most ``SMALL_ROWS`` + 1 of its rows."""
    widths = [
        F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) if f.dataType.simpleString() == "string" else F.lit(8)
        for f in keys.schema.fields
    ]
    total = widths[0]
    for width in widths[1:]:
        total = total + width
    head = keys.limit(SMALL_ROWS + 1)
    seen = head.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(total), F.lit(0)).alias("size")).first()
    return seen["n"] <= SMALL_ROWS and seen["size"] <= SMALL_BYTES


def sent_if_small(keys: DataFrame) -> DataFrame:
    """The key table, marked for broadcast when it is proven small; otherwise Spark shuffles it."""
    return F.broadcast(keys) if is_small(keys) else keys
