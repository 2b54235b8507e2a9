"""Column expressions shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that part words in the query contracts.
BREAKS = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def whole_text(text: Column | str = "text") -> Column:
    """The whole text; a null counts as an empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, BREAKS), lambda w: w != "")


def remainder(key: Column, parts: int) -> Column:
    """crc32 of the key's text modulo parts, as the query contracts deal out folds."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def replace_columns(docs: DataFrame, *names: str) -> DataFrame:
    """docs without columns of the given names (in any case), which the caller is about to add."""
    taken = {n.lower() for n in names}
    return docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in taken])
