"""Vectors as column expressions: distances, text form, and an offline stand-in embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import let

DIMS = 64
# Components are multiples of 1/STEPS, so sums of products are exact in any order of addition.
STEPS = 1024


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of one pair, for joins that already pair rows."""
    return F.sqrt(
        _total(
            F.zip_with(
                a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
            )
        )
    )


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def similarity(dist: Column) -> Column:
    return 1 - dist


def vector_text(vec: Column) -> Column:
    """``[x.xxxxxxxx,...]`` with eight decimals."""
    parts = F.transform(vec, lambda x: F.format_string("%.8f", x.cast("double")))
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def hash_embedding(text: Column, dims: int = DIMS) -> Column:
    """Bag of hashed words at unit length: deterministic, offline, and no semantic model.

    Stays in the row: no explode, no shuffle. Text without words gives the zero vector.
    """
    words = F.filter(F.split(F.lower(text), r"[ \t\r\n]+"), lambda w: w != "")
    buckets = F.transform(
        words,
        lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int"),
    )

    def counts(found: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda i: F.size(found) - F.size(F.array_remove(found, i)),
        )

    def scaled(hits: Column) -> Column:
        squares = F.aggregate(hits, F.lit(0).cast("long"), lambda total, x: total + x.cast("long") * x.cast("long"))
        return let(
            F.greatest(F.sqrt(squares.cast("double")), F.lit(1.0)),
            lambda norm: F.transform(
                hits, lambda x: (F.floor(x / norm * STEPS + F.lit(0.5)) / F.lit(float(STEPS))).cast("float")
            ),
        )

    return let(buckets, lambda found: let(counts(found), scaled))
