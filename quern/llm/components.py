"""Connected components of an edge table, by alternating star steps.

Each step hangs neighbours on their smallest one, as joins and minimum aggregates over edges, so no vertex
ever gathers its neighbours in one place; the edge table is written to the shared folder after every round.
It has settled when each component is a star around its least vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import discard, staged


def _least_neighbour(directed: DataFrame) -> DataFrame:
    """(u, v) with the least of u and its neighbours as m."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return directed.join(least.hint("shuffle_merge"), "u")  # at no size through the driver


def _turned(rows: DataFrame, *pairs) -> DataFrame:
    """The pairs (u, v) of every row that have two ends; an array, as a union would read and plan the rows once per pair."""
    made = F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs))
    return rows.select(F.explode(made).alias("e")).select("e.u", "e.v").where("u <> v")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _turned(edges, ("u", "v"), ("v", "u"))
    return _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    return _turned(_least_neighbour(_down(edges)), ("v", "m"), ("u", "m"))


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex either hangs on one smaller one or has others hang on it. edges: u > v, each once."""
    ends = F.array(F.struct(F.col("u").alias("w"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("w"), F.lit(0).alias("hangs")))
    roles = edges.select(F.explode(ends).alias("e")).groupBy("e.w").agg(F.sum("e.hangs").alias("hangs"), F.min("e.hangs").alias("least"))
    return roles.where("hangs > 1 or (hangs = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, label): every vertex of an edge with the least vertex it is connected to. edges: columns u, v."""
    now = staged(_down(edges).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        if _are_stars(now):
            break
        before, now = now, staged(_small_star(_large_star(now)).distinct(), "edges")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    named = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), "v"))
    return now.select(F.explode(named).alias("e")).select(F.col("e.u").alias("v"), F.col("e.v").alias("label")).distinct()
