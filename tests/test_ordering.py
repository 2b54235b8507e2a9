import pytest
from pyspark.sql import functions as F

from quern.operators import ordering as o


@pytest.mark.parametrize("position", [lambda i: i * i, lambda i: hash((i, 7)) % (1 << 62) - (1 << 61)], ids=["rising", "hashed"])
def test_dense_index_with_a_hot_group(spark, position):
    rows = [("hot" if i % 3 else f"g{i % 5}", position(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, p long").repartition(7)
    got = {(r.g, r.p): r.ix for r in o.dense_index_by(df, ["g"], "p", "ix").collect()}
    want = {}
    for group in {g for g, _ in rows}:
        for ix, p in enumerate(sorted(p for g, p in rows if g == group)):
            want[(group, p)] = ix
    assert got == want


def test_number_rows_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(9)
    got = sorted((r.row_ix, r.v) for r in o.number_rows(df, [F.desc("v")]).collect())
    assert got == [(i + 1, 999 - i) for i in range(1000)]
    assert o.number_rows(df.filter("v < 0"), [F.asc("v")]).count() == 0


def test_top_per_group_keeps_all_when_few(spark):
    df = spark.createDataFrame([("a", i, i % 4) for i in range(200)] + [("b", 1, 0)], "g string, id long, v long")
    got = [(r.g, r.id, r.rank) for r in o.top_per_group(df, ["g"], [F.desc("v"), F.asc("id")], 3, ["id"]).orderBy("g", "rank").collect()]
    assert got == [("a", 3, 1), ("a", 7, 2), ("a", 11, 3), ("b", 1, 1)]


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 1, "y")], "k string, s long, v string")
    first = {r.k: (r.s, r.v) for r in o.first_per_key(df, ["k"], [F.col("s")]).collect()}
    last = {r.k: (r.s, r.v) for r in o.first_per_key(df, ["k"], [F.col("s")], latest=True).collect()}
    assert first == {"a": (1, None), "b": (1, "y")} and last == {"a": (2, "x"), "b": (1, "y")}


def test_spread_out(spark):
    few = spark.range(100).coalesce(1)
    assert o.spread_out(few, "id").rdd.getNumPartitions() == 4
    many = spark.range(100).repartition(9)
    assert o.spread_out(many, "id") is many
