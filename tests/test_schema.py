import pytest
from pyspark.sql import functions as F

from quern.operators.chunks import chunk_items, embed_hashed
from quern.operators.keys import check_foreign_key, check_primary_key
from quern.plans.examples import column_examples
from quern.plans.schema_grounding import DDL_HEAD, Key, ddl_snapshot, refresh_schema, schema_ddl, schema_items
from quern.sources.catalog import catalog_columns, session_tables

def now():
    return F.lit("2024-06-01").cast("timestamp_ntz")


def _tables(spark):
    people = spark.createDataFrame([(1, "a", 1), (2, "b", 9), (3, None, None)], "id long, name string, town int")
    towns = spark.createDataFrame([(1, "x"), (2, "y")], "town_id int, town string")
    return {("app", "people"): people, ("app", "towns"): towns, ("pg_catalog", "secret"): towns}


KEYS = [Key("app", "people", ("id",)), Key("app", "people", ("name",)), Key("app", "towns", ("town_id",)), Key("app", "people", ("town",), ("app", "towns"), ("town_id",))]


def test_items_of_a_schema(spark):
    got = {(r.kind, r.name): r.body for r in schema_items(spark, _tables(spark), KEYS).collect()}
    assert got == {
        ("table", "app.people"): "Table app.people has columns:\n- id (bigint)\n- name (string)\n- town (int)",
        ("table", "app.towns"): "Table app.towns has columns:\n- town_id (int)\n- town (string)",
        ("column", "app.people.id"): "Column app.people.id has type bigint.",
        ("column", "app.people.name"): "Column app.people.name has type string.",
        ("column", "app.people.town"): "Column app.people.town has type int.",
        ("column", "app.towns.town_id"): "Column app.towns.town_id has type int.",
        ("column", "app.towns.town"): "Column app.towns.town has type string.",
        ("key", "app.people.PRIMARY KEY.id"): "PRIMARY KEY on app.people column id.",
        ("key", "app.towns.PRIMARY KEY.town_id"): "PRIMARY KEY on app.towns column town_id.",
    }


def test_ddl_text(spark):
    ddl = {r.table_name: r.ddl for r in schema_ddl(catalog_columns(spark, _tables(spark))).collect()}
    assert ddl == {"people": "people(id bigint)\npeople(name string)\npeople(town int)", "towns": "towns(town_id int)\ntowns(town string)"}
    text = ddl_snapshot(catalog_columns(spark, _tables(spark))).first().schema_text
    assert text == DDL_HEAD + ddl["people"] + "\n" + ddl["towns"]
    with pytest.raises(ValueError):
        catalog_columns(spark, {})


def test_key_checks(spark):
    people, towns = _tables(spark)[("app", "people")], _tables(spark)[("app", "towns")]
    assert tuple(check_primary_key(people, ["id"]).first()) == (3, 0, 0, True)
    assert tuple(check_primary_key(people, ["name"]).first()) == (3, 1, 0, False)
    assert tuple(check_primary_key(people.unionByName(people), ["id"]).first()) == (6, 0, 3, False)
    assert tuple(check_primary_key(people.limit(0), ["id"]).first()) == (0, 0, 0, True)
    assert tuple(check_foreign_key(people, ["town"], towns, ["town_id"]).first()) == (2, 1, 1, False)


def test_refresh_replaces_only_schema_kinds(spark):
    rows = [(4, "table", "gone", "x"), (5, "info", "stays", "y")]
    items = spark.createDataFrame(rows, "id long, kind string, name string, body string").select(
        "*", F.create_map(F.lit("a"), F.lit("b")).alias("metadata"), F.lit(1).alias("version"), now().alias("created_at"), now().alias("updated_at")
    )
    new_items, new_chunks = refresh_schema(spark, _tables(spark), KEYS, items, embed_hashed(chunk_items(items)), embed_hashed, now())
    names = {r.name: r.id for r in new_items.collect()}
    assert "gone" not in names and names["stays"] == 5 and len(names) == 10 and len(set(names.values())) == 10
    assert {r.item_id for r in new_chunks.collect()} == set(names.values())


def test_examples_with_a_hot_value(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"v{i % 7}", i) for i in range(90)] + [(None, 1)], "c string, n long")
    got = {r.name: r.body for r in column_examples(df, "app", "t", ["c", "n"], 2).collect()}
    assert got["app.t.c"] == "Frequent values of app.t.c: hot (60), v0 (5)."
    assert got["app.t.n"] == "Frequent values of app.t.n: 1 (2), 0 (1)."


def test_session_tables_skips_views(spark):
    spark.range(3).createOrReplaceTempView("just_a_view")
    assert all(table != "just_a_view" for _, table in session_tables(spark))
