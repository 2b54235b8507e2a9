"""Stores of generations: what a change writes, what readers see, and when generations are merged."""

import random

import pytest
from pyspark.sql import functions as F

from quern.__main__ import main
from quern.operators.chunks import chunk_items, embed_hashed
from quern.plans.commit import commit_entries, commit_to_store
from quern.plans.schema_grounding import Key, refresh_in_store, refresh_schema
from quern.sources import changes

ITEM = "id long, kind string, name string, body string, metadata map<string,string>, version int, created_at timestamp_ntz, updated_at timestamp_ntz"
ENTRY = "kind string, name string, body string, metadata map<string,string>, seq long"


def _items(spark, rows):
    return spark.createDataFrame([(i, k, n, b, {"dataset": "ds"}, 1, None, None) for i, k, n, b in rows], ITEM)


def _chunks(items):
    return embed_hashed(chunk_items(items, with_kind=True, keep_empty=True))


@pytest.fixture
def store(spark, tmp_path):
    items = _items(spark, [(i, "info", f"info::ds::row::{i}", f"text {i}") for i in range(1, 41)])
    changes.create(items, _chunks(items), str(tmp_path / "store"))
    return str(tmp_path / "store")


def _now():
    return F.lit("2024-06-01").cast("timestamp_ntz")


def _held(pair):
    items, chunks = pair
    return sorted((r.id, r.body) for r in items.collect()), sorted((r.item_id, r.chunk_text) for r in chunks.collect())


def _step(spark, path, model, rng, number):
    """A random change, applied to the store and to a plain dictionary."""
    changed = {rng.randrange(1, 60): f"text of {number}" for _ in range(rng.randrange(1, 5))}
    removed = set(rng.sample(sorted(model), 2)) - set(changed)
    items = _items(spark, [(i, "info", f"info::ds::row::{i}", b) for i, b in changed.items()])
    gone = spark.createDataFrame([(i,) for i in {*changed, *removed}], "item_id long")
    changes.change(spark, path, items, _chunks(items).select(*changes.read(spark, path)[1].columns), gone)
    model.update(changed)
    for i in removed:
        del model[i]


def test_settled_generations_read_the_same(spark, store, monkeypatch):
    monkeypatch.setattr(changes, "SMALLEST_BYTES", 1)
    rng, model = random.Random(1), {i: f"text {i}" for i in range(1, 41)}
    numbers = []
    for number in range(1, 10):
        _step(spark, store, model, rng, number)
        changes.settle(spark, store)
        numbers.append(len(changes.spans(spark, store)))
        if number % 3 == 0:
            items, chunks = _held(changes.read(spark, store))
            assert items == sorted(model.items()) and chunks == sorted(model.items())
    assert changes.generations(spark, store)[-1] == 9 and max(numbers) < 9
    assert any(last > first for first, last in changes.spans(spark, store))
    before = _held(changes.read(spark, store))
    changes.sweep(spark, store)
    assert _held(changes.read(spark, store)) == before
    changes.merge(spark, store, 0, 9)
    assert changes.spans(spark, store) == [(0, 9)] and _held(changes.read(spark, store)) == before
    assert spark.read.parquet(f"{store}/gone/gen=0-9").count() == 0


def test_ids_in_ranges_read_the_same_without_a_shuffle_of_rows(spark, store, monkeypatch):
    rng, model = random.Random(2), {i: f"text {i}" for i in range(1, 41)}
    for number in range(1, 4):
        _step(spark, store, model, rng, number)
    far = _items(spark, [(i * 1000, "info", f"far {i}", f"far {i}") for i in range(1, 30)])
    changes.change(spark, store, far, _chunks(far).select(*changes.read(spark, store)[1].columns), far.select(F.col("id").alias("item_id")))
    gone = spark.createDataFrame([(i * 1000,) for i in range(5, 20)], "item_id long")
    changes.change(spark, store, far.limit(0), changes.read(spark, store)[1].limit(0), gone)
    want = sorted([*model.items(), *((i * 1000, f"far {i}") for i in [*range(1, 5), *range(20, 30)])])
    assert _held(changes.read(spark, store))[1] == want
    monkeypatch.setattr(changes, "SENT_WORDS", 6)
    items, chunks = changes.read(spark, store)
    assert len(changes._ranges(changes._bit_maps(changes._gone(spark, store, changes.spans(spark, store))))) > 3
    assert _held((items, chunks)) == (want, want)
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan


def test_commit_writes_changed_rows_only(spark, store):
    entries = spark.createDataFrame([("info", "info::ds::row::3", "other", {"a": "b"}, 0), ("info", "fresh", "", None, 1), ("info", "info::ds::row::3", "last", None, 2)], ENTRY)
    whole = commit_entries(entries, *changes.read(spark, store), embed_hashed, _now())
    want = sorted((r.name, r.body, r.version) for r in whole[0].collect()), sorted((r.item_id, r.chunk_text) for r in whole[1].collect())
    assert commit_to_store(spark, store, entries, embed_hashed, _now()) == 1
    assert spark.read.parquet(f"{store}/items/gen=1").count() == spark.read.parquet(f"{store}/chunks/gen=1").count() == 2
    items, chunks = changes.read(spark, store)
    assert (sorted((r.name, r.body, r.version) for r in items.collect()), sorted((r.item_id, r.chunk_text) for r in chunks.collect())) == want


def test_schema_writes_changed_items_only(spark, store):
    tables = {("main", "a"): spark.range(5).withColumn("x", F.lit("t")), ("main", "b"): spark.range(3)}
    keys = [Key("main", "b", ("id",))]
    show = lambda pair: sorted((r.kind, r.name, r.body, str(r.metadata)) for r in pair[0].collect())
    refresh_in_store(spark, store, tables, keys, embed_hashed, _now())
    first = changes.read(spark, store)
    assert show(first) == show(refresh_schema(spark, tables, keys, *first, embed_hashed, _now()))
    refresh_in_store(spark, store, tables, keys, embed_hashed, _now())
    assert spark.read.parquet(f"{store}/items/gen=2").count() == spark.read.parquet(f"{store}/gone/gen=2").count() == 0
    tables[("main", "a")] = spark.range(5).withColumn("x", F.lit(1))
    del tables[("main", "b")]
    refresh_in_store(spark, store, tables, [], embed_hashed, _now())
    written = {r.name for r in spark.read.parquet(f"{store}/items/gen=3").collect()}
    assert written and all("main.a" in name for name in written) and "main.a.id" not in written
    last = changes.read(spark, store)
    assert show(last) == show(refresh_schema(spark, tables, [], *last, embed_hashed, _now()))
    ids = sorted(r.item_id for r in last[1].select("item_id").distinct().collect())
    assert ids == sorted(r.id for r in last[0].collect())


def test_jobs_change_the_store_in_place(spark, store, tmp_path):
    (tmp_path / "info_items.csv").write_text("text 1\n\"text\n2\"\n")
    common = ["sync", "--store", store, "--dataset", "ds", "--dir", str(tmp_path), "--desired", "info"]
    main(common)
    assert changes.generations(spark, store) == [0]
    main([*common, "--apply"])
    assert {r.body for r in changes.read(spark, store)[0].collect()} == {"text 1", "text\n2"}
    (tmp_path / "new.csv").write_text("info,extra,one\nbad\ninfo,open,\"never closed\n")
    main(["commit", "--store", store, "--file", str(tmp_path / "new.csv"), "--rejects", str(tmp_path / "rejects")])
    assert {r.body for r in changes.read(spark, store)[0].collect()} == {"text 1", "text\n2", "one"}
    assert {r.reason for r in spark.read.json(str(tmp_path / "rejects")).collect()} == {"too few cells", "unclosed quote"}
    spark.range(3).write.parquet(str(tmp_path / "t"))
    main(["schema", "--store", store, "--table", f"n={tmp_path / 't'}"])
    assert "main.n" in {r.name for r in changes.read(spark, store)[0].collect()}
    main(["store", "--store", store, "--out", str(tmp_path / "whole")])
    assert _held(changes.read(spark, str(tmp_path / "whole"))) == _held(changes.read(spark, store))
    with pytest.raises(SystemExit):
        main(["commit", "--store", store, "--file", "x"])
    with pytest.raises(SystemExit):
        main(["audit", "--outdir", "x"])
