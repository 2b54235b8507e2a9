import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.operators import sizes, upsert
from quern.operators.chunks import chunk_items, complete_with, embed_hashed, embed_with
from quern.plans import audit, prompts, retrieve
from quern.plans.commit import commit_entries
from quern.sinks import files
from quern.sources import store

def now():
    return F.lit("2024-06-01").cast("timestamp_ntz")


def _items(spark, rows):
    df = spark.createDataFrame(rows, "id long, kind string, name string, body string")
    then = F.lit("2024-01-01").cast("timestamp_ntz")
    return df.select("*", F.create_map(F.lit("a"), F.lit("1")).alias("metadata"), F.lit(1).alias("version"), then.alias("created_at"), then.alias("updated_at"))


def _incoming(spark, rows):
    return spark.createDataFrame(rows, "kind string, name string, body string, metadata map<string,string>, seq long")


def test_upsert_counts_every_arrival(spark):
    items = _items(spark, [(5, "info", "a", "old"), (7, "info", "b", "kept")])
    arrivals = [("info", "a", "v1", {"x": "1"}, 1), ("info", "a", "v3", {"x": "3"}, 3), ("info", "a", "v2", None, 2)]
    arrivals += [("key", "hot", f"h{i}", {}, i) for i in range(500)]
    got = {r.name: r for r in upsert.upsert_items(items, _incoming(spark, arrivals), now()).collect()}
    assert (got["a"].id, got["a"].body, got["a"].version, got["a"].metadata) == (5, "v3", 4, {"x": "3"})
    assert (got["b"].body, got["b"].version, str(got["b"].updated_at)) == ("kept", 1, "2024-01-01 00:00:00")
    assert (got["hot"].body, got["hot"].version) == ("h499", 500)
    assert str(got["a"].created_at) == "2024-01-01 00:00:00" and str(got["a"].updated_at) == "2024-06-01 00:00:00"


def test_large_key_sets_give_the_same_store(spark, monkeypatch):
    items = _items(spark, [(i, "info" if i % 3 else "key", f"n{i}", f"body {i}") for i in range(1, 200)])
    chunks = chunk_items(items)
    arrivals = _incoming(spark, [("info", f"n{i}", f"new {i}", {}, i) for i in range(100, 260) for _ in range(2)])

    def changed():
        new_items, new_chunks = commit_entries(arrivals, items, embed_hashed(chunks), embed_hashed, now())
        less_items, less_chunks = upsert.delete_items(new_items, new_chunks, items.filter("id < 50"))
        rows = sorted((r.kind, r.name, r.body, r.version) for r in less_items.collect())
        texts = sorted((n.name, c.chunk_text) for c, n in [(c, by_id[c.item_id]) for by_id in [{r.id: r for r in less_items.collect()}] for c in less_chunks.collect()])
        return rows, texts

    sent = changed()
    monkeypatch.setattr(sizes, "SMALL_ROWS", 0)
    assert changed() == sent and len(sent[0]) == len(sent[1])


def test_size_check(spark, monkeypatch):
    keys = spark.range(10).select(F.col("id").cast("string").alias("k"), "id")
    assert sizes.is_small(keys)
    monkeypatch.setattr(sizes, "SMALL_ROWS", 9)
    assert not sizes.is_small(keys)
    monkeypatch.setattr(sizes, "SMALL_ROWS", 10)
    monkeypatch.setattr(sizes, "SMALL_BYTES", 89)
    assert not sizes.is_small(keys)


def test_new_ids_are_unique_and_follow_the_highest(spark):
    items = _items(spark, [(10, "info", "a", "x")])
    arrivals = _incoming(spark, [("info", f"n{i}", "b", {}, 0) for i in range(3000)])
    ids = [r.id for r in upsert.upsert_items(items, arrivals, now()).collect()]
    assert sorted(ids) == list(range(10, 3011))


def test_delete_cascades_and_kinds_are_replaced(spark):
    items = _items(spark, [(1, "table", "t", "x"), (2, "info", "i", "y"), (3, "key", "k", "z")])
    chunks = chunk_items(items)
    left, left_chunks = upsert.delete_items(items, chunks, items.filter("id = 2"))
    assert sorted(r.id for r in left.collect()) == [1, 3] and sorted(r.item_id for r in left_chunks.collect()) == [1, 3]
    fresh = _items(spark, [(9, "table", "t2", "w")])
    got, got_chunks = upsert.replace_kinds(items, chunks, ["table", "key"], fresh, chunk_items(fresh))
    assert sorted(r.id for r in got.collect()) == [2, 9] and sorted(r.item_id for r in got_chunks.collect()) == [2, 9]


def test_commit_gives_an_empty_body_one_chunk(spark):
    items = _items(spark, [(1, "info", "a", "x" * 1600)])
    new_items, chunks = commit_entries(_incoming(spark, [("info", "a", "", {}, 0)]), items, embed_hashed(chunk_items(items)), embed_hashed, now())
    assert [(r.item_id, r.chunk_ix, r.chunk_text) for r in chunks.collect()] == [(1, 0, "")]


def test_chunks_that_carry_their_kind(spark, tmp_path):
    items = _items(spark, [(1, "table", "t", "x"), (2, "info", "i", "y"), (3, "info", "j", "z")])
    items = items.withColumn("metadata", F.create_map(F.lit("dataset"), F.concat(F.lit("d"), F.col("id").cast("string"))))
    with_kind, plain = chunk_items(items, with_kind=True), chunk_items(items)
    knobs = retrieve.Knobs(kinds=["info", "table"], dataset="d2")
    for chunks in (with_kind, plain):
        assert sorted(r.item_id for r in retrieve.eligible_chunks(items, chunks, knobs).collect()) == [1, 2]
    _, chunks = commit_entries(_incoming(spark, [("info", "i", "new", {"dataset": "d9"}, 0)]), items, embed_hashed(with_kind), embed_hashed, now())
    assert {(r.item_id, r.kind, r.dataset) for r in chunks.collect()} == {(1, "table", "d1"), (2, "info", "d9"), (3, "info", "d3")}
    store.save_chunks(chunks, str(tmp_path / "chunks"))
    assert sorted(p.name for p in (tmp_path / "chunks").glob("kind=*")) == ["kind=info", "kind=table"]


def test_a_store_in_id_folders_can_be_changed(spark, tmp_path):
    items = _items(spark, [(1, "info", "a", "x"), (2000, "info", "b", "y" * 4000)])
    store.save_chunks(embed_hashed(chunk_items(items, with_kind=True)), str(tmp_path / "c0"), by_id=True)
    chunks = store.load(spark, str(tmp_path / "c0"))
    _, changed = commit_entries(_incoming(spark, [("info", "a", "new", {}, 0), ("key", "c", "z", {}, 1)]), items, chunks, embed_hashed, now())
    store.save_chunks(changed, str(tmp_path / "c1"))
    got = store.load(spark, str(tmp_path / "c1"))
    assert sorted((r.item_id, r.chunk_ix, r.id_folder) for r in got.collect()) == [(1, 0, 1), (2000, 0, 976), (2000, 1, 976), (2000, 2, 976), (2001, 0, 977)]


def test_save_and_load(spark, tmp_path):
    items = _items(spark, [(1, "table", "t", "x"), (2, "info", "i", "y")])
    store.save_items(items, str(tmp_path / "items"))
    store.save_chunks(embed_hashed(chunk_items(items)), str(tmp_path / "chunks"))
    loaded = store.load(spark, str(tmp_path / "items"))
    assert loaded.filter(store.kind_filter(["info"])).first().name == "i"
    assert store.load(spark, str(tmp_path / "chunks")).count() == 2
    with pytest.raises(Exception, match="exist"):
        store.save_items(items, str(tmp_path / "items"))


def test_audit_files(spark, tmp_path):
    items = _items(spark, [(1, "info", "b", "x" * 1501), (2, "info", "a", "")])
    chunks = embed_hashed(chunk_items(items).withColumn("created_at", now()))
    tmp_path = Path(audit.write_audit(items, chunks, str(tmp_path), now()))
    assert tmp_path.name == "audit-20240601T000000Z"
    later = now() + F.expr("INTERVAL 1 SECOND")
    assert audit.write_audit(items, chunks, str(tmp_path.parent), later) != str(tmp_path)
    header, first, *_ = "".join(p.read_text() for p in sorted((tmp_path / "items").glob("*.csv"))).splitlines()
    assert header.startswith("id,kind,name") and '"{""a"":""1""}"' in first
    snapshot = [json.loads(line) for p in sorted((tmp_path / "snapshot").glob("*.json")) for line in p.read_text().splitlines()]
    assert [(s["name"], s["chunk_count"], len(s["full_text"])) for s in snapshot] == [("a", 0, 0), ("b", 2, 1501)]
    assert [c["created_at"] for s in snapshot for c in s["chunks"]] == ["2024-06-01T00:00:00.000"] * 2
    width = json.loads("".join(p.read_text() for p in (tmp_path / "embedding").glob("*.json")))
    assert width["element_type"] == "float" and width["min_width"] == width["max_width"] and width["missing"] == 0
    totals = json.loads("".join(p.read_text() for p in (tmp_path / "totals").glob("*.json")))
    assert totals == {"items": 2, "chunks": 2, "missing_items": 1, "generated_at_utc": "20240601T000000Z"}
    assert [json.loads(x)["name"] for p in (tmp_path / "missing").glob("*.json") for x in p.read_text().splitlines()] == ["a"]


def test_empty_audit_csv_has_no_rows(spark, tmp_path):
    files.write_audit_csv(_items(spark, []), str(tmp_path / "none"), ["id"])
    assert "".join(p.read_text() for p in (tmp_path / "none").glob("*.csv")) == ""


def test_prompt_text_and_json_files(spark, tmp_path):
    rows = [(7, 1, "info", "n", 0, "first\ntext", 1, 0.1, 0.9), (7, 2, "info", "m", 1, "second", 2, 0.2, 0.8)]
    ranked = spark.createDataFrame(rows, "query_id long, item_id long, kind string, name string, chunk_ix int, chunk_text string, rank int, dist double, sim double")
    made = prompts.context_prompt(ranked)
    want = f"{prompts.HEADER}\n\n\n--- Retrieved context ---\n\n[info:n#0]\nfirst\ntext\n\n[info:m#1]\nsecond\n\n\n--- Instructions ---\n\n{prompts.FOOTER}"
    assert made.first().prompt == want
    plain = prompts.context_prompt(ranked, None, None, cite=False, mark=False).first().prompt
    assert plain == "\nfirst\ntext\n\n\nsecond"
    files.write_prompts(made, str(tmp_path / "prompts"))
    assert [json.loads(x) for p in (tmp_path / "prompts").glob("*.json") for x in p.read_text().splitlines()] == [{"query_id": 7, "prompt": want}]
    files.write_json(retrieve.final_json(ranked), str(tmp_path / "json"), ["query_id", "rank"])
    first = json.loads(json.loads("".join(p.read_text() for p in sorted((tmp_path / "json").glob("*.json"))).splitlines()[0])["json"])
    assert first == {"item_id": 1, "kind": "info", "name": "n", "chunk_ix": 0, "chunk_text": "first\ntext", "dist": 0.1, "sim": 0.9}


def test_model_slots(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "id long, chunk_text string").repartition(3)
    lengths = embed_with(df, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert {(r.id, r.embedding[0]) for r in lengths.collect()} == {(i, float(len(f"text {i}"))) for i in range(50)}
    with pytest.raises(Exception, match="no vector"):
        embed_with(df, lambda: lambda texts: [[] for _ in texts]).collect()
    asked = df.withColumnRenamed("chunk_text", "prompt")
    assert {r.reply for r in complete_with(asked).collect()} == {"SELECT name FROM users WHERE country = 'USA'"}
    loud = complete_with(asked, lambda: lambda texts: [t.upper() + "\n" for t in texts])
    assert {(r.id, r.reply) for r in loud.collect()} == {(i, f"TEXT {i}") for i in range(50)}


def test_draft_prompt_and_final_answer(spark):
    row = spark.range(1).select(
        prompts.draft_prompt(F.lit("q"), F.lit("s"), F.lit("r" * 5000), 4000), prompts.final_answer(F.lit(" \n")), prompts.final_answer(F.lit(" yes "))
    ).first()
    assert row[0].endswith("Question: q\nSQL: s\nRows JSON: " + "r" * 4000)
    assert (row[1], row[2]) == ("No model answer was produced.", "yes")
