"""Vectors kept by text: what a model gets to see."""

import pytest
from pyspark.sql import functions as F

from quern.operators.chunks import chunk_items, embed_known, embed_with
from quern.plans import sync
from quern.sources import changes
from quern.sources.store import items_of

ITEM = "id long, kind string, name string, body string, metadata map<string,string>, version int, created_at timestamp_ntz, updated_at timestamp_ntz"


@pytest.fixture
def seen(tmp_path):
    """A model that writes down every text it is given."""
    log = tmp_path / "seen"
    log.mkdir()

    def load():
        import uuid

        def model(texts):
            (log / uuid.uuid4().hex).write_text("\n".join(texts))
            return [[float(len(t)), float(sum(map(ord, t)) % 97)] for t in texts]

        return model

    def texts():
        found = sorted(line for f in log.iterdir() for line in f.read_text().split("\n"))
        for f in log.iterdir():
            f.unlink()
        return found

    return load, texts


def test_a_text_reaches_a_model_once(spark, tmp_path, seen):
    load, texts = seen
    rows = [(i, "same" if i % 3 else f"text {i % 6}") for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "item_id long, chunk_text string").repartition(4)
    embed = lambda new: embed_with(new, load)
    path = str(tmp_path / "vectors")
    want = {r.item_id: r.embedding for r in embed_with(df.where("chunk_text is not null"), load).collect()}
    texts()
    got = embed_known(df, embed, path, "m")
    assert got.columns == ["item_id", "chunk_text", "embedding"]
    assert {r.item_id: r.embedding for r in got.collect()} == {**want, 60: None}
    assert texts() == sorted({"same", "text 0", "text 3", ""})
    more = df.unionByName(spark.createDataFrame([(70, "new"), (71, "same")], "item_id long, chunk_text string"))
    assert embed_known(more, embed, path, "m").where("embedding is not null").count() == 63
    assert texts() == ["new"]
    assert embed_known(more, embed, path, "m").count() == 64 and texts() == []
    embed_known(df, embed, path, "another").count()
    assert len(texts()) == 4
    assert embed_known(df.limit(0), embed, str(tmp_path / "none"), "m").count() == 0 and texts() == []


def test_two_syncs_embed_changed_texts_only(spark, tmp_path, seen):
    load, texts = seen
    embed = lambda df: embed_known(df, lambda new: embed_with(new, load), str(tmp_path / "vectors"), "m")
    path, now = str(tmp_path / "store"), F.lit("2024-06-01").cast("timestamp_ntz")
    none = spark.createDataFrame([], ITEM)
    changes.create(none, embed(chunk_items(none)), path)

    def step(bodies):
        items, _ = changes.read(spark, path)
        desired = sync.desired_rows(spark.createDataFrame([("info", i, b) for i, b in enumerate(bodies)], "kind string, row_ix long, body string"))
        plan = sync.plan_sync(desired, sync.current_rows(items_of(items, ["info"], "ds")))
        sync.change_store(spark, path, plan, desired, "ds", embed, now)
        items, chunks = changes.read(spark, path)
        held = {r.chunk_text: r.embedding[0] for r in chunks.collect()}
        assert held == {b: float(len(b)) for b in bodies}
        return texts()

    assert step(["one", "two", "two", "three"]) == ["one", "three", "two"]
    assert step(["two", "one", "two", "three", "four"]) == ["four"]
    assert step(["three"]) == []
