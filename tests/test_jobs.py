"""The jobs as a user runs them, over one small store."""

import json

import pytest

from quern.__main__ import main
from quern.operators.chunks import chunk_items, embed_hashed
from quern.sources.store import load, save_chunks, save_items

ITEM = "id long, kind string, name string, body string, metadata map<string,string>, version int, created_at timestamp_ntz, updated_at timestamp_ntz"


@pytest.fixture()
def store(spark, tmp_path):
    rows = [(1, "table", "main.old", "Table old"), (2, "info", "info::ds::row::0", "first fact"), (3, "info", "info::ds::row::1", "second fact")]
    items = spark.createDataFrame([(i, k, n, b, {"dataset": "ds"}, 1, None, None) for i, k, n, b in rows], ITEM)
    save_items(items, str(tmp_path / "s0/items"))
    save_chunks(embed_hashed(chunk_items(items, with_kind=True)), str(tmp_path / "s0/chunks"))
    return tmp_path


def _at(path):
    return ["--items", str(path / "items"), "--chunks", str(path / "chunks")]


def _texts(path, pattern):
    return "".join(p.read_text() for p in sorted(path.glob(pattern)))


def test_sync_dry_run_then_apply(spark, store):
    (store / "info_items.csv").write_text("body\nfirst fact\nchanged fact\nthird fact\nthird fact\n")
    (store / "example_items.csv").write_text("body\nan example\n")
    common = ["sync", *_at(store / "s0"), "--dataset", "ds", "--dir", str(store), "--has-header", "--dedupe"]
    main([*common, "--export-current", str(store / "export"), "--audit-json", str(store / "dry")])
    assert _texts(store / "export/kind=info", "*.csv") == '"first fact"\n"second fact"\n'
    record = [json.loads(line) for line in _texts(store / "dry/record", "*.json").splitlines()]
    totals = next(r for r in record if r["kind"] is None)
    assert (totals["desired"], totals["current"], totals["creates"], totals["updates"], totals["deletes"]) == (4, 2, 2, 1, 0)
    assert totals["apply"] is False and totals["dataset"] == "ds"
    actions = [json.loads(line) for line in _texts(store / "dry/actions", "*.json").splitlines()]
    assert {(a["name"], a["action"], a["chunks"]) for a in actions} == {
        ("example::ds::row::0", "UPSERT", 1),
        ("info::ds::row::1", "UPSERT", 1),
        ("info::ds::row::2", "UPSERT", 1),
    }
    main([*common, "--apply", "--out", str(store / "s1")])
    got = {r.name: (r.body, r.version) for r in load(spark, str(store / "s1/items")).collect()}
    assert got["info::ds::row::1"] == ("changed fact", 2) and got["example::ds::row::0"] == ("an example", 1) and "main.old" in got
    assert load(spark, str(store / "s1/chunks")).count() == 5


def test_commit_retrieve_audit_and_schema(spark, store):
    (store / "new.csv").write_text('info,extra,"line one\nline two, quoted",dataset,other,topic,x\nbad\n')
    main(["commit", *_at(store / "s0"), "--file", str(store / "new.csv"), "--out", str(store / "s1")])
    extra = load(spark, str(store / "s1/items")).filter("name = 'extra'").first()
    assert [json.loads(x)["cells"] for x in _texts(store / "s1/rejects", "*.json").splitlines()] == [["bad"]]
    assert extra.body == "line one\nline two, quoted" and extra.metadata == {"dataset": "other", "topic": "x"}

    spark.createDataFrame([(1, "second fact"), (2, "Table old")], "query_id long, question string").write.parquet(str(store / "q"))
    out = ["--save-json", str(store / "json"), "--save-prompt", str(store / "prompt")]
    main(["retrieve", *_at(store / "s1"), "--questions", str(store / "q"), "--dataset", "ds", "--topk", "2", *out])
    lines = [json.loads(json.loads(line)["json"]) for line in _texts(store / "json", "*.json").splitlines()]
    assert [r["name"] for r in lines][::2] == ["info::ds::row::1", "main.old"] and "extra" not in {r["name"] for r in lines}
    saved = {r["query_id"]: r["prompt"] for r in map(json.loads, _texts(store / "prompt", "*.json").splitlines())}
    assert "[table:main.old#0]\nTable old" in saved[2]
    main(["retrieve", *_at(store / "s1"), "--questions", str(store / "q")])

    main(["index", *_at(store / "s1"), "--cells", "2", "--out", str(store / "cells")])
    for name, more in {"all": ["--index", str(store / "cells"), "--ivf-probes", "2"], "signs": ["--sign-tables", "64"]}.items():
        main(["retrieve", *_at(store / "s1"), "--questions", str(store / "q"), "--topk", "1", "--save-json", str(store / name), *more])
        found = [json.loads(json.loads(line)["json"])["name"] for line in _texts(store / name, "*.json").splitlines()]
        assert found == ["info::ds::row::1", "main.old"]

    main(["audit", *_at(store / "s1"), "--outdir", str(store / "audit")])
    (folder,) = (store / "audit").iterdir()
    assert json.loads(_texts(folder / "totals", "*.json"))["items"] == 4

    spark.range(5).write.parquet(str(store / "t"))
    main(["schema", *_at(store / "s1"), "--table", f"numbers={store / 't'}", "--key", "numbers(id)", "--out", str(store / "s2")])
    names = {r.name for r in load(spark, str(store / "s2/items")).collect()}
    assert "main.old" not in names and {"main.numbers", "main.numbers.id", "main.numbers.PRIMARY KEY.id", "extra"} <= names


def test_feed(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing/a.json").write_text('{"k":1,"n":1}\n{"k":1,"n":2}\n{"k":2,"n":1}\n')
    main(["feed", "--landing", str(tmp_path / "landing"), "--schema", "k long, n long", "--keys", "k", "--seq", "n", "--out", str(tmp_path / "out")])
    from quern.plans.feed import read_feed

    assert sorted((r.k, r.n) for r in read_feed(spark, str(tmp_path / "out"), "typed", ["k"], ["n"]).collect()) == [(1, 2), (2, 1)]


def test_out_is_needed_for_a_change(store):
    with pytest.raises(SystemExit):
        main(["commit", *_at(store / "s0"), "--file", "x"])
