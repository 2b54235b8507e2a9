import csv

import pytest
from pyspark.sql import functions as F

from quern.functions.text import row_name
from quern.operators.chunks import chunk_items, embed_hashed
from quern.plans import sync
from quern.sinks.files import write_item_files
from quern.sources.csv_items import first_by_text, ragged_entries, read_item_files, read_ragged
from quern.sources import changes
from quern.sources.store import items_of

ITEM = "id long, kind string, name string, body string, metadata map<string,string>, version int, created_at timestamp_ntz, updated_at timestamp_ntz"


def _rows(df):
    return sorted((r.kind, r.row_ix, r.body) for r in df.collect())


def test_item_file_like_a_spreadsheet_writes_it(spark, tmp_path):
    path = tmp_path / "info_items.csv"
    path.write_bytes('﻿body,note\r\n first ,x\r\n"two\nlines, ""quoted""",y\r\n   ,blank\r\n\r\n,empty\r\nlast\r\n'.encode())
    got = _rows(read_item_files(spark, {"info": str(path)}, has_header=True))
    assert got == [("info", 0, "first"), ("info", 1, 'two\nlines, "quoted"'), ("info", 2, "last")]
    assert _rows(read_item_files(spark, {"info": str(path)}))[0] == ("info", 0, "body")


def test_kinds_are_numbered_apart_and_files_in_name_order(spark, tmp_path):
    for kind, names in {"info": ["part-00002.csv", "part-00010.csv", "part-100000.csv"], "example": ["a.csv"]}.items():
        (tmp_path / kind).mkdir()
        for name in names:
            (tmp_path / kind / name).write_text(f"{name} 1\n{name} 2\n")
    paths = {k: str(tmp_path / k) for k in ("info", "example")}
    for multiline in (True, False):
        got = _rows(read_item_files(spark, paths, multiline=multiline))
        assert [b for k, _, b in got if k == "info"] == [f"part-{n}.csv {i}" for n in ("00002", "00010", "100000") for i in (1, 2)]
        assert [r[1] for r in got] == [0, 1, 0, 1, 2, 3, 4, 5]


def test_large_file_is_split_and_keeps_its_order(spark, tmp_path):
    (tmp_path / "info.csv").write_text("".join(f"row {i}\n" for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        got = _rows(read_item_files(spark, {"info": str(tmp_path / "info.csv")}, multiline=False))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [("info", i, f"row {i}") for i in range(20000)]


def test_dedupe_keeps_the_first_of_a_hot_text(spark):
    bodies = [(i, "same " if i % 3 else f"text {i}") for i in range(300)] + [(300, "same\r\n")]
    df = spark.createDataFrame([("info", i, b) for i, b in bodies], "kind string, row_ix long, body string")
    want = [b for i, b in bodies if b.startswith("text") or i == 1]
    assert [b for _, _, b in _rows(first_by_text(df))] == want
    assert [ix for _, ix, _ in _rows(first_by_text(df))] == list(range(len(want)))


def test_export_round_trip(spark, tmp_path):
    rows = [("info", 0, 'a "b", c'), ("info", 2, "two\nlines"), ("key", 1, "é ")]
    df = spark.createDataFrame(rows, "kind string, row_ix long, body string")
    write_item_files(sync.export_rows(df), str(tmp_path / "out"))
    for kind, want in {"info": ['a "b", c', "", "two\nlines"], "key": ["", "é "]}.items():
        cells = []
        for part in sorted((tmp_path / "out" / f"kind={kind}").glob("*.csv")):
            with open(part, newline="", encoding="utf-8") as f:
                cells += [r[0] if r else "" for r in csv.reader(f)]
        assert cells == want
    back = read_item_files(spark, {k: str(tmp_path / "out" / f"kind={k}") for k in ("info", "key")})
    assert [b for _, _, b in _rows(back)] == ['a "b", c', "two\nlines", "é"]


def _store(spark, rows):
    df = spark.createDataFrame(rows, "id long, kind string, row_ix long, body string")
    items = df.select(
        "id",
        "kind",
        row_name(F.col("kind"), F.lit("ds"), F.col("row_ix")).alias("name"),
        "body",
        F.create_map(F.lit("dataset"), F.lit("ds")).alias("metadata"),
        F.lit(3).alias("version"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"),
    )
    return items, embed_hashed(chunk_items(items))


def test_plan_apply_and_plan_again(spark):
    items, chunks = _store(spark, [(1, "info", 0, "keep"), (2, "info", 1, "old"), (3, "info", 5, "gone"), (4, "key", 0, "same\r\n"), (9, "info", 7, "void")])
    wanted = [("info", 0, "keep"), ("info", 1, "x" * 1600), ("info", 2, "new"), ("info", 7, "  "), ("key", 0, "same")]
    desired = sync.desired_rows(spark.createDataFrame(wanted, "kind string, row_ix long, body string"))
    current = sync.current_rows(items_of(items, ["info", "key"], "ds"))
    plan = sync.plan_sync(desired, current)
    got = {(r.kind, r.row_ix): r.action for r in plan.collect()}
    assert got == {("info", 0): "KEEP", ("info", 1): "UPDATE", ("info", 2): "CREATE", ("info", 5): "DELETE", ("info", 7): "DELETE", ("key", 0): "KEEP"}
    counts = {r.kind: (r.desired, r.current, r.creates, r.updates, r.deletes) for r in sync.sync_counts(plan).collect()}
    assert counts == {"info": (3, 4, 1, 1, 2), "key": (1, 1, 0, 0, 0), None: (4, 5, 1, 1, 2)}
    now = F.lit("2024-06-01").cast("timestamp_ntz")
    new_items, new_chunks = sync.apply_sync(plan, desired, items, chunks, "ds", embed_hashed, now)
    versions = {r.name: (r.id, r.version) for r in new_items.collect()}
    assert {n: v for n, (_, v) in versions.items()} == {"info::ds::row::0": 3, "info::ds::row::1": 4, "info::ds::row::2": 1, "key::ds::row::0": 3}
    assert versions["info::ds::row::1"][0] == 2 and versions["info::ds::row::2"][0] > 4
    by_item = {r.item_id: r.n for r in new_chunks.groupBy("item_id").agg(F.count("*").alias("n")).collect()}
    assert by_item == {1: 1, 2: 2, versions["info::ds::row::2"][0]: 1, 4: 1}
    again = sync.plan_sync(desired, sync.current_rows(items_of(new_items, ["info", "key"], "ds")))
    assert {r.action for r in again.collect()} == {"KEEP"}


def test_a_change_writes_changed_rows_only(spark, tmp_path):
    items, chunks = _store(spark, [(i, "info", i, f"text {i}") for i in range(50)])
    path = str(tmp_path / "store")
    changes.create(items, chunks, path)
    now = F.lit("2024-06-01").cast("timestamp_ntz")

    def step(wanted):
        held, parts = changes.read(spark, path)
        desired = sync.desired_rows(spark.createDataFrame(wanted, "kind string, row_ix long, body string"))
        plan = sync.plan_sync(desired, sync.current_rows(items_of(held, ["info"], "ds")))
        whole = sync.apply_sync(plan, desired, held, parts, "ds", embed_hashed, now)
        number = sync.change_store(spark, path, plan, desired, "ds", embed_hashed, now)
        after = changes.read(spark, path)
        for got, want, key in zip(after, whole, (["name", "body", "version"], ["item_id", "chunk_ix", "chunk_text"])):
            assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
        return number

    rows = [("info", i, f"text {i}") for i in range(50)]
    assert step(rows[:7] + [("info", 7, "other")] + rows[8:]) == 1
    assert spark.read.parquet(f"{path}/items/gen=1").count() == spark.read.parquet(f"{path}/chunks/gen=1").count() == 1
    assert step(rows[:7] + [("info", 7, "third"), ("info", 60, "new")] + rows[9:]) == 2
    assert spark.read.parquet(f"{path}/items/gen=2").count() == 2 and spark.read.parquet(f"{path}/gone/gen=2").count() == 3
    assert step(rows[:7] + [("info", 7, "third"), ("info", 60, "new")] + rows[9:]) == 3
    changes.compact(spark, path, str(tmp_path / "small"))
    for a, b in zip(changes.read(spark, path), changes.read(spark, str(tmp_path / "small"))):
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))
    # A change that broke off before its ids were written is not read, and its number is taken again.
    items.write.parquet(f"{path}/items/gen=4")
    assert changes.read(spark, path)[0].count() == 50 and changes.generations(spark, path)[-1] == 3


def test_long_cells_and_payloads(spark, tmp_path):
    cell = "y" * 200_000
    (tmp_path / "long.csv").write_text(f"info,n,{cell}\n")
    entries, _ = ragged_entries(read_ragged(spark, str(tmp_path / "long.csv")))
    assert len(entries.first().body) == 200_000


def test_other_datasets_and_odd_names_are_not_current(spark):
    rows = [(1, "info", "info::ds::row::0"), (2, "info", "info::ds2::row::0"), (3, "info", "info::ds::row::x"), (4, "key", "key::ds::row::1")]
    items = spark.createDataFrame([(i, k, n, "b", None, 1, None, None) for i, k, n in rows], ITEM)
    assert [r.id for r in items_of(items, ["info"], "ds").collect()] == [1]


@pytest.mark.parametrize("multiline", [False, True])
def test_ragged_entries(spark, tmp_path, multiline):
    lines = ["info,a,body one", 'info,b,"x, ""y""",k,1,k,2,e,', "info,c", "info,d,body,lonely", "", ",".join(["info", "w", "wide"] + [f"k{i // 2}" if i % 2 == 0 else str(i) for i in range(200)])]
    if multiline:
        lines.append('info,m,"two\nlines",k,v')
    (tmp_path / "new.csv").write_text("\n".join(lines) + "\n")
    entries, rejects = ragged_entries(read_ragged(spark, str(tmp_path / "new.csv"), multiline))
    got = {r.name: (r.body, r.metadata) for r in entries.collect()}
    assert got["a"] == ("body one", {}) and got["b"] == ('x, "y"', {"k": "2", "e": ""})
    assert len(got["w"][1]) == 100 and got["w"][1]["k99"] == "199"
    assert got.get("m") == (("two\nlines", {"k": "v"}) if multiline else None)
    assert sorted(r.cells[1] for r in rejects.collect()) == ["c", "d"]
    ordered = [r.name for r in entries.orderBy("seq").collect()]
    assert ordered == ["a", "b", "w"] + (["m"] if multiline else [])
