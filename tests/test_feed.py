import json
import random
import os

import pytest
from pyspark.sql import functions as F

from quern.plans import feed
from quern.sources.payload import coerce_rows
from quern.streaming.feed_stream import run_feed

def now():
    return F.lit("2024-06-01").cast("timestamp_ntz")
SCHEMA = "k long, seq long, v string"


def _typed(records):
    return records.select("k", "seq", F.upper("v").alias("v"))


def test_payloads(spark):
    payloads = {
        ' [{"a": 1, "b": "x"}, {"a": null}]': [{"a": "1", "b": "x"}, {"a": None}],
        '{"a": {"n": 1}}': [{"a": '{"n":1}'}],
        "a,b\n1,2\n3\n4,5,6\n": [{"a": "1", "b": "2"}, {"a": "3", "b": None}, {"a": "4", "b": "5"}],
        'a,b\r\n"1, ""one""","two\nlines"\r\n': [{"a": '1, "one"', "b": "two\nlines"}],
        "[broken": [],
        "{broken\n1": [{"{broken": "1"}],
        "": [],
        "a,b\n1," + "z" * 200_000: [{"a": "1", "b": "z" * 200_000}],
    }
    df = spark.createDataFrame(list(enumerate(payloads)) + [(99, None)], "i long, payload string")
    got = {}
    for r in coerce_rows(df, "payload").collect():
        got.setdefault(r.i, []).append(r.record)
    assert got == {i: rows for i, rows in enumerate(payloads.values()) if rows}


def _land(folder, name, rows):
    """Files arrive in the order of their names."""
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(("k", "seq", "v"), r))) + "\n" for r in rows))
    os.utime(folder / name, (1_700_000_000 + int(name[0]),) * 2)


def _present(spark, path, table="typed"):
    return sorted(tuple(r) for r in feed.read_feed(spark, path, table, ["k"], ["seq"]).select("k", "seq", *(["v"] if table == "typed" else ["payload"])).collect())


def test_two_stream_runs_equal_one_batch(spark, tmp_path):
    first = [(i % 10, i, f"a{i}") for i in range(100)]
    second = [(i % 15, 100 + i, f"b{i}") for i in range(60)] + [(0, 500 + i, "hot") for i in range(80)]
    landing, path = tmp_path / "landing", str(tmp_path / "stream")

    def run(**more):
        run_feed(spark, str(landing), SCHEMA, path, _typed, ["k"], ["seq"], now(), fmt="json", **more)

    _land(landing, "1.json", first)
    run()
    _land(landing, "2.json", second[:70])
    _land(landing, "3.json", second[70:])
    run(files_per_batch=1)
    run()
    everything = spark.createDataFrame(first + second, SCHEMA)
    feed.ingest_batch(everything, 0, _typed, str(tmp_path / "batch"), ["k"], ["seq"], now())
    assert _present(spark, path) == _present(spark, str(tmp_path / "batch"))
    assert _present(spark, path, "raw") == _present(spark, str(tmp_path / "batch"), "raw")
    assert {r.batch_id: r.n for r in feed.batch_totals(spark, path).collect()} == {0: 100, 1: 70, 2: 70}


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "feed")
    for _ in range(2):
        feed.ingest_batch(spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], SCHEMA), 0, _typed, path, ["k"], ["seq"], now())
    feed.ingest_batch(spark.createDataFrame([(1, 0, "late")], SCHEMA), 1, _typed, path, ["k"], ["seq"], now())
    assert _present(spark, path) == [(1, 0, "LATE"), (2, 2, "B")]
    assert json.loads(_present(spark, path, "raw")[1][2]) == {"k": 2, "seq": 2, "v": "b"}
    feed.compact_feed(spark, path, str(tmp_path / "small"), ["k"], ["seq"])
    assert _present(spark, str(tmp_path / "small")) == _present(spark, path)
    with pytest.raises(Exception, match="exist"):
        feed.compact_feed(spark, path, str(tmp_path / "small"), ["k"], ["seq"])


def test_a_compacted_feed_goes_on(spark, tmp_path):
    landing, path, small = tmp_path / "landing", str(tmp_path / "feed"), str(tmp_path / "small")

    def run(to):
        run_feed(spark, str(landing), SCHEMA, to, _typed, ["k"], ["seq"], now(), fmt="json")

    _land(landing, "1.json", [(1, 1, "a"), (2, 2, "b")])
    run(path)
    feed.compact_feed(spark, path, small, ["k"], ["seq"])
    _land(landing, "2.json", [(2, 3, "c"), (3, 4, "d")])
    run(small)
    run(small)
    assert _present(spark, small) == [(1, 1, "A"), (2, 3, "C"), (3, 4, "D")]
    assert {r.batch_id: r.n for r in feed.batch_totals(spark, small).collect()} == {-1: 2, 1: 2}
    feed.ingest_batch(spark.createDataFrame([(1, 9, "z")], SCHEMA), 0, _typed, small, ["k"], ["seq"], now())
    assert _present(spark, small)[0] == (1, 9, "Z")


def test_the_newest_record_of_a_key_is_kept(spark, tmp_path):
    """Over many batches the kept table equals the newest of all records, from a few generations; a replay changes nothing."""
    from quern.plans import feed, newest
    from quern.sources.changes import FANOUT, folder_spans

    path, rng, rows = str(tmp_path / "feed"), random.Random(1), []
    for batch in range(11):
        own = [(rng.randrange(30), rng.randrange(100), f"{batch}:{i}") for i in range(40)]
        frame = spark.createDataFrame(own, "k long, n long, v string")
        for _ in range(2 if batch in (3, 7) else 1):
            newest.add_batch(frame, batch, path, ["k"], ["n", "v"])
            newest.settle(spark, path, ["k"], ["n", "v"])
        rows += [(k, batch, n, v) for k, n, v in own]
        if batch % 5 == 0:
            want = {}
            for k, b, n, v in sorted(rows):
                want[k] = (n, v)
            assert {r.k: (r.n, r.v) for r in newest.read_newest(spark, path, ["k"], ["n", "v"]).collect()} == want
    assert len(folder_spans(spark, f"{path}/newest")) < FANOUT

    (tmp_path / "landing").mkdir()
    for step, text in enumerate(('{"k":1,"n":1}\n{"k":1,"n":2}\n', '{"k":1,"n":0}\n{"k":2,"n":1}\n')):
        (tmp_path / f"landing/{step}.json").write_text(text)
        run_feed(spark, str(tmp_path / "landing"), "k long, n long", str(tmp_path / "out"), lambda r: r, ["k"], ["n"], F.current_timestamp(), "json", keep_newest=True)
    kept = newest.read_newest(spark, str(tmp_path / "out"), ["k"], ["n"])
    assert sorted(map(tuple, kept.select("k", "n").collect())) == [(1, 0), (2, 1)]
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, feed.read_feed(spark, str(tmp_path / "out"), "typed", ["k"], ["n"]).collect()))
