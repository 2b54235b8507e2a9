"""Split CSV files with line feeds in cells, against Python's reader of the whole file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from quern.sources.csv_items import ragged_entries, read_item_files, read_ragged
from quern.sources.quoted_csv import block_states, left_open, lines_of, quoted_records

BYTES, COST = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"


@pytest.fixture
def split(spark):
    """Makes the splits of files a given number of bytes."""
    before = {k: spark.conf.get(k) for k in (BYTES, COST)}

    def to(size):
        spark.conf.set(BYTES, str(size))
        spark.conf.set(COST, "0")

    yield to
    for key, value in before.items():
        spark.conf.set(key, value)


def _cell(rng):
    kind = rng.random()
    if kind < 0.35:
        return rng.choice(["plain", "", "two words", "é漢", 'inch 5" wide', "it's"])
    body = "".join(rng.choice(["a", "bc ", '""', ",", "\n", "\r\n", "\n\n", "x" * rng.randrange(40), '"",""']) for _ in range(rng.randrange(8)))
    return f'"{body}"' + rng.choice(["", "", "", "tail", 'ta"il'])


def _text(seed, records=50):
    rng = random.Random(seed)
    return "".join(",".join(_cell(rng) for _ in range(rng.randrange(1, 5))) + rng.choice(["\n", "\r\n"]) for _ in range(records))


def _got(spark, path):
    rows = quoted_records(spark, str(path)).orderBy(F.length("file"), "file", "rec", "pos").collect()
    return [list(r.cells) for r in rows], [r.closed for r in rows]


@pytest.mark.parametrize("seed,size", [(0, 40), (1, 97), (2, 300), (3, 1_000_000)])
def test_splits_read_as_the_whole_file(spark, split, tmp_path, seed, size):
    text = _text(seed)
    (tmp_path / "a.csv").write_bytes(text.encode())
    split(size)
    assert lines_of(spark, str(tmp_path / "a.csv")).select("block").distinct().count() > (1 if size < 1000 else 0)
    cells, closed = _got(spark, tmp_path / "a.csv")
    assert cells == list(csv.reader(io.StringIO(text, newline="")))
    assert all(closed)


def test_a_cell_longer_than_many_splits(spark, split, tmp_path):
    inner = "".join(f"line {i}, with a comma and a \"\"quote\"\"\n" for i in range(300))
    text = f'first,1\n"{inner}",2\nlast,3'
    (tmp_path / "a.csv").write_text(text)
    split(500)
    states = block_states(lines_of(spark, str(tmp_path / "a.csv"))).orderBy("block").collect()
    assert len(states) > 20 and all(s.inside and s["first"] == 2 for s in states[2:-1])
    cells, _ = _got(spark, tmp_path / "a.csv")
    assert cells == list(csv.reader(io.StringIO(text, newline="")))


def test_numbers_of_several_files_and_many_splits(spark, split, tmp_path):
    texts = {f"part-{i}.csv": _text(10 + i, 20) for i in range(4)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    split(128)
    rows = quoted_records(spark, str(tmp_path)).orderBy("file", "rec", "pos").collect()
    for name, text in texts.items():
        want = list(csv.reader(io.StringIO(text, newline="")))
        own = [r for r in rows if r.file.endswith(f"/{name}")]
        assert [list(r.cells) for r in own] == want and [r.rec for r in own] == list(range(len(want)))


def test_shuffled_states_give_the_same(spark, split, tmp_path, monkeypatch):
    monkeypatch.setattr("quern.sources.quoted_csv.is_small", lambda keys: False)
    text = _text(21)
    (tmp_path / "a.csv").write_bytes(text.encode())
    split(80)
    assert _got(spark, tmp_path / "a.csv")[0] == list(csv.reader(io.StringIO(text, newline="")))


def test_bare_cr_and_marks(spark, tmp_path):
    text = '﻿a,b\rc,"d\re"\r\n\r\nf\n'
    (tmp_path / "a.csv").write_bytes(text.encode())
    cells, _ = _got(spark, tmp_path / "a.csv")
    assert cells == list(csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")))


def test_a_quote_that_is_never_closed(spark, split, tmp_path):
    """Nothing of the file is lost: what follows belongs to the open cell, and the entry is refused with its reason."""
    (tmp_path / "a.csv").write_text('info,a,fine\ninfo,n,"open\nline two\ninfo,b,more\n')
    split(15)
    entries, rejects = ragged_entries(read_ragged(spark, str(tmp_path / "a.csv")))
    assert [r.name for r in entries.collect()] == ["a"]
    assert [(list(r.cells), r.reason) for r in rejects.collect()] == [(["info", "n", "open\nline two\ninfo,b,more"], "unclosed quote")]
    # Line by line, the record is refused, not cut.
    entries, rejects = ragged_entries(read_ragged(spark, str(tmp_path / "a.csv"), multiline=False))
    assert sorted(r.name for r in entries.collect()) == ["a", "b"]
    assert sorted((r.cells[0], r.reason) for r in rejects.collect()) == [("info", "unclosed quote"), ("line two", "too few cells")]


@pytest.mark.parametrize("has_header", [False, True])
def test_item_files_in_many_tasks(spark, split, tmp_path, has_header):
    rng = random.Random(5)
    bodies = [f"row {i}" + rng.choice(["", "\nnext", ' "quoted"', ", more\n\nand more"]) for i in range(400)]
    with open(tmp_path / "info.csv", "w", newline="", encoding="utf-8-sig") as f:
        out = csv.writer(f)
        out.writerow(["body", "note"])
        for body in bodies:
            out.writerow([body, "n"])
            out.writerow([rng.choice(["", "  "])])
    split(700)
    frame = read_item_files(spark, {"info": str(tmp_path / "info.csv")}, has_header=has_header)
    got = [(r.row_ix, r.body) for r in frame.orderBy("row_ix").collect()]
    assert got == list(enumerate(bodies if has_header else ["body", *bodies]))


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert _got(spark, tmp_path / "a.csv") == ([], [])


@pytest.mark.parametrize(
    "text,outside,inside",
    [("a,b", False, True), ('"a', True, False), ('a"b', False, False), ('"a""b"', False, True), ('","', False, True), ('x,"', True, False), ('"a"b"c,"', True, False), ('","",', True, False)],
)
def test_states_of_a_line(text, outside, inside):
    for begin, want in ((False, outside), (True, inside)):
        prefix = '"' if begin else ""
        rows = list(csv.reader(io.StringIO(prefix + text + "\nEND", newline="")))
        assert left_open(text, begin) == (len(rows) == 1), (text, begin)
    assert left_open(text) == outside
