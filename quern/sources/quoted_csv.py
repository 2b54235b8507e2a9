"""CSV records whose quoted cells may hold line feeds, from files that many tasks read at once.

A block of a file does not know whether it begins inside a quoted cell. So the files are read twice. First
every block reports, for either state at its begin, the state at its end and how many records begin in it.
Such maps compose: over the blocks of a file, one small row each, windows give every block its state and the
number of records before it. Then each block cuts its records where they lie; only a record that runs over
the end of a block is put together from its parts, under its number.

Quoting is read as the usual CSV dialect has it: a quote opens a cell only at its begin, a doubled one
stands for itself, and text after a closing quote belongs to the cell.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.operators.sizes import is_small
from quern.session import staged

#: A cell may be as long as its text.
LONGEST_CELL = 2**31 - 1
#: Records parsed at once.
BATCH_RECORDS = 4096

_INSIDE = r'(?:[^"]++|"")*+'
_FROM_OUTSIDE = rf'(?:(?:[^",\r][^,\r]*+|"{_INSIDE}"[^,\r]*+)?+[,\r])*+"{_INSIDE}'
_OUTSIDE = re.compile(rf"{_FROM_OUTSIDE}\Z")
_WITHIN = re.compile(rf'{_INSIDE}(?:\Z|"[^,\r]*+[,\r]{_FROM_OUTSIDE}\Z)')

_PLACE = "file string, block long"
_RECORD = pa.schema(
    [
        ("file", pa.string()), ("block", pa.int64()), ("rec", pa.int64()), ("pos", pa.int32()),
        ("cells", pa.list_(pa.string())), ("closed", pa.bool_()), ("part", pa.string()),
    ]
)
_RECORD_DDL = f"{_PLACE}, rec long, pos int, cells array<string>, closed boolean, part string"


def left_open(text: str, inside: bool = False) -> bool:
    """Whether a quoted cell is open at the end of the text, which begins outside of one or inside."""
    if '"' not in text:
        return inside
    return (_WITHIN if inside else _OUTSIDE).match(text) is not None


def parsed(texts: list[str]) -> Iterator[tuple[int, int, list[str]]]:
    """(which text, place in it, cells) of closed records; a text with a bare CR may hold several."""
    csv.field_size_limit(LONGEST_CELL)
    texts = [t.removesuffix("\r") for t in texts]
    if not any("\r" in t for t in texts):
        yield from ((i, 0, cells) for i, cells in enumerate(csv.reader(texts)))
        return
    for i, text in enumerate(texts):
        for pos, cells in enumerate(csv.reader(io.StringIO(text, newline="")) if text else [[]]):
            yield i, pos, cells


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): the lines of a file or folder, cut at LF; ``at`` rises within a block."""
    rows = spark.read.option("lineSep", "\n").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return rows.select(*place, F.monotonically_increasing_id().alias("at"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The rows of a batch cut where file or block changes."""
    if not batch.num_rows:
        return
    files = batch.column("file").dictionary_encode()
    code, block = files.indices.to_numpy(), batch.column("block").to_numpy()
    edges = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1
    for low, high in zip([0, *edges], [*edges, batch.num_rows]):
        yield files.dictionary[code[low]].as_py(), int(block[low]), batch.slice(low, high - low)


def _map_batches(batches):
    """A row per block: for a begin outside and inside of a cell, whether its end is inside and the records that begin."""
    place, now, starts = None, [], []

    def row():
        values = [[place[0]], [place[1]], [now[0]], [now[1]], [starts[0]], [starts[1]]]
        return pa.RecordBatch.from_arrays([*map(pa.array, values)], names=["file", "block", "out_end", "in_end", "out_starts", "in_starts"])

    for batch in batches:
        for file, block, part in _runs(batch):
            if (file, block) != place:
                if place is not None:
                    yield row()
                place, now, starts = (file, block), [False, True], [0, 0]
            values = part.column("value")
            quoted = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
            texts, done = values.take(pa.array(quoted)).to_pylist(), 0
            for at, text in zip(quoted, texts):
                for begin in (0, 1):
                    starts[begin] += 0 if now[begin] else int(at) - done + 1
                now = [left_open(text, state) for state in now] if now[0] != now[1] else [left_open(text, now[0])] * 2
                done = int(at) + 1
            for begin in (0, 1):
                starts[begin] += 0 if now[begin] else part.num_rows - done
    if place is not None:
        yield row()


def block_states(lines: DataFrame) -> DataFrame:
    """(file, block, inside, first): whether a block begins inside a cell, and the records of the file that begin before it.

    A block's map is constant, keeps the state or swaps it. The state before a block follows from the last
    constant map and the number of swaps since.
    """
    maps = lines.select("file", "block", "value").mapInArrow(_map_batches, f"{_PLACE}, out_end boolean, in_end boolean, out_starts long, in_starts long")
    order = W.partitionBy("file").orderBy("block")
    swap = (F.col("out_end") & ~F.col("in_end")).cast("int")
    turned = maps.withColumn("_swaps", F.sum(swap).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) % 2)
    fixed = F.when(F.col("out_end") == F.col("in_end"), F.col("out_end").cast("long").bitwiseXOR(F.col("_swaps")))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(F.last(fixed, ignorenulls=True).over(before), F.lit(0).cast("long"))
    state = base.bitwiseXOR(F.coalesce(F.lag("_swaps").over(order), F.lit(0).cast("long"))) == 1
    known = turned.withColumn("inside", state)
    starts = F.when(F.col("inside"), F.col("in_starts")).otherwise(F.col("out_starts"))
    return known.select("file", "block", "inside", F.coalesce(F.sum(starts).over(before), F.lit(0).cast("long")).alias("first"))


def _whole(file: str, block: int, numbers: list[int], texts: list[str]) -> pa.RecordBatch:
    rows = list(parsed(texts))
    n = len(rows)
    columns = [[file] * n, [block] * n, [numbers[i] for i, _, _ in rows], [pos for _, pos, _ in rows], [cells for _, _, cells in rows], [True] * n, [None] * n]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORD)], schema=_RECORD)


def _part(file: str, block: int, number: int, lines: list[str]) -> pa.RecordBatch:
    values = [[file], [block], [number], [0], [None], [None], ["\n".join(lines)]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _RECORD)], schema=_RECORD)


def _cut_batches(batches):
    """The records of each block, whole ones as cells; a record that is not all in the block as its part there."""
    place, number, begun, held, inside = None, 0, True, [], False
    numbers, texts = [], []

    def end():
        if held:
            yield _part(*place, number, held)

    for batch in batches:
        for file, block, rows in _runs(batch):
            if (file, block) != place:
                if place is not None:
                    yield from end()
                place, held = (file, block), []
                inside = rows.column("inside")[0].as_py()
                number, begun = rows.column("first")[0].as_py() - 1, not inside
            for line in rows.column("value").to_pylist():
                if not inside:
                    number, begun = number + 1, True
                inside = left_open(line, inside)
                if inside or held or not begun:
                    held.append(line)
                    if inside:
                        continue
                    if not begun:
                        yield _part(*place, number, held)
                        held = []
                        continue
                    line, held = "\n".join(held), []
                numbers.append(number)
                texts.append(line)
                if len(texts) == BATCH_RECORDS:
                    yield _whole(*place, numbers, texts)
                    numbers, texts = [], []
            if texts:
                yield _whole(*place, numbers, texts)
                numbers, texts = [], []
    if place is not None:
        yield from end()


def _joined_batches(batches):
    """Records put together from their parts; one that is still open at the end of its file keeps its cells and is not closed."""
    for batch in batches:
        for file, block, rec, text in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "rec", "text"))):
            closed = not left_open(text)
            found = list(parsed([text]))
            columns = [[file] * len(found), [block] * len(found), [rec] * len(found), [p for _, p, _ in found], [c for _, _, c in found], [closed] * len(found), [None] * len(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORD)], schema=_RECORD)


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, rec, pos, cells, closed): the records of CSV files, numbered from 0 in each file.

    ``block`` is where the block begins in which the record does, ``pos`` counts records that only a CR
    parts. ``closed`` is false for a record whose last cell is still open at the end of its file.
    """
    lines = lines_of(spark, path)
    states = staged(block_states(lines), "csv-blocks")
    if is_small(states):
        placed = lines.join(F.broadcast(states), ["file", "block"])  # keeps the order of the lines
    else:
        placed = lines.join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at")
    cut = staged(placed.select("file", "block", "value", "inside", "first").mapInArrow(_cut_batches, _RECORD_DDL), "csv-records")
    parts = cut.where("part is not null").groupBy("file", "rec").agg(F.min("block").alias("block"), F.sort_array(F.collect_list(F.struct("block", "part"))).alias("parts"))
    joined = parts.select("file", "block", "rec", F.array_join("parts.part", "\n").alias("text")).mapInArrow(_joined_batches, _RECORD_DDL)
    return cut.where("part is null").unionByName(joined).drop("part")


def _line_batches(batches):
    for batch in batches:
        for begin in range(0, batch.num_rows, BATCH_RECORDS):
            rows = batch.slice(begin, BATCH_RECORDS)
            lines = rows.column("value").to_pylist()
            for closed in (True, False):
                own = [i for i, line in enumerate(lines) if left_open(line) != closed]
                groups = [own] if closed else [[i] for i in own]
                found = [(group[i], pos, cells) for group in groups for i, pos, cells in parsed([lines[i] for i in group])]
                at = pa.array([i for i, _, _ in found], pa.int64())
                columns = [rows.column(c).take(at) for c in ("file", "block", "at")]
                columns += [pa.array([p for _, p, _ in found], pa.int32()), pa.array([c for _, _, c in found], pa.list_(pa.string())), pa.array([closed] * len(found), pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "rec", "pos", "cells", "closed"])


def line_records(spark: SparkSession, path: str) -> DataFrame:
    """The same columns where every line is a record, in one reading; ``rec`` only rises within its block.

    A line that leaves a cell open is not closed.
    """
    return lines_of(spark, path).mapInArrow(_line_batches, f"{_PLACE}, rec long, pos int, cells array<string>, closed boolean")
