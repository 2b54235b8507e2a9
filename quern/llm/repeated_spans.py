"""Suffix-array dedup by distributed prefix doubling: bytes covered by a string of SPAN bytes that also stands elsewhere.

A suffix array sorted only as deep as SPAN bytes says which strings of that length stand twice. It is built by
doubling: the name of 2h bytes is the pair of names of h bytes at a position and h further on; Spark sorts
positions by these pairs, positions whose pair stands once are dropped, and the rest goes on to the next
offset, until it is unique or SPAN bytes deep.

1. Names of SPAN / 4 bytes are paired to names of SPAN / 2 bytes at every place. Of each window of SPAN bytes one
   place is a position: where the smallest of the names that start in it stands, the last of equal ones.
   Equal windows choose equal places, so nothing is missed, and neighbouring windows mostly share their
   place, so about one byte in 45 is a position. Windows that share one are its run.
2. Spark sorts the positions by (name, name of the whole run, place). A name that stands once rules out all
   windows of its run. A run that stands twice has all its windows elsewhere. Only neighbours in this order are compared;
   ranges of the sort end anywhere, also inside a group of copies, and a range's first and last name count
   as standing twice, which the next step settles.
3. The windows of runs that stand once under a name that stands twice, and of one run of each kind under that
   name, get pairs of names of SPAN / 2 bytes at offset SPAN / 2. Those of a name are compared by one task where the name has at most
   GROUP different runs; under more frequent names, every window is a row of a distributed count.

Names are 64-bit hashes. The first only guides; whatever counts as equal agrees in 128 bits. Long texts are named in pieces, and runs
cut at a piece's end are settled in step 3.

Null and empty texts, texts under SPAN bytes: nothing is removed. Repeated rows (one doc_id and text) are documents of
their own, whose texts stand twice. Null doc_ids: documents as others. Empty table: empty result. Columns
named as the outputs are replaced, other columns are kept. Cuts may fall inside a character, so what is kept is binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import flat
from quern.llm.columns import replace_columns, whole_text
from quern.session import staged

SPAN = 200
HALF = SPAN // 2
#: Places among which a window chooses its position.
CHOICE = SPAN - HALF + 1
#: Different runs of a name that one task compares.
GROUP = 4096
#: Starts of windows handled at once.
PIECE = 1 << 20
#: Runs whose bytes are handled at once.
SLICE = 4096
#: Bits of the map by which documents without repeats are left out of joins.
LIKELY_BITS = 1 << 24

SETTLED, SHOWN, WIDE = 1, 2, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEYS = ["_doc_key", "_text_key"]
_KEY_TYPES = "_doc_key long, _text_key int"


def half_names(data: np.ndarray) -> np.ndarray:
    """The name of the HALF bytes at every place, from the pair of names of half as many."""
    size = HALF // 2
    places = np.arange(max(0, len(data) - size + 1))
    names = flat.span_hashes(data, places, places + size)
    return flat.mix(names[:-size] * _BASE + names[size:])


def chosen_places(names: np.ndarray, window: int) -> np.ndarray:
    """For every run of `window` names the place of its smallest, the last of equal ones."""
    least, at, size = names, np.arange(len(names), dtype=np.int32), 1

    def joined(shift, least, at):
        later = least[shift:] <= least[:-shift]
        return np.where(later, least[shift:], least[:-shift]), np.where(later, at[shift:], at[:-shift])

    while 2 * size <= window:
        least, at = joined(size, least, at)
        size *= 2
    return joined(window - size, least, at)[1] if window > size else at


def runs_of(data: np.ndarray, bounds: np.ndarray):
    """(start, count, name, name of the whole run) of all runs of windows with one position, row after row."""
    for first in range(0, max(0, len(data) - SPAN + 1), PIECE):
        piece = data[first : first + PIECE + SPAN - 1]
        names = half_names(piece)
        place = chosen_places(names, CHOICE)
        inside = np.zeros(len(place) + 1, np.int32)
        long = np.diff(bounds) >= SPAN
        for edges, step in ((bounds[:-1][long], 1), (bounds[1:][long] - SPAN + 1, -1)):
            np.add.at(inside, np.clip(edges - first, 0, len(place)), step)
        starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if not len(starts):
            continue
        new = np.ones(len(starts), bool)
        new[1:] = (place[starts[1:]] != place[starts[:-1]]) | (np.diff(starts) > 1)
        low = starts[new]
        count = np.diff(np.append(np.flatnonzero(new), len(starts)))
        whole = flat.span_hashes(piece, low, low + count + SPAN - 1)
        yield low + first, count, names[place[low]], flat.mix(whole ^ flat.mix((place[low] - low).astype(np.uint64)))


def _run_batches(batches):
    for batch in flat.pieces(batches, "text", PIECE):
        data, bounds = flat.column(batch.column("text"))
        for low, count, name, whole in runs_of(data, bounds):
            row = np.searchsorted(bounds, low, side="right") - 1
            keys = [batch.column(k).take(pa.array(row)) for k in _KEYS]
            columns = [flat.signed(name), flat.signed(whole), low - bounds[row], count.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *keys], names=["name", "whole", "low", "count", *_KEYS])


def whole_groups(batches, key: str, least: int = 1 << 14):
    """The sorted rows in tables of whole groups; with each whether it is the partition's last."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows >= least:
            values = held[key].to_numpy()
            last = np.flatnonzero(values != values[-1])
            if len(last):
                yield held.slice(0, last[-1] + 1).combine_chunks(), False
                held = held.slice(last[-1] + 1).combine_chunks()
    if held is not None:
        yield held.combine_chunks(), True


def _ranked_batches(batches):
    """The runs whose name stands twice, with what is known of them."""
    first = True
    for table, last in whole_groups(batches, "name"):
        name, whole, low, doc, text = (table[c].to_numpy() for c in ("name", "whole", "low", *_KEYS))
        new_name = np.ones(len(name), bool)
        new_name[1:] = name[1:] != name[:-1]
        new_run = new_name.copy()
        new_run[1:] |= whole[1:] != whole[:-1]
        group, run = np.cumsum(new_name) - 1, np.cumsum(new_run) - 1
        kinds = np.bincount(group[new_run])
        edge = np.zeros(len(kinds), bool)
        edge[0] |= first
        edge[-1] |= last
        first = False
        settled = np.bincount(run)[run] > 1
        compared = ((kinds > 1) | edge)[group]
        shown = compared & (new_run | ~settled)
        again = np.zeros(len(name), bool)  # another row of one doc_id and text
        again[1:] = ~new_run[1:] & (low[1:] == low[:-1]) & (doc[1:] == doc[:-1]) & (text[1:] == text[:-1])
        state = settled * SETTLED + shown * SHOWN + (edge | (kinds > GROUP))[group] * WIDE
        kept = table.append_column("state", pa.array(state.astype(np.int32))).filter(pa.array((settled | shown) & ~again))
        yield from kept.select(["name", "low", "count", "state", *_KEYS]).to_batches()


def ranked_runs(texts: DataFrame) -> DataFrame:
    """(name, low, count, state, keys): the runs whose name stands twice; written once."""
    runs = texts.mapInArrow(_run_batches, f"name long, whole long, low long, count int, {_KEY_TYPES}")
    order = ["name", "whole", *_KEYS, "low"]
    dealt = runs.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(dealt.mapInArrow(_ranked_batches, f"name long, low long, count int, state int, {_KEY_TYPES}"), "ranks")


def with_likely(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows with _likely, false only where _doc_key is not among the keys, by a bit map of fixed size."""
    slot = F.col("_doc_key").bitwiseAND(F.lit(LIKELY_BITS - 1))
    bit = F.expr("shiftleft(1L, int(_doc_key & 63))")
    bits = keys.select(F.shiftright(slot, 6).alias("_word"), bit.alias("bit")).groupBy("_word").agg(F.bit_or("bit").alias("_bits"))
    found = rows.join(F.broadcast(bits), F.shiftright(slot, 6) == F.col("_word"), "left")  # at most LIKELY_BITS / 64 rows
    return found.withColumn("_likely", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def window_names(data: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of names of all windows of runs, whose bytes begin at the given places: both names, run, place in the run."""
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    names = half_names(data) if len(owner) else np.zeros(0, np.uint64)
    at = begins[owner] + place
    return names[at], names[at + HALF], owner, place


def _taken(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all spans behind one another."""
    after = np.cumsum(sizes)
    return data[np.repeat(begins - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)]


_SHOWN_SCHEMA = f"name long, second long, span binary, low long, count int, asked boolean, {_KEY_TYPES}"


def _shown_batches(batches):
    """A row per shown run with its bytes; under wide names a row per window, with both names and no bytes."""
    for batch in flat.pieces(batches, "text", PIECE):
        data, bounds = flat.column(batch.column("text"))
        lists = batch.column("runs")
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        fields = lists.flatten()
        name, low, count, state = (fields.field(c).to_numpy() for c in ("name", "low", "count", "state"))
        for begin in range(0, len(row), SLICE):
            part = slice(begin, begin + SLICE)
            sizes = count[part].astype(np.int64) + SPAN - 1
            taken, wide, asked = _taken(data, bounds[row[part]] + low[part], sizes), state[part] & WIDE > 0, state[part] & SETTLED == 0
            edges = np.concatenate([[0], np.cumsum(sizes)])
            spans = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(taken)]).cast(pa.binary())
            keys = [batch.column(k).take(pa.array(row[part])) for k in _KEYS]
            columns = [pa.array(name[part]), pa.nulls(len(sizes), pa.int64()), spans, pa.array(low[part]), pa.array(count[part]), pa.array(asked), *keys]
            rows = pa.RecordBatch.from_arrays(columns, names=["name", "second", "span", "low", "count", "asked", *_KEYS])
            yield rows.filter(pa.array(~wide))
            own = np.flatnonzero(wide)
            if len(own):
                one, two, owner, place = window_names(taken, edges[:-1][own], count[part][own].astype(np.int64))
                owner = own[owner]
                at = pa.array(owner)
                columns = [pa.array(flat.signed(one)), pa.array(flat.signed(two)), pa.nulls(len(owner), pa.binary()), pa.array(low[part][owner] + place)]
                columns += [pa.array(np.ones(len(owner), np.int32)), pa.array(asked[owner]), *(k.take(at) for k in keys)]
                yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names)


def _compared_batches(batches):
    """(low, count, keys): the windows of asked runs that stand twice under their name."""
    for table, _ in whole_groups(batches, "name", SLICE):
        data, edges = flat.column(table["span"].combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
        name, counts, asked = table["name"].to_numpy(), table["count"].to_numpy().astype(np.int64), table["asked"].to_numpy(zero_copy_only=False)
        one, two, owner, place = window_names(data, edges[:-1], counts)
        order = np.lexsort((two, one, name[owner]))
        same = np.ones(max(0, len(order) - 1), bool)
        for values in (one, two, name[owner]):
            same &= values[order[1:]] == values[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        found = np.flatnonzero(twice & asked[owner])
        if not len(found):
            continue
        new = np.ones(len(found), bool)
        new[1:] = (np.diff(found) > 1) | (np.diff(owner[found]) > 0)
        start = found[new]
        counted = np.diff(np.append(np.flatnonzero(new), len(found))).astype(np.int32)
        keys = [table[k].combine_chunks().take(pa.array(owner[start])) for k in _KEYS]
        columns = [pa.array(table["low"].to_numpy()[owner[start]] + place[start]), pa.array(counted), *keys]
        yield pa.RecordBatch.from_arrays(columns, names=["low", "count", *_KEYS])


def _keyed(docs: DataFrame) -> DataFrame:
    """Equal rows of doc_id and text share their keys; they are the only ones that may."""
    return docs.withColumns({"_doc_key": F.xxhash64("doc_id"), "_text_key": F.hash("text")})


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(keys, low, count): runs of windows of SPAN bytes that also stand elsewhere; written once."""
    texts = _keyed(docs.select("doc_id", "text")).where(F.octet_length("text") >= SPAN).select(*_KEYS, "text")
    ranked = ranked_runs(texts)
    lists = ranked.where(F.col("state").bitwiseAND(SHOWN) != 0).groupBy(*_KEYS).agg(F.collect_list(F.struct("name", "low", "count", "state")).alias("runs"))
    likely = with_likely(texts, lists.select("_doc_key")).where("_likely").drop("_likely")
    shown = staged(likely.join(lists, _KEYS).select(*_KEYS, "text", "runs").mapInArrow(_shown_batches, _SHOWN_SCHEMA), "shown")
    narrow = shown.where("span is not null").select("name", "span", "low", "count", "asked", *_KEYS)
    compared = narrow.repartition("name").sortWithinPartitions("name").mapInArrow(_compared_batches, f"low long, count int, {_KEY_TYPES}")
    wide = shown.where("span is null").select("name", "second", "low", "count", "asked", *_KEYS)
    twice = wide.groupBy("name", "second").agg(F.count("*").alias("n")).where("n > 1").select("name", "second")
    counted = wide.where("asked").join(twice, ["name", "second"], "left_semi")
    settled = ranked.where(F.col("state").bitwiseAND(SETTLED) != 0)
    parts = [df.select(*_KEYS, "low", "count") for df in (settled, compared, counted)]
    return staged(parts[0].unionByName(parts[1]).unionByName(parts[2]), "windows")


def _cut_batches(columns: list[str]):
    def run(batches):
        for batch in batches:
            data, bounds = flat.column(batch.column("text"))
            lists = batch.column("_windows")
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            low, count = (lists.flatten().field(c).to_numpy() for c in ("low", "count"))
            kept, spans = [], []
            for row, end in enumerate(ends):
                begin = ends[row - 1] if row else 0
                order = np.argsort(low[begin:end])
                starts = low[begin:end][order]
                stops = np.maximum.accumulate(starts + count[begin:end][order] + SPAN - 1)
                new = np.ones(len(starts), bool)
                new[1:] = starts[1:] > stops[:-1]
                firsts, lasts = starts[new], stops[np.append(np.flatnonzero(new)[1:] - 1, len(stops) - 1)] if len(stops) else stops
                text = data[bounds[row] : bounds[row + 1]]
                pieces = [text[a:b] for a, b in zip([0, *lasts], [*firsts, len(text)])]
                kept.append(np.concatenate(pieces).tobytes())
                spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(firsts, lasts)])
            arrays = [batch.column(c) for c in columns]
            arrays += [pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "kept", "spans"])

    return run


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs with kept, the bytes that are left of the text, and spans, the removed ones as start and stop."""
    docs = replace_columns(docs, "kept", "spans", "_windows", "_likely", "_word", "_bits", *_KEYS)
    windows = repeated_windows(docs)
    lists = windows.groupBy(*_KEYS).agg(F.collect_list(F.struct("low", "count")).alias("_windows"))
    marked = with_likely(_keyed(docs), windows.select("_doc_key"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    cut = marked.where("_likely").join(lists, _KEYS, "left").select(*own, "_windows")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    added = "kept binary, spans array<struct<start: long, stop: long>>"
    done = cut.mapInArrow(_cut_batches(docs.columns), f"{kinds}, {added}")
    none = F.expr("cast(array() as array<struct<start: long, stop: long>>)")
    return done.union(marked.where("not _likely").select(*own, whole_text().cast("binary").alias("kept"), none.alias("spans")))


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    cut = cut_repeats(docs.select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return cut.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
