"""Benchmark decontamination: SimHash windows of the items' sizes, Hamming blocks, exact similarity.

Texts and items are lower-cased (A-Z) words, taken as shingles of five words (of all its words for a
shorter item). Wherever a text shares a shingle with an item, every window of the item's number of words
around that place gets a SimHash of its shingles. Two fingerprints of BITS bits within RADIUS differ by
at most RADIUS // BLOCKS bits in at least one of BLOCKS equal blocks, so the blocks find all fingerprints
within the radius and none is missed. Candidates are verified by the weighted Jaccard similarity of the
shingle multisets (weight: how often a shingle stands), which must reach `threshold`. A pair's best
window, the first of equals, is reported.

The radius lies five standard deviations above the mean distance at similarity 0.8, so the fingerprints
lose no window in practice; windows without a shared shingle have similarity 0.

The items are the stated query set: they are sent to the tasks in groups of at most ITEM_BYTES of text, one
pass over the documents per group, so what is broadcast never grows with the benchmark. Documents are
handled row by row: a passage that stands in a third of all texts costs as much per text as any other.

Null text, empty text, null or empty item: no match. Empty table: empty result. Equal items with several
ids are each reported; repeated rows and doc_ids give rows each. Other columns are not read by
find_matches and are kept as they are by drop_contaminated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import flat

SHINGLE = 5
THRESHOLD = 0.8
BITS = 128
BLOCKS = 8
RADIUS = 47
ITEM_BYTES = 8 << 20
#: Shared shingles of a text and an item that are looked at together.
PLACES = 1024

_BLOCK_BITS = BITS // BLOCKS


def _bit_table(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each shingle and fingerprint bit."""
    words = np.stack([flat.mix(shingles ^ np.uint64(0xA5A5 + 77 * k)) for k in range(BITS // 64)], axis=1)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(shingles), BITS // 8), axis=1)
    return bits.astype(np.int16) * 2 - 1


def fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The SimHash, as a row of bits, of the `size` shingles from each start."""
    sums = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(_bit_table(shingles), axis=0, out=sums[1:])
    return sums[np.minimum(starts + size, len(shingles))] - sums[starts] > 0


def within_radius(prints: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which fingerprints lie within RADIUS of the item's, by way of the blocks."""
    apart = (prints != item).reshape(len(prints), BLOCKS, _BLOCK_BITS).sum(axis=2)
    near = np.flatnonzero((apart <= RADIUS // BLOCKS).any(axis=1))
    return near[apart[near].sum(axis=1) <= RADIUS]


def similarity(window: np.ndarray, shingles: np.ndarray, counts: np.ndarray, total: int) -> float:
    """Weighted Jaccard similarity of a window's shingles and an item's (sorted, with counts)."""
    found, number = np.unique(window, return_counts=True)
    at = flat.lookup(shingles, found)
    shared = np.minimum(number[at >= 0], counts[at[at >= 0]]).sum()
    return float(shared / (total + len(window) - shared))


def build_index(items: list[tuple[int, str]]) -> list[dict]:
    """For each shingle size that is used: the items, and the sorted shingles with the items that hold them."""
    data, bounds = flat.column(pa.array([t for _, t in items], pa.string()))
    data = flat.lower_ascii(data)
    starts, ends, before = flat.word_spans(data, bounds)
    hashes = flat.span_hashes(data, starts, ends)
    by_size: dict[int, list] = {}
    for row, (item_id, _) in enumerate(items):
        words = hashes[before[row] : before[row + 1]]
        if not len(words):
            continue
        size = min(SHINGLE, len(words))
        runs, _ = flat.run_hashes(words, np.array([0, len(words)]), size)
        kinds, counts = np.unique(runs, return_counts=True)
        by_size.setdefault(size, []).append({"id": item_id, "words": len(words), "total": len(runs), "kinds": kinds, "counts": counts, "print": fingerprints(runs, np.array([0]), len(runs))[0]})
    out = []
    for size, found in sorted(by_size.items()):
        every = np.concatenate([i["kinds"] for i in found])
        owner = np.repeat(np.arange(len(found)), [len(i["kinds"]) for i in found])
        order = np.argsort(every, kind="stable")
        keys, first = np.unique(every[order], return_index=True)
        out.append({"size": size, "items": found, "keys": keys, "first": np.append(first, len(every)), "owner": owner[order]})
    return out


def _best_window(runs: np.ndarray, places: np.ndarray, item: dict, threshold: float) -> tuple[int, float] | None:
    """The best window among those that hold one of the places; runs: the text's shingles."""
    total, last = item["total"], max(0, len(runs) - item["total"])
    best = None
    for at in range(0, len(places), PLACES):  # bounds the memory for a text that repeats an item very often
        starts = np.unique(np.clip((places[at : at + PLACES, None] - np.arange(total)[None, :]).ravel(), 0, last))
        for some in np.split(starts, np.flatnonzero(np.diff(starts) > total) + 1):
            low, high = int(some[0]), min(len(runs), int(some[-1]) + total)
            near = within_radius(fingerprints(runs[low:high], some - low, total), item["print"])
            for start in some[near]:
                found = similarity(runs[start : start + total], item["kinds"], item["counts"], total)
                if found >= threshold and (best is None or found > best[1]):
                    best = (int(start), found)
    return best


def text_matches(index: list[dict], data: np.ndarray, bounds: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
    """(row, item id, first word, similarity) of all matches in a batch of texts."""
    data = flat.lower_ascii(data)
    starts, ends, before = flat.word_spans(data, bounds)
    hashes = flat.span_hashes(data, starts, ends)
    out = []
    for group in index:
        runs, runs_before = flat.run_hashes(hashes, before, group["size"])
        at = flat.lookup(group["keys"], runs)
        hits = np.flatnonzero(at >= 0)
        if not len(hits):
            continue
        number = group["first"][at[hits] + 1] - group["first"][at[hits]]
        place = np.repeat(hits, number)
        turn = np.arange(len(place)) - np.repeat(np.cumsum(number) - number, number)
        owner = group["owner"][np.repeat(group["first"][at[hits]], number) + turn]
        row = np.searchsorted(runs_before, place, side="right") - 1
        order = np.lexsort((place, owner, row))
        place, owner, row = place[order], owner[order], row[order]
        edges = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (owner[1:] != owner[:-1])]))
        for low, high in zip(edges, np.append(edges[1:], len(row))):
            text, item = int(row[low]), group["items"][owner[low]]
            first = runs_before[text]
            best = _best_window(runs[first : runs_before[text + 1]], place[low:high] - first, item, threshold)
            if best is not None:
                out.append((text, item["id"], *best))
    return out


def item_groups(items: DataFrame, group_bytes: int = ITEM_BYTES) -> list[DataFrame]:
    """The items with a text, in groups of about group_bytes by a hash of the text."""
    usable = items.select("item_id", "text").where("text IS NOT NULL AND text <> ''")
    size = usable.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = int(size // group_bytes) + 1
    return [usable.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == g) for g in range(groups)]


def _indexes(docs: DataFrame, items: DataFrame):
    for group in item_groups(items):
        rows = sorted(((r["item_id"], r["text"]) for r in group.collect()), key=lambda r: (r[0] is None, r[0], r[1]))
        if rows:
            yield docs.sparkSession.sparkContext.broadcast(build_index(rows))


def _match_batches(index, threshold: float):
    def run(batches):
        for batch in flat.pieces(batches, "text"):
            found = text_matches(index.value, *flat.column(batch.column("text")), threshold)
            rows = pa.array([m[0] for m in found], pa.int64())
            columns = [batch.column("doc_id").take(rows), pa.array([m[1] for m in found], pa.int64()), pa.array([m[2] for m in found], pa.int64()), pa.array([m[3] for m in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "first_word", "similarity"])

    return run


def _clean_batches(index, threshold: float):
    def run(batches):
        for batch in flat.pieces(batches, "text"):
            clean = np.ones(batch.num_rows, bool)
            clean[[m[0] for m in text_matches(index.value, *flat.column(batch.column("text")), threshold)]] = False
            yield batch.filter(pa.array(clean))

    return run


def find_matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, first_word and similarity: the best window of every document and item that match."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, first_word long, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _indexes(docs, items):
        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(_match_batches(index, threshold), schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents in which no item is found, all columns as they are."""
    for index in _indexes(docs, items):
        docs = docs.mapInArrow(_clean_batches(index, threshold), docs.schema)
    return docs
