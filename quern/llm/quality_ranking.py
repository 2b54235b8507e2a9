"""Quality classifier: Bradley-Terry ranking over text features.

Every labeled bad text loses against labeled good texts, and every labeled good text wins against a bad one.
The score u = w.x of a text is learned so that sigmoid(u_good - u_bad) is likely over these pairs (logistic
loss on feature differences, ridge penalty, Newton steps). The threshold is the quantile of the training scores
at the share of bad texts, and score = sigmoid(u - threshold + logit(CUT)), so a text is accepted when it scores
CUT or more.

The model is fitted on all labeled rows. Their features are sorted once, which settles the pairs, and kept in the
shared folder in blocks of BLOCK rows; a pass over them adds up one sum a block for the mean, the deviation, each
Newton step and each byte of the threshold. The sums are all that reaches the driver, which adds them in the order
of the blocks, so tasks and their order change no bit of the model.

Null text: as an empty text, which has features of its own and a score. Empty table: empty result. No
usable labels, or only one class: every text scores 0.5. Rows are scored one by one, so equal texts score
equally and repeated rows give a row each. Several labels for one doc_id count as several rows; null
labels are not used. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import flat
from quern.llm.columns import remainder
from quern.operators.ordering import number_rows
from quern.session import discard, staged

#: Good texts that every bad text is compared with, or more where good texts would be left without a pair.
RIVALS = 8
#: Labeled rows, or pairs of them, whose features are one value of a table.
BLOCK = 2048
RIDGE = 1e-2
CUT = 0.3
FOLDS = 5

_CLASSES = np.full(256, 7, np.uint8)  # other ASCII
_CLASSES[97:123] = 0  # small letters
_CLASSES[65:91] = 1  # capitals
_CLASSES[48:58] = 2  # digits
_CLASSES[[32, 9, 11, 12, 13]] = 3
_CLASSES[10] = 4
_CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASSES[[ord(c) for c in "!#*$%&|<>@=_~^+/\\{}[]"]] = 6
_CLASSES[128:192] = 8  # bytes within a character
_CLASSES[192:] = 9  # first bytes of others
_LINE = np.zeros(256, bool)
_LINE[10] = True
FEATURES = 18


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of numbers for every text."""
    rows = len(bounds) - 1
    lengths = np.diff(bounds)
    row_of = np.repeat(np.arange(rows), lengths)
    counts = np.bincount(row_of * 10 + _CLASSES[data], minlength=10 * rows).reshape(rows, 10).astype(float)
    starts, ends, before = flat.word_spans(data, bounds)
    words = np.diff(before).astype(float)
    hashes = flat.span_hashes(flat.lower_ascii(data), starts, ends)
    distinct = np.diff(flat.distinct_in_rows(hashes, before)[1])
    pairs, pairs_before = flat.run_hashes(hashes, before, 2)
    pair_kinds = np.diff(flat.distinct_in_rows(pairs, pairs_before)[1])
    last = _CLASSES[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    first = _CLASSES[data[starts]] if len(starts) else np.zeros(0, np.uint8)
    single = (ends - starts) == 1
    line_starts, line_ends, lines_before = flat.word_spans(data, bounds, _LINE)
    lines = np.diff(lines_before).astype(float)
    line_kinds = np.diff(flat.distinct_in_rows(flat.span_hashes(data, line_starts, line_ends), lines_before)[1])

    def share(part, whole):
        return part / np.maximum(whole, 1)

    visible = np.maximum(lengths - counts[:, 3] - counts[:, 4], 1)
    of_words = lambda mask: share(flat.row_sums(mask.astype(np.int64), before), words)
    out = [
        np.log1p(words),
        np.log1p(lines),
        share(counts[:, 0], visible),
        share(counts[:, 1], visible),
        share(counts[:, 2], visible),
        share(counts[:, 5], visible),
        np.log1p(100 * share(counts[:, 6], visible)),
        share(counts[:, 9], visible),
        np.log1p(100 * share(counts[:, 7], visible)),
        np.log1p(share(visible, words)),
        share(distinct, words) * np.log1p(words),
        1 - share(distinct, words),
        1 - share(pair_kinds, np.maximum(words - 1, 1)),
        1 - share(line_kinds, lines),
        np.log1p(100 * of_words(last == 6)),
        of_words(first == 1),
        of_words(single),
        (words == 0).astype(float),
    ]
    return np.stack(out, axis=1)


def _feature_rows(batches):
    for batch in flat.pieces(batches, "text"):
        made = features(*flat.column(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.FixedSizeListArray.from_arrays(made.ravel(), FEATURES).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])


def rivals(good: int, bad: int) -> tuple[int, int]:
    """Pairs of a bad text and the step between their good texts: pair p has bad text p // pairs and good text p * step % good."""
    return max(RIVALS, -(-good // bad)), next(s for s in count(7919) if math.gcd(s, good) == 1)


def _rising(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63))).view(np.uint64)


def _at_places(rows: Callable, made: Callable, places: list[int]) -> np.ndarray:
    """The numbers that stand at the places of the sorted made(x), found byte by byte in a pass each."""
    found = [0] * len(places)
    for shift in range(56, -1, -8):

        def tally(x, found=tuple(found), shift=shift):
            keys = _rising(made(x))
            above, byte = keys >> np.uint64(shift) >> np.uint64(8), (keys >> np.uint64(shift) & np.uint64(255)).astype(np.int64)
            return np.stack([np.bincount(byte[above == np.uint64(f)], minlength=256) for f in found])

        upto = np.cumsum(rows(tally), axis=1)
        bytes_ = [int(np.searchsorted(u, p, side="right")) for u, p in zip(upto, places)]
        places = [p - (int(u[b - 1]) if b else 0) for u, p, b in zip(upto, places, bytes_)]
        found = [f << 8 | b for f, b in zip(found, bytes_)]
    keys = np.array(found, np.uint64)
    return np.where(keys >> np.uint64(63), keys ^ np.uint64(1 << 63), ~keys).view(np.float64)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def _learn(number: int, bad: int, width: int, rows: Callable, pairs: Callable, steps: int = 25) -> dict:
    """rows(f): the sum of f(x) over blocks x of all rows; pairs(f): of f(good, bad) over blocks of all pairs."""
    mean = rows(lambda x: x.sum(axis=0)) / number
    scale = np.sqrt(rows(lambda x: ((x - mean) ** 2).sum(axis=0)) / number)
    scale[scale < 1e-9] = 1.0
    w = np.zeros(width)
    for _ in range(steps):

        def sums(good, lost, w=w.copy()):
            d = _standard(good, mean, scale) - _standard(lost, mean, scale)
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            curve = (d * (p * (1 - p))[:, None]).T @ d
            return np.vstack([d.T @ (p - 1), curve, np.full(width, float(len(d)))])

        total = pairs(sums)
        slope = total[0] / total[-1] + RIDGE * w
        curve = total[1:-1] / total[-1] + RIDGE * np.eye(width)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 2.0 / max(1e-12, float(np.linalg.norm(step))))
        if np.linalg.norm(step) < 1e-6:
            break
    at = min(max(1, bad), number - 1)
    threshold = _at_places(rows, lambda x: _standard(x, mean, scale) @ w, [at - 1, at]).sum() / 2
    return {"mean": mean, "scale": scale, "w": w, "threshold": float(threshold)}


def fit(labels: np.ndarray, x: np.ndarray, steps: int = 25) -> dict | None:
    """Weights and threshold from labeled feature rows in memory; None without both classes."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return None
    each, step = rivals(len(good), len(bad))
    pair = np.arange(len(bad) * each)
    won, lost = x[good[pair * step % len(good)]], x[bad[pair // each]]
    return _learn(len(x), len(bad), x.shape[1], lambda f: f(x), lambda f: f(won, lost), steps)


def _blocks(parts: DataFrame, each: int | None = None) -> DataFrame:
    """parts: block, good, at, x. Their rows in the order of at, a value a block; with each, the rows of pairs, bad ones as often as they are in one."""

    def pack(key, table):
        good, at = (table.column(n).to_numpy(zero_copy_only=False) for n in ("good", "at"))
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
        won, lost = (np.flatnonzero(good == side) for side in (1, 0))
        won, lost = won[np.argsort(at[won])], lost[np.argsort(at[lost])]
        if each is not None:
            lost = lost[at[won] // each - at[lost[0]]]
        return pa.table({"block": [key[0].as_py()], "won": [x[won].tobytes()], "lost": [x[lost].tobytes()]}, schema=pa.schema([("block", pa.int64()), ("won", pa.binary()), ("lost", pa.binary())]))

    return staged(parts.groupBy("block").applyInArrow(pack, "block long, won binary, lost binary"), "blocks")


def _sum_of(blocks: DataFrame, *names: str) -> Callable:
    """A function that sums f over the blocks, in their order."""

    def total(f):
        def run(batches):
            for batch in batches:
                columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
                for row, block in enumerate(batch.column(0)):
                    made = np.asarray(f(*[np.frombuffer(c[row].as_buffer(), np.float64).reshape(-1, FEATURES).copy() for c in columns]), np.float64)
                    yield pa.RecordBatch.from_pydict({"block": [block.as_py()], "shape": [list(made.shape)], "made": [made.tobytes()]}, schema=out)

        out = pa.schema([("block", pa.int64()), ("shape", pa.list_(pa.int64())), ("made", pa.binary())])
        got = sorted(blocks.select("block", *names).mapInArrow(run, "block long, shape array<long>, made binary").collect(), key=lambda r: r["block"])
        sums = np.zeros(got[0]["shape"])
        for r in got:
            sums += np.frombuffer(r["made"], np.float64).reshape(sums.shape)
        return sums

    return total


def scores(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    u = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"] - model["threshold"]
    return 1 / (1 + np.exp(-np.clip(u + np.log(CUT / (1 - CUT)), -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """docs: doc_id, text. labels: doc_id, quality (0 or 1) of the rows that may be learned from; all of them are."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(_feature_rows, f"doc_id {kind}, x array<double>")
    met = made.join(usable.hint("shuffle_merge"), "doc_id")  # at no size through the driver
    rows = staged(met.select("label", "x", F.monotonically_increasing_id().alias("tie")), "labeled")
    number = dict(rows.groupBy("label").count().collect())
    bad, good = number.get(0, 0), number.get(1, 0)
    if not good or not bad:
        discard(rows)
        return None
    # bad rows come first; equal rows are exchangeable, and the tie deals them out to tasks
    placed = number_rows(rows, [F.col("label"), F.col("x"), F.col("tie")]).selectExpr("label", "x", "row_ix - 1 AS at")
    whole = _blocks(placed.selectExpr(f"at div {BLOCK} AS block", "0 AS good", "at", "x"))
    each, step = rivals(good, bad)
    pairs, back = bad * each, pow(step, -1, good)
    last = f"{pairs - 1}L"
    lost = placed.where("label = 0").selectExpr(f"explode(sequence(at * {each} div {BLOCK}, (at * {each} + {each - 1}) div {BLOCK})) AS block", "0 AS good", "at", "x")
    first = placed.where("label = 1").selectExpr(f"(at - {bad}) * {back} % {good} AS p", "x").where(f"p < {pairs}")  # and every `good` pairs on
    runs = first.selectExpr(f"explode(sequence(p, {last}, {good * BLOCK}L)) AS p", "x")  # bounded ones, however many bad rows there are
    won = runs.selectExpr(f"explode(sequence(p, least(p + {good * (BLOCK - 1)}L, {last}), {good}L)) AS at", "x")
    met = _blocks(lost.unionByName(won.selectExpr(f"at div {BLOCK} AS block", "1 AS good", "at", "x")), each)
    discard(rows)
    model = _learn(good + bad, bad, FEATURES, _sum_of(whole, "lost"), _sum_of(met, "won", "lost"))
    discard(whole, met)
    return model


def score_batches(model: dict | None, text: str = "text"):
    """For mapInArrow: the columns of each batch and `score`, a number from 0 to 1."""

    def run(batches):
        for batch in flat.pieces(batches, text):
            found = scores(model, features(*flat.column(batch.column(text))))
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != text]
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], names=[*names, "score"])

    return run


def accept_batches(model: dict | None, text: str = "text", cut: float = CUT):
    """For mapInArrow: the rows of each batch that score at least `cut`, unchanged."""

    def run(batches):
        for batch in flat.pieces(batches, text):
            yield batch.filter(pa.array(scores(model, features(*flat.column(batch.column(text)))) >= cut))

    return run


def held_out(key: Column) -> Column:
    return F.coalesce(remainder(key, FOLDS) == 0, F.lit(False))


def rank_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of held-out rows are not read."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(score_batches(model), f"doc_id {kind}, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, all columns as they are."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return docs.mapInArrow(accept_batches(model), docs.schema)
