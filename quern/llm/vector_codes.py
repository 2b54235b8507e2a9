"""Vector code compression: eight one-byte codes a vector, entries found by LAESA pivots in exact integers.

Components become whole numbers, vectors are cut into PARTS, and every part has its codebook of ENTRIES,
moved ROUNDS times to the mean of the parts nearest to them. The distances of every part to a few fixed
pivots are computed once and written down beside the vector. In a round only the distances of pivots to
entries are new: by the triangle inequality the difference of the two bounds the distance of part and entry
from below. Entries are tried in the order of their bounds, each by its exact integer distance, until the
next bound exceeds the best distance; as bounds grow, nothing behind can be nearer or equal. The bounds
allow for the rounding of the roots, so they change no result.

Rounds read the written table where it lies; a task adds its parts up, and only sums per entry and component
are shuffled and reach the driver (PARTS * ENTRIES * components numbers), so copies of a vector make no hot
key. Error sums per label are combined before they are shuffled; joining them back is left to AQE.

Null vectors and vectors with null or non-finite components are left out, as are those of another length
than the vector of the smallest kept vec_id. Lengths that PARTS does not divide are cut as evenly as can
be; empty vectors have error 0. Null vec_ids come last. Repeated rows count each; the first entries are the
first ENTRIES rows by vec_id, then by components. Fewer rows make fewer entries; an empty table an empty
result. Components beyond LARGEST count as LARGEST, and errors end at the largest long. Null labels form one
group. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import staged

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
PIVOTS = 4
LARGEST = 1 << 52
#: Components up to here keep every distance and sum of a task within 64 bits; others are Python numbers.
_PLAIN = 1 << 24
_MOST = (1 << 63) - 1
#: Roots are rounded down, and may be off by this and by one part in 1 << _DIGITS.
_SLACK = 2
_DIGITS = 45


def _usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and x, the whole components, of all usable vectors of one length."""
    edge = F.lit(LARGEST).cast("double")
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(-edge, F.least(edge, SCALE * x.cast("double")))).cast("long"))
    rows = vectors.where(_usable(F.col("embedding"))).select("vec_id", "label", whole.alias("x"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x").alias("n")).first()
    return rows.where(F.size("x") == (first["n"] if first else 0))


def cuts(length: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end."""
    return [(i * length // PARTS, (i + 1) * length // PARTS) for i in range(PARTS)]


def _exact(values: np.ndarray) -> np.ndarray:
    """64-bit numbers where all that is computed from them fits, else Python numbers."""
    return values if not values.size or max(values.max(), -values.min()) <= _PLAIN else values.astype(object)


def roots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all points to all pivots, rounded down."""
    points, pivots = points.astype(np.float64), pivots.astype(np.float64)
    return np.stack([np.floor(np.sqrt(((points - p) ** 2).sum(axis=1))) for p in pivots], axis=1).astype(np.int64)


def nearest_entries(points: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every point, the lowest of equally near ones, and its squared distance."""
    bounds = np.zeros((len(points), len(entries)), np.int64)
    for p in range(to_pivots.shape[1]):
        far, near = np.maximum(to_pivots[:, p, None], entry_pivots[None, :, p]), np.minimum(to_pivots[:, p, None], entry_pivots[None, :, p])
        np.maximum(bounds, far - near - (far >> _DIGITS) - _SLACK, out=bounds)
    order = np.argsort(bounds, axis=1, kind="stable")
    kind = object if object in (points.dtype, entries.dtype) else np.int64
    bounds, points, entries = bounds.astype(kind), points.astype(kind), entries.astype(kind)
    best = np.full(len(points), 1 << 200 if kind is object else _MOST, kind)
    which = np.zeros(len(points), np.int64)
    active = np.arange(len(points))
    for turn in range(len(entries)):
        entry = order[active, turn]
        bound = bounds[active, entry]
        live = (bound * bound <= best[active]).astype(bool)
        active, entry = active[live], entry[live]
        if not len(active):
            break
        distance = ((points[active] - entries[entry]) ** 2).sum(axis=1)
        nearer = ((distance < best[active]) | ((distance == best[active]) & (entry < which[active]))).astype(bool)
        best[active[nearer]], which[active[nearer]] = distance[nearer], entry[nearer]
    return which, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _pivot_batches(pivots: list[np.ndarray], length: int):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), length)
            found = [roots(x[:, a:b], p) for (a, b), p in zip(cuts(length), pivots)]
            flat = np.concatenate(found, axis=1) if len(x) else np.zeros((0, 0), np.int64)
            width = sum(len(p) for p in pivots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "to_pivots"])

    return run


def spread_pivots(entries: np.ndarray) -> np.ndarray:
    """A few of the entries, each as far as can be from those before it."""
    chosen, far = [0], np.full(len(entries), np.inf)
    while len(chosen) < min(PIVOTS, len(entries)):
        far = np.minimum(far, ((entries.astype(np.float64) - entries[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    return entries[chosen]


class Coder:
    """Codebooks and pivots of all parts; assigns the rows of a batch part by part."""

    def __init__(self, books: list[np.ndarray], pivots: list[np.ndarray], length: int):
        self.books, self.pivots, self.length = books, pivots, length
        self.entry_pivots = [roots(b, p) for b, p in zip(books, pivots)]

    def parts(self, batch):
        """(points, entry of each, squared distance of each) for one part after another."""
        x = _exact(_matrix(batch.column("x"), self.length))
        far, at = _matrix(batch.column("to_pivots"), sum(len(p) for p in self.pivots)), 0
        for (a, b), book, pivots, between in zip(cuts(self.length), self.books, self.pivots, self.entry_pivots):
            which, distance = nearest_entries(x[:, a:b], far[:, at : at + len(pivots)], _exact(book), between)
            at += len(pivots)
            yield x[:, a:b], which, distance


def _sum_batches(coder: Coder):
    """(slot, pos, total): per part and entry the count (pos -1) and the sum of every component."""

    def run(batches):
        counts = np.zeros((PARTS, ENTRIES), np.int64)
        sums: list = [[0] * ENTRIES for _ in range(PARTS)]
        for batch in batches:
            for part, (points, which, _) in enumerate(coder.parts(batch)):
                for entry in np.unique(which):
                    own = points[which == entry]
                    counts[part, entry] += len(own)
                    sums[part][entry] = sums[part][entry] + own.sum(axis=0).astype(object)
        rows = []
        for part, entry in zip(*np.nonzero(counts)):
            values = [counts[part, entry], *sums[part][entry]]
            rows += [(int(part) * ENTRIES + int(entry), pos - 1, Decimal(int(v))) for pos, v in enumerate(values)]
        columns = list(zip(*rows)) or [(), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["slot", "pos", "total"])

    return run


def next_books(rows: DataFrame, coder: Coder) -> list[np.ndarray]:
    """The codebooks moved to the means, rounded down, of the parts nearest to their entries."""
    sums = rows.select("x", "to_pivots").mapInArrow(_sum_batches(coder), "slot int, pos int, total decimal(38,0)")
    got = sums.groupBy("slot", "pos").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    totals = {(r["slot"], r["pos"]): int(r["total"]) for r in got}  # at most an entry's count and components each
    books = [book.copy() for book in coder.books]
    for (slot, pos), total in totals.items():
        if pos >= 0:
            books[slot // ENTRIES][slot % ENTRIES, pos] = total // totals[slot, -1]
    return books


def _code_batches(coder: Coder):
    def run(batches):
        for batch in batches:
            codes, errors = [], []
            for _, which, distance in coder.parts(batch):
                codes.append(which)
                errors.append(distance.astype(object))
            text = [bytes(row).hex() for row in np.stack(codes, axis=1).astype(np.uint8)]
            error = pa.array([min(int(e), _MOST) for e in sum(errors)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), error], names=["vec_id", "label", "code", "error"])

    return run


def books_text(books: list[np.ndarray]) -> str:
    return ",".join(str(int(v)) for book in books for entry in book for v in entry)


def compress(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of all usable vectors, written once, and the final codebooks."""
    whole = whole_vectors(vectors)
    kinds = {name: whole.schema[name].dataType.simpleString() for name in ("vec_id", "label")}
    coded = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], coded), []
    length = len(first[0]["x"])
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), length)
    books = [start[:, a:b] for a, b in cuts(length)]
    pivots = [spread_pivots(book) for book in books]
    measured = whole.mapInArrow(_pivot_batches(pivots, length), f"vec_id {kinds['vec_id']}, label {kinds['label']}, x array<long>, to_pivots array<long>")
    rows = staged(measured, "parts")
    for _ in range(ROUNDS):
        books = next_books(rows, Coder(books, pivots, length))
    return staged(rows.mapInArrow(_code_batches(Coder(books, pivots, length)), coded), "codes"), books


def code_digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (the errors of equal labels added up) and codebooks_sha256."""
    codes, books = compress(vectors)
    totals = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")).withColumnRenamed("label", "of")
    found = codes.join(totals, F.col("label").eqNullSafe(F.col("of")))
    total = F.least(F.col("total"), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return found.select("vec_id", "code", "error", total.alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
