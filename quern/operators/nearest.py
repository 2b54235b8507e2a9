"""Nearest chunks for a batch of questions: exact, by cells, or by hashed signs.

Every form reads the chunks where they lie and moves only survivors: each task scores its Arrow batches
against the questions with one matrix product, keeps the best ``k`` per question, and hands on at most ``k``
rows per question. Over very many tasks that would be too much; so pilots over a few, then ever more tasks
find distances that the ``k`` nearest cannot exceed, and the tasks hand on only what is as near. No form
pairs rows in a join.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.ordering import top_per_group
from quern.session import durable, scratch_path

# So many questions, bytes of them, and results for them, are sent to every task at once; more go in slices.
MAX_SENT_QUESTIONS = 8192
MAX_SENT_BYTES = 32 << 20
MAX_KEPT_PAIRS = 1_000_000
BLOCK_ROWS = 4096
BLOCK_QUESTIONS = 1024
PAIR_SLICE = 65_536
# Tasks of the first pilot; how many times as many each following pass has.
PILOT_TASKS = 64
PILOT_GROWTH = 32

SCORED = "query_id long, item_id long, chunk_ix int, dist double"
ARROW_SCORED = pa.schema(
    [("query_id", pa.int64()), ("item_id", pa.int64()), ("chunk_ix", pa.int32()), ("dist", pa.float64())]
)


@dataclass
class Questions:
    """A question table, with its vectors at hand when the batch is small enough to send out."""

    frame: DataFrame
    ids: np.ndarray | None
    vectors: np.ndarray | None

    def bounded(self, k: int) -> bool:
        """Whether the batch, and ``k`` results for each question, may be held by every task."""
        return self.ids is not None and len(self.ids) * max(k, 1) <= MAX_KEPT_PAIRS


def prepare(questions: DataFrame, limit: int = MAX_SENT_QUESTIONS) -> Questions:
    """Read at most ``limit`` + 1 questions to learn whether the batch may be broadcast."""
    frame = questions.select("query_id", "embedding")
    head = frame.limit(limit + 1).toArrow()
    if head.num_rows > limit or head.nbytes > MAX_SENT_BYTES:
        return Questions(frame, None, None)
    ids, vectors = _question_arrays(head)
    return Questions(frame, ids, vectors)


def _question_arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    asked = table.filter(table.column("embedding").is_valid())
    return asked.column("query_id").to_numpy().astype(np.int64), _matrix(asked.column("embedding"))


def _matrix(lists) -> np.ndarray:
    """Equally long lists as a matrix: floats as they are, anything else as doubles."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n = len(lists)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if flat.dtype != np.float32:
        flat = flat.astype(np.float64)
    if n == 0:
        return flat.reshape(0, 0)
    if len(flat) % n or len(set(lists.value_lengths().unique().to_pylist())) != 1:
        raise ValueError("embeddings differ in width")
    return flat.reshape(n, len(flat) // n)


def _with_vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows that have a vector. A filter in Spark would make it compute a derived vector twice."""
    vectors = batch.column("embedding")
    return batch.filter(vectors.is_valid()) if vectors.null_count else batch


def _pair_distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Row-by-row distance in doubles, computed without the cancellation of the matrix form."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    if metric == "l2":
        return np.sqrt(np.square(a - b).sum(axis=1))
    norms = np.sqrt(np.square(a).sum(axis=1)) * np.sqrt(np.square(b).sum(axis=1))
    dots = (a * b).sum(axis=1)
    # A zero vector has no direction, hence no similarity.
    return 1.0 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


class _Best:
    """The best ``k`` pairs per question seen so far by one task.

    New pairs wait until there are about as many as kept ones, so sorting stays cheap per pair. The
    ``k``-th kept pair of a question bounds what may still enter; the bound only ever falls.
    """

    def __init__(self, n_questions: int, k: int, bounds: np.ndarray | None = None):
        self.k = k
        self.room = max(n_questions * k, PAIR_SLICE)
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.float64))
        self.parts = [empty]
        self.waiting = 0
        self.worst = np.full(n_questions, np.inf) if bounds is None else bounds.copy()
        self.worst_item = np.full(n_questions, np.iinfo(np.int64).max)
        self.worst_chunk = np.full(n_questions, np.iinfo(np.int32).max, np.int32)

    def add(self, question, item, chunk, dist) -> None:
        """Take the pairs that precede their question's bound by distance, item and chunk."""
        worst, tie = self.worst[question], self.worst_item[question]
        before = (item < tie) | ((item == tie) & (chunk < self.worst_chunk[question]))
        enter = (dist < worst) | ((dist == worst) & before)
        if enter.any():
            self.parts.append((question[enter], item[enter], chunk[enter], dist[enter]))
            self.waiting += int(enter.sum())
            if self.waiting >= self.room:
                self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        question, item, chunk, dist = (np.concatenate(column) for column in zip(*self.parts))
        order = np.lexsort((chunk, item, dist, question))
        asked = question[order]
        starts = np.flatnonzero(np.diff(asked, prepend=-1))
        sizes = np.diff(starts, append=len(asked))
        rank = np.arange(len(asked)) - np.repeat(starts, sizes)
        full = starts[sizes >= self.k]
        last = order[full + self.k - 1]
        self.worst[asked[full]] = dist[last]
        self.worst_item[asked[full]] = item[last]
        self.worst_chunk[asked[full]] = chunk[last]
        keep = order[rank < self.k]
        kept = question[keep], item[keep], chunk[keep], dist[keep]
        self.parts, self.waiting = [kept], 0
        return kept


class _Asked:
    """A task's questions, shaped so that one matrix product per block gives rough scores.

    Products run in the width of the stored vectors. ``margin`` is above the rounding error of a
    product of that width, so no pair is lost to it.
    """

    def __init__(self, vectors: np.ndarray, metric: str, width: np.dtype):
        self.vectors, self.metric = vectors, metric
        self.squares = np.square(vectors.astype(np.float64)).sum(axis=1)
        self.error = (vectors.shape[1] + 8) * float(np.finfo(width).eps)
        narrow = vectors.astype(width)
        if metric == "l2":
            self.left = np.hstack([-2 * narrow, np.ones((len(narrow), 1), width)])
        else:
            self.left = -_unit(narrow, self.squares)

    def rough(self, questions: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, float]:
        """Scores that order like distances, and the largest square among the rows."""
        squares = np.einsum("ij,ij->i", block, block)
        right = np.hstack([block, squares[:, None]]) if self.metric == "l2" else _unit(block, squares)
        return self.left[questions] @ right.T, float(squares.max())

    def limit(self, questions: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """The rough score that stands for a distance."""
        return np.square(worst) - self.squares[questions] if self.metric == "l2" else worst - 1.0

    def margin(self, questions: np.ndarray, largest: float) -> np.ndarray:
        if self.metric == "cosine":
            return np.full(len(questions), 1e-12 + 2 * self.error)
        squares = self.squares[questions]
        return 1e-12 * (1.0 + squares + largest) + 2 * self.error * (2.0 * np.sqrt(squares * largest) + largest)


def _unit(vectors: np.ndarray, squares: np.ndarray) -> np.ndarray:
    norms = np.sqrt(squares).astype(vectors.dtype)[:, None]
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _add_pairs(best: _Best, qi, ci, items, chunk_ixs, vectors, asked: _Asked) -> None:
    for at in range(0, len(qi), PAIR_SLICE):
        q, c = qi[at : at + PAIR_SLICE], ci[at : at + PAIR_SLICE]
        best.add(q, items[c], chunk_ixs[c], _pair_distance(vectors[c], asked.vectors[q], asked.metric))


def _score_block(best: _Best, rows, items, chunk_ixs, vectors, questions, asked: _Asked) -> None:
    """Score the given rows against the given questions.

    The matrix product only preselects, with a margin above its rounding error; the distance that
    ranks a pair is always the directly computed one.
    """
    block = vectors[rows]
    for at in range(0, len(questions), BLOCK_QUESTIONS):
        qs = questions[at : at + BLOCK_QUESTIONS]
        rough, largest = asked.rough(qs, block)
        bound = asked.limit(qs, best.worst[qs])
        # A question with fewer than k pairs so far takes at most this block's k best, and ties.
        fresh = np.flatnonzero(np.isinf(bound))
        if len(fresh) and rough.shape[1] > best.k:
            bound[fresh] = np.partition(rough[fresh], best.k - 1, axis=1)[:, best.k - 1]
        # Rounded up, so that narrowing the bound to the product's width loses nothing.
        bound = np.nextafter((bound + asked.margin(qs, largest)).astype(rough.dtype), rough.dtype.type(np.inf))
        qi, ci = np.nonzero(rough <= bound[:, None])
        _add_pairs(best, qs[qi], rows[ci], items, chunk_ixs, vectors, asked)


def _exact_batch(best, items, chunk_ixs, vectors, asked, extra, probe) -> None:
    everyone = np.arange(len(asked.vectors))
    for at in range(0, len(items), BLOCK_ROWS):
        rows = np.arange(at, min(at + BLOCK_ROWS, len(items)))
        _score_block(best, rows, items, chunk_ixs, vectors, everyone, asked)


def _cell_batch(best, items, chunk_ixs, vectors, asked, extra, probe) -> None:
    """Each cell's rows meet only the questions that probe the cell."""
    order = np.argsort(extra, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(extra[order]) != 0, True])
    for start, end in zip(edges[:-1], edges[1:]):
        asking = np.flatnonzero(probe[:, extra[order[start]]])
        if not len(asking):
            continue
        for at in range(start, end, BLOCK_ROWS):
            rows = order[at : min(at + BLOCK_ROWS, end)]
            _score_block(best, rows, items, chunk_ixs, vectors, asking, asked)


def _shared_signs(asked: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Question and row numbers of the pairs that share a signature, found by sorted lookup."""
    shared = np.zeros((len(asked), len(block)), bool)
    for table in range(block.shape[1]):
        order = np.argsort(block[:, table], kind="stable")
        held = block[order, table]
        first = np.searchsorted(held, asked[:, table], "left")
        sizes = np.searchsorted(held, asked[:, table], "right") - first
        question = np.repeat(np.arange(len(asked)), sizes)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
        shared[question, order[place]] = True
    return np.nonzero(shared)


def _sign_batch(best, items, chunk_ixs, vectors, asked, extra, probe) -> None:
    """A pair is scored when the two share the signature of at least one table."""
    planes, q_signs = probe
    signs = _signatures(vectors, planes)
    for at in range(0, len(items), BLOCK_ROWS):
        block = signs[at : at + BLOCK_ROWS]
        for qat in range(0, len(asked.vectors), BLOCK_QUESTIONS):
            qi, ci = _shared_signs(q_signs[qat : qat + BLOCK_QUESTIONS], block)
            _add_pairs(best, qi + qat, ci + at, items, chunk_ixs, vectors, asked)


def _useful_copies(vectors: np.ndarray, items: np.ndarray, chunk_ixs: np.ndarray, k: int) -> np.ndarray:
    """Rows to score: of equal vectors only the ``k`` first by id can be among the ``k`` nearest.

    Rows meet by a hash of their bits; a row is left out only when it equals its group's first row.
    """
    bits = np.ascontiguousarray(vectors).view(f"u{vectors.itemsize}")
    odd = np.arange(1, 2 * bits.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, group, sizes = np.unique((bits * odd).sum(axis=1, dtype=np.uint64), return_inverse=True, return_counts=True)
    if sizes.max() <= k:
        return np.arange(len(items))
    order = np.lexsort((chunk_ixs, items, group))
    starts = np.cumsum(sizes) - sizes
    rank = np.arange(len(order)) - np.repeat(starts, sizes)
    late = np.flatnonzero(rank >= k)
    first = order[np.repeat(starts, sizes)[late]]
    copies = (vectors[order[late]] == vectors[first]).all(axis=1)
    return np.delete(order, late[copies])


def _scan(batches: Iterable[pa.RecordBatch], q_ids, q_vectors, k, metric, score, probe, bounds) -> Iterator[pa.RecordBatch]:
    best = _Best(len(q_ids), k, bounds)
    asked = None
    for batch in batches:
        batch = _with_vectors(batch)
        if batch.num_rows == 0 or not len(q_ids):
            continue
        vectors = _matrix(batch.column("embedding"))
        asked = asked or _Asked(q_vectors, metric, vectors.dtype)
        if vectors.shape[1] != q_vectors.shape[1]:
            raise ValueError(f"chunk width {vectors.shape[1]} differs from question width {q_vectors.shape[1]}")
        items = batch.column("item_id").to_numpy()
        chunk_ixs = batch.column("chunk_ix").to_numpy()
        rows = _useful_copies(vectors, items, chunk_ixs, k)
        extra = batch.column("cell").to_numpy()[rows] if "cell" in batch.schema.names else None
        score(best, items[rows], chunk_ixs[rows], vectors[rows], asked, extra, probe)
    question, item, chunk, dist = best.settle()
    columns = [q_ids[question], item, chunk, dist]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=ARROW_SCORED)


def _merge(local: DataFrame, k: int) -> DataFrame:
    order = [F.col("dist"), F.col("item_id"), F.col("chunk_ix")]
    ranked = top_per_group(local, ["query_id"], order, k, ["item_id", "chunk_ix"], out="cand_ix")
    return ranked.select("query_id", "item_id", "chunk_ix", "dist", (1 - F.col("dist")).alias("sim"), "cand_ix")


def _sent(questions: Questions, chunks: DataFrame, k: int, metric: str, score, probe, bounds=None, tasks: int | None = None) -> DataFrame:
    """Each task's best ``k``, no farther than the questions' bounds; of a pilot only the first tasks read."""
    held = chunks.sparkSession.sparkContext.broadcast((questions.ids, questions.vectors, probe, bounds))

    def best_of_partition(batches):
        if tasks is None or TaskContext.get().partitionId() < tasks:
            ids, vectors, prepared, limits = held.value
            yield from _scan(batches, ids, vectors, k, metric, score, prepared, limits)

    return chunks.mapInArrow(best_of_partition, SCORED)


def _tasks(chunks: DataFrame) -> int:
    """Tasks that read the chunks; 0 where there are so few that no pilot pays, by the size that Spark expects."""
    size = int(str(chunks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    per_task = chunks.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return chunks.rdd.getNumPartitions() if size // per_task >= PILOT_TASKS * PILOT_GROWTH else 0


def survivors(questions: Questions, chunks: DataFrame, k: int, metric: str, score, probe) -> DataFrame:
    """What all tasks hand on for one slice of questions.

    The k-th distance over any part of the chunks bounds the one over all. With n tasks the passes have
    PILOT_TASKS tasks, PILOT_GROWTH times as many, and so on up to all n; a pass hands on about
    ``k`` times PILOT_GROWTH rows per question, however many tasks it has, and the pilots read a small
    part of the chunks again.
    """
    n, tasks, bounds = _tasks(chunks), PILOT_TASKS, None
    place = {int(q): i for i, q in enumerate(questions.ids)}
    while len(place) == len(questions.ids) and tasks * PILOT_GROWTH <= n:
        found = _merge(_sent(questions, chunks, k, metric, score, probe, bounds, tasks), k)
        last = found.filter(F.col("cand_ix") == k).select("query_id", "dist").toArrow()  # one row per question of the slice
        bounds = np.full(len(questions.ids), np.inf) if bounds is None else bounds
        at = [place[q] for q in last.column("query_id").to_pylist()]
        bounds[at] = np.minimum(bounds[at], last.column("dist").to_numpy())
        tasks *= PILOT_GROWTH
    return _sent(questions, chunks, k, metric, score, probe, bounds)


def _slices(questions: Questions, k: int):
    """A question batch as batches of bounded size, read one after another."""
    if questions.bounded(k):
        yield questions
        return
    per_slice = max(1, min(MAX_SENT_QUESTIONS, MAX_KEPT_PAIRS // max(k, 1)))
    parts = max(1, 2 * math.ceil(questions.frame.count() / per_slice))
    for part in range(parts):
        table = questions.frame.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow()
        ids, vectors = _question_arrays(table)
        for at in range(0, len(ids), per_slice):
            yield Questions(questions.frame, ids[at : at + per_slice], vectors[at : at + per_slice])


def _best(questions: Questions, chunks: DataFrame, k: int, metric: str, score, make_probe, only=None) -> DataFrame:
    """The k best of every question. only(vectors): the chunks that a slice of questions needs.

    A slice is sent to the tasks and the chunks are read where they lie; a batch of several slices reads
    them once a slice, each slice adding its survivors to one folder, so nothing but survivors moves.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    k = max(k, 1)

    def local(part: Questions) -> DataFrame:
        needed = chunks if only is None else only(part.vectors)
        return survivors(part, needed, k, metric, score, make_probe(part.vectors))

    if questions.bounded(k):
        return _merge(local(questions), k)
    path = scratch_path(chunks.sparkSession, "survivors")
    chunks.sparkSession.createDataFrame([], SCORED).write.parquet(path)
    for part in _slices(questions, k):
        local(part).write.mode("append").parquet(path)
    return _merge(chunks.sparkSession.read.schema(SCORED).parquet(path), k)


def nearest(questions: Questions, chunks: DataFrame, k: int = 80, metric: str = "l2") -> DataFrame:
    """The exact ``k`` nearest chunks per question, ranked from 1 in ``cand_ix``; ties by id."""
    columns = chunks.select("item_id", "chunk_ix", "embedding")
    return _best(questions, columns, k, metric, _exact_batch, lambda vectors: None)


# --- approximate: inverted lists ---------------------------------------------------------------


def train_cells(chunks: DataFrame, n_cells: int, seed: int = 7) -> np.ndarray:
    """Centroids by k-means over all chunks that have a vector."""
    vectors = chunks.filter(F.col("embedding").isNotNull()).select(array_to_vector("embedding").alias("features"))
    # Kept in the shared folder, as training reads them again and again.
    model = KMeans(k=n_cells, seed=seed, maxIter=10).fit(durable(vectors))
    return np.array(model.clusterCenters(), dtype=np.float64)


def centroid_matrix(centroids: DataFrame, order: str) -> np.ndarray:
    """The ``embedding`` rows of a table as cells 0, 1, … in the given column's order.

    The caller chose the number of cells when the index was built; every task holds them all.
    """
    return _matrix(centroids.select(order, "embedding").orderBy(order).toArrow().column("embedding"))


def _cell_distance(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return np.square(vectors).sum(axis=1)[:, None] + np.square(centroids).sum(axis=1) - 2.0 * vectors @ centroids.T


def assign_cells(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Chunks that have a vector, with their nearest cell; texts are left behind."""
    held = chunks.sparkSession.sparkContext.broadcast(centroids)
    columns = chunks.drop("chunk_text", "cell")
    schema = T.StructType([*columns.schema.fields, T.StructField("cell", T.IntegerType())])

    def with_cell(batches):
        for batch in map(_with_vectors, batches):
            if batch.num_rows:
                near = _cell_distance(_matrix(batch.column("embedding")), held.value).argmin(axis=1)
                yield batch.append_column("cell", pa.array(near.astype(np.int32)))

    return columns.mapInArrow(with_cell, schema)


@dataclass
class CellIndex:
    """Chunks by cell, and the cells' centroids."""

    chunks: DataFrame
    centroids: np.ndarray

    def save(self, path: str) -> None:
        """Chunks in one folder per cell, so that a search reads only the cells it probes.

        A range cut by cell gives a folder few files, and a large cell several.
        """
        spark = self.chunks.sparkSession
        self.chunks.repartitionByRange("cell", "item_id").write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/chunks")
        rows = [(cell, vector.tolist()) for cell, vector in enumerate(self.centroids)]
        spark.createDataFrame(rows, "cell int, embedding array<double>").write.parquet(f"{path}/centroids")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CellIndex:
        centroids = centroid_matrix(spark.read.parquet(f"{path}/centroids"), "cell")
        return CellIndex(spark.read.parquet(f"{path}/chunks"), centroids)


def build_cells(chunks: DataFrame, n_cells: int) -> CellIndex:
    centroids = train_cells(chunks, n_cells)
    return CellIndex(assign_cells(chunks, centroids), centroids)


def nearest_by_cells(questions: Questions, index: CellIndex, probes: int, k: int = 80, metric: str = "l2") -> DataFrame:
    """Approximate search in the ``probes`` cells nearest to each question; all cells make it exact.

    Cells that no question probes are filtered out at the scan.
    """
    centroids = index.centroids

    def probed(vectors: np.ndarray) -> np.ndarray:
        if not len(vectors):
            return np.zeros((0, len(centroids)), bool)
        order = np.argsort(_cell_distance(vectors, centroids), axis=1, kind="stable")[:, :probes]
        mask = np.zeros((len(vectors), len(centroids)), bool)
        np.put_along_axis(mask, order, True, axis=1)
        return mask

    columns = index.chunks.select("item_id", "chunk_ix", "embedding", "cell")

    def wanted(vectors: np.ndarray) -> DataFrame:
        cells = np.flatnonzero(probed(vectors).any(axis=0))
        return columns if len(cells) == len(centroids) else columns.filter(F.col("cell").isin([int(c) for c in cells]))

    return _best(questions, columns, k, metric, _cell_batch, probed, wanted)


# --- approximate: hashed signs -----------------------------------------------------------------


def sign_planes(dims: int, tables: int, bits: int) -> np.ndarray:
    """Planes of +1/-1 by rule: the first md5 digit of ``table:bit:dimension`` is 8 or more, or not."""

    def side(table: int, bit: int, dim: int) -> float:
        digest = hashlib.md5(f"{table}:{bit}:{dim}".encode()).hexdigest()
        return 1.0 if digest[0] >= "8" else -1.0

    return np.array([[[side(t, b, d) for d in range(dims)] for b in range(bits)] for t in range(tables)])


def _signatures(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """One integer per table: bit ``b`` is set when the vector lies on plane ``b``'s positive side."""
    tables, bits, dims = planes.shape
    if not len(vectors):
        return np.empty((0, tables), np.int64)
    sides = vectors.astype(np.float64) @ planes.reshape(tables * bits, dims).T >= 0
    return sides.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def nearest_by_signs(
    questions: Questions, chunks: DataFrame, tables: int = 8, bits: int = 6, k: int = 80, metric: str = "l2"
) -> DataFrame:
    """Approximate search among chunks that share a signature; more tables find more."""
    if questions.vectors is None:
        dims = questions.frame.select(F.size("embedding")).first()[0]
    else:
        dims = questions.vectors.shape[1]
    planes = sign_planes(dims, tables, bits)
    columns = chunks.select("item_id", "chunk_ix", "embedding")
    return _best(questions, columns, k, metric, _sign_batch, lambda vectors: (planes, _signatures(vectors, planes)))
