import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import nearest as ann

DIMS = 16


def _vectors(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, DIMS)).astype(np.float32)
    if copies:
        vectors[rng.permutation(n)[:copies]] = vectors[0]
    return vectors


def _chunks(spark, vectors):
    rows = [(i % 7, i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "item_id long, chunk_ix int, embedding array<float>").repartition(6)


def _questions(spark, vectors):
    rows = [(100 + i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "query_id long, embedding array<float>")


def _brute(chunk_vectors, question_vectors, k, metric):
    c, found = chunk_vectors.astype(float), set()
    for qi, q in enumerate(question_vectors.astype(float)):
        if metric == "l2":
            dist = np.sqrt(((c - q) ** 2).sum(axis=1))
        else:
            dist = 1 - (c * q).sum(axis=1) / (np.sqrt((c**2).sum(axis=1)) * np.sqrt((q**2).sum()))
        order = sorted(range(len(c)), key=lambda i: (dist[i], i % 7, i))
        found |= {(100 + qi, i % 7, i, rank) for rank, i in enumerate(order[:k], 1)}
    return found


def _got(df):
    return {(r.query_id, r.item_id, r.chunk_ix, r.cand_ix) for r in df.collect()}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_exact_with_a_third_of_the_chunks_equal(spark, metric, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "PAIR_SLICE", 50)
    chunks, questions = _vectors(600, 1, copies=200), _vectors(9, 2)
    questions[0] = chunks[0]
    batch = ann.prepare(_questions(spark, questions))
    assert batch.bounded(25)
    got = _got(ann.nearest(batch, _chunks(spark, chunks), 25, metric))
    assert got == _brute(chunks, questions, 25, metric)


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-3, 1.0), (100.0, 1000.0)])
def test_close_distances_far_from_zero(spark, scale, shift, monkeypatch):
    """Differences far below the rounding error of a narrow product still rank the pairs."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    chunks, questions = _vectors(700, 21) * np.float32(scale) + np.float32(shift), _vectors(6, 22) * np.float32(scale) + np.float32(shift)
    batch = ann.prepare(_questions(spark, questions))
    assert _got(ann.nearest(batch, _chunks(spark, chunks), 30)) == _brute(chunks, questions, 30, "l2")


def test_double_vectors(spark):
    chunks, questions = _vectors(200, 23), _vectors(3, 24)
    wide = _chunks(spark, chunks).withColumn("embedding", F.col("embedding").cast("array<double>"))
    batch = ann.prepare(_questions(spark, questions))
    assert _got(ann.nearest(batch, wide, 10)) == _brute(chunks, questions, 10, "l2")
    asked = _questions(spark, questions).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") + 1e-9))
    found = ann.nearest(ann.prepare(asked), _chunks(spark, chunks), 10)
    exact = np.sqrt(((chunks.astype(float) - (questions[0].astype(float) + 1e-9)) ** 2).sum(axis=1)).min()
    assert found.filter("query_id = 100 AND cand_ix = 1").first().dist == pytest.approx(exact, abs=1e-13)


def test_large_question_batches_take_the_grid(spark, monkeypatch):
    chunks, questions = _vectors(500, 3, copies=150), _vectors(60, 4)
    want = _brute(chunks, questions, 10, "l2")
    monkeypatch.setattr(ann, "MAX_SENT_QUESTIONS", 25)
    batch = ann.prepare(_questions(spark, questions), limit=25)
    assert not batch.bounded(10)
    assert _got(ann.nearest(batch, _chunks(spark, chunks), 10)) == want
    centroids = _vectors(5, 9).astype(float)
    index = ann.CellIndex(ann.assign_cells(_chunks(spark, chunks), centroids), centroids)
    assert _got(ann.nearest_by_cells(batch, index, 5, 10)) == want
    assert _got(ann.nearest_by_signs(batch, _chunks(spark, chunks), 64, 1, 10)) == want


def test_deep_searches_take_the_grid_too(spark, monkeypatch):
    chunks, questions = _vectors(300, 3), _vectors(30, 4)
    monkeypatch.setattr(ann, "MAX_KEPT_PAIRS", 400)
    batch = ann.prepare(_questions(spark, questions))
    assert batch.bounded(10) and not batch.bounded(40)
    assert _got(ann.nearest(batch, _chunks(spark, chunks), 40)) == _brute(chunks, questions, 40, "l2")


def test_cells_find_more_with_more_probes_and_all_with_all(spark):
    chunks, questions = _vectors(800, 5), _vectors(20, 6)
    want = _brute(chunks, questions, 10, "l2")
    table = _chunks(spark, chunks)
    index = ann.build_cells(table, 8)
    batch = ann.prepare(_questions(spark, questions))
    recall = []
    for probes in (1, 4, 8):
        pairs = {x[:3] for x in _got(ann.nearest_by_cells(batch, index, probes, 10))}
        recall.append(len(pairs & {x[:3] for x in want}) / len(want))
    assert recall == sorted(recall) and recall[0] > 0.1 and recall[-1] == 1.0


def test_signs_find_more_with_more_tables(spark):
    chunks, questions = _vectors(800, 7), _vectors(20, 8)
    want = {x[:3] for x in _brute(chunks, questions, 10, "l2")}
    batch = ann.prepare(_questions(spark, questions))
    recall = []
    for tables in (1, 4, 32):
        found = ann.nearest_by_signs(batch, _chunks(spark, chunks), tables, 4, 10)
        recall.append(len({x[:3] for x in _got(found)} & want) / len(want))
    assert recall == sorted(recall) and recall[0] > 0.1 and recall[-1] > 0.85


def test_missing_vectors_are_left_out_and_widths_must_agree(spark):
    chunks = _chunks(spark, _vectors(10, 1)).withColumn("embedding", F.when(F.col("chunk_ix") != 3, F.col("embedding")))
    batch = ann.prepare(_questions(spark, _vectors(1, 2)))
    assert {x[2] for x in _got(ann.nearest(batch, chunks, 80))} == set(range(10)) - {3}
    short = _chunks(spark, _vectors(10, 1)).withColumn("embedding", F.slice("embedding", 1, 4))
    with pytest.raises(Exception, match="width"):
        ann.nearest(batch, short).collect()
    with pytest.raises(ValueError):
        ann.nearest(batch, chunks, metric="dot")


def test_zero_vectors_have_no_similarity(spark):
    chunks = spark.createDataFrame([(1, 0, [0.0] * DIMS)], "item_id long, chunk_ix int, embedding array<float>")
    found = ann.nearest(ann.prepare(_questions(spark, _vectors(1, 2))), chunks, metric="cosine").first()
    assert (found.dist, found.sim) == (1.0, 0.0)


def test_copies_beyond_k_are_not_scored():
    vectors = np.repeat(np.array([[1.0, 2.0], [3.0, 4.0], [0.0, -0.0]]), [5, 2, 4], axis=0)
    items = np.array([9, 1, 8, 2, 7, 1, 1, 4, 3, 2, 1])
    chunks = np.zeros(11, np.int32)
    kept = ann._useful_copies(vectors, items, chunks, 2)
    assert sorted(zip(vectors[kept, 0], items[kept])) == [(0.0, 1), (0.0, 2), (1.0, 1), (1.0, 2), (3.0, 1), (3.0, 1)]
    assert len(ann._useful_copies(vectors, items, chunks, 5)) == 11


def test_questions_that_are_copies_themselves(spark):
    chunks = _vectors(900, 11, copies=300)
    questions = np.concatenate([chunks[:1], chunks[:1], _vectors(3, 12)])
    batch = ann.prepare(_questions(spark, questions))
    for metric in ("l2", "cosine"):
        assert _got(ann.nearest(batch, _chunks(spark, chunks), 20, metric)) == _brute(chunks, questions, 20, metric)


def test_centroids_in_order(spark):
    df = spark.createDataFrame([("b", [2.0]), ("a", [1.0])], "name string, embedding array<float>")
    assert ann.centroid_matrix(df, "name").tolist() == [[1.0], [2.0]]


def test_stored_cells_are_pruned_at_the_scan(spark, tmp_path):
    table = _chunks(spark, _vectors(300, 13))
    ann.build_cells(table, 6).save(str(tmp_path / "cells"))
    index = ann.CellIndex.load(spark, str(tmp_path / "cells"))
    found = ann.nearest_by_cells(ann.prepare(_questions(spark, _vectors(1, 14))), index, 2, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and found.count() == 10


def test_no_questions(spark):
    batch = ann.prepare(_questions(spark, _vectors(1, 2)).filter("query_id < 0"))
    chunks = _chunks(spark, _vectors(10, 1))
    index = ann.CellIndex(ann.assign_cells(chunks, np.zeros((1, DIMS))), np.zeros((1, DIMS)))
    assert ann.nearest(batch, chunks).count() == 0
    assert ann.nearest_by_signs(batch, chunks).count() == 0
    assert ann.nearest_by_cells(batch, index, 1).count() == 0


def test_an_index_of_a_store_with_missing_vectors(spark, tmp_path):
    chunks = _chunks(spark, _vectors(400, 3))
    gaps = chunks.withColumn("embedding", F.when(F.col("chunk_ix") % 7 != 0, F.col("embedding")))
    index = ann.build_cells(gaps.repartition(16), 20)
    index.save(str(tmp_path / "index"))
    files = list((tmp_path / "index" / "chunks").glob("cell=*/part-*.parquet"))
    assert len(files) <= 20 + spark.sparkContext.defaultParallelism * 4
    loaded = ann.CellIndex.load(spark, str(tmp_path / "index"))
    assert loaded.chunks.count() == gaps.filter("embedding IS NOT NULL").count()


def test_any_number_of_cells_can_be_read_again(spark, tmp_path):
    rows = [(i, [float(i), 0.0]) for i in range(9000)]
    centroids = ann.centroid_matrix(spark.createDataFrame(rows, "cell int, embedding array<double>"), "cell")
    assert centroids.shape == (9000, 2) and centroids[8999, 0] == 8999.0


def test_pilots_bound_what_tasks_hand_on(spark, monkeypatch):
    """Over many tasks, far fewer rows than tasks times k for each question, and the same result."""
    chunks, questions = _vectors(6000, 31, copies=500), _vectors(6, 32)
    table = _chunks(spark, chunks).repartition(128)
    batch = ann.prepare(_questions(spark, questions))
    alone = ann.survivors(batch, table, 10, "l2", ann._exact_batch, None).count()
    assert alone == 128 * 6 * 10
    monkeypatch.setattr(ann, "PILOT_TASKS", 4)
    monkeypatch.setattr(ann, "PILOT_GROWTH", 4)
    bounded = ann.survivors(batch, table, 10, "l2", ann._exact_batch, None).count()
    assert bounded < 6 * 10 * 16
    assert _got(ann.nearest(batch, table, 10)) == _brute(chunks, questions, 10, "l2")
    assert _got(ann.nearest(batch, table, 10, "cosine")) == _brute(chunks, questions, 10, "cosine")
    # A pilot that finds fewer than k chunks bounds nothing.
    assert _got(ann.nearest(batch, _chunks(spark, chunks[:40]).repartition(64), 30)) == _brute(chunks[:40], questions, 30, "l2")
