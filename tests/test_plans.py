"""What the plans read and move."""

import re

import pytest
from pyspark.sql import functions as F

from quern.operators.chunks import chunk_items, embed_hashed
from quern.operators.nearest import prepare
from quern.operators.rerank import mmr
from quern.operators.upsert import upsert_items
from quern.plans import retrieve, sync
from quern.sources.store import load, save_chunks, save_items
from quern.workload import tables as t

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    save_items(t.items(spark, SF), f"{path}/items")
    save_chunks(t.chunks(spark, SF), f"{path}/chunks")
    return load(spark, f"{path}/items"), load(spark, f"{path}/chunks")


def test_scoring_reads_only_vectors_of_the_wanted_kinds(spark, store):
    items, chunks = store
    knobs = retrieve.Knobs(kinds=["info", "table"])
    batch = prepare(t.questions(spark, SF))
    plan = _plan(retrieve.candidates(batch, items, chunks, knobs))
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "embedding" in line)
    assert "PartitionFilters: [kind" in scan and "chunk_text" not in scan
    assert "body" not in plan
    # Chunks are never shuffled: both exchanges come after the scoring.
    assert plan.count("hashpartitioning(query_id") == plan.count("hashpartitioning(") == 2


def test_texts_are_read_from_the_final_rows_folders(spark, store, tmp_path):
    items, chunks = store
    save_chunks(chunks, str(tmp_path / "by-id"), by_id=True)
    stored = load(spark, str(tmp_path / "by-id"))
    asked = t.questions(spark, SF).filter("query_id = 3")
    found = retrieve.retrieve(asked, items, stored)
    want = retrieve.retrieve(asked, items, chunks)
    assert "dynamicpruningexpression" in _plan(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select(*found.columns).collect()))


def test_rerank_shuffles_once(spark):
    df = spark.range(100).selectExpr("id % 5 AS query_id", "id % 7 AS item_id", "'info' AS kind", "rand() AS sim", "int(id) AS cand_ix")
    assert len(re.findall(r"Exchange hashpartitioning", _plan(mmr(df, kind_caps={"info": 2})))) == 1


def test_few_arrivals_do_not_shuffle_the_store(spark, store):
    items, _ = store
    one = items.limit(1).select("kind", "name", F.lit("new").alias("body"), "metadata", F.lit(0).alias("seq"))
    plan = _plan(upsert_items(items.select(*t.items(spark, SF).columns), one, t.moment(t.EPOCH)))
    kept = plan[plan.index("LeftAnti") :]
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in kept


def test_a_sync_plan_shuffles_no_texts(spark, store):
    items, _ = store
    rows = items.select("kind", F.col("id").alias("row_ix"), "body")
    plan = _plan(sync.plan_sync(sync.desired_rows(rows), sync.current_rows(rows)))
    below = re.findall(r"Exchange hashpartitioning[^\n]*\n([^\n]*)", plan)
    assert len(below) == 2 and all(re.search(r"Project \[kind#\d+, \S+ AS row_ix#\d+L, sha2\(", line) for line in below)


def test_chunking_and_embedding_do_not_shuffle(spark):
    plan = _plan(embed_hashed(chunk_items(t.items(spark, SF))))
    assert "Exchange" not in plan and "Python" not in plan
