"""Retrieval for a table of questions: candidates, thresholds, reranking, prompts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.nearest import CellIndex, Questions, nearest, nearest_by_cells, nearest_by_signs, prepare
from quern.operators.rerank import mmr
from quern.operators.sizes import sent_if_small
from quern.plans.prompts import context_prompt
from quern.session import durable
from quern.sources.store import dataset_filter, id_folder, kind_filter

# Default knobs.
CANDIDATES = 80
TOPK = 12
SQL_TOPK = 6
PER_ITEM_CAP = 2
CONTEXT_PER_ITEM_CAP = 8
KIND_CAPS = {"example": 2}
ANSWER_MIN_SIM = 0.60
KINDS = ["table", "column", "key", "info"]


@dataclass(frozen=True)
class Knobs:
    kinds: Sequence[str] | None = None
    dataset: str | None = None
    candidates: int = CANDIDATES
    topk: int = TOPK
    per_item_cap: int | None = PER_ITEM_CAP
    lam: float = 0.5
    min_sim: float | None = None
    metric: str = "l2"
    # None leaves each ranking its own caps; an empty mapping switches them off.
    kind_caps: Mapping[str, int] | None = None
    # Approximate search: cells to probe in a given index, or tables of signatures to compare.
    probes: int | None = None
    sign_tables: int | None = None


def eligible_chunks(items: DataFrame, chunks: DataFrame, knobs: Knobs) -> DataFrame:
    """Chunks of the items that the filters admit; without filters the chunks as they are.

    Chunks stored with their item's kind and dataset are filtered where they are read. Otherwise
    the admitted ids are joined, sent to every task when they are proven few.
    """
    if knobs.kinds is None and not knobs.dataset:
        return chunks
    own = {"kind", "dataset"} <= set(chunks.columns)
    wanted = chunks if own else items
    if knobs.kinds is not None:
        wanted = wanted.filter(kind_filter(knobs.kinds))
    if knobs.dataset:
        wanted = wanted.filter(dataset_filter(knobs.dataset, own))
    if own:
        return wanted
    return chunks.join(sent_if_small(wanted.select(F.col("id").alias("item_id"))), "item_id", "left_semi")


def _small(questions: Questions, k: int, df: DataFrame) -> DataFrame:
    """Results hold at most ``k`` rows per question: broadcast when that is within bounds."""
    return F.broadcast(df) if questions.bounded(k) else df


def candidates(
    questions: Questions, items: DataFrame, chunks: DataFrame, knobs: Knobs, index: CellIndex | None = None
) -> DataFrame:
    """The nearest chunks per question with kind and name; texts are joined only to final rows."""
    k, metric = knobs.candidates, knobs.metric
    if knobs.probes:
        if index is None:
            raise ValueError("probing cells needs an index")
        cells = CellIndex(eligible_chunks(items, index.chunks, knobs), index.centroids)
        found = nearest_by_cells(questions, cells, knobs.probes, k, metric)
    elif knobs.sign_tables:
        found = nearest_by_signs(questions, eligible_chunks(items, chunks, knobs), knobs.sign_tables, k=k, metric=metric)
    else:
        found = nearest(questions, eligible_chunks(items, chunks, knobs), k, metric)
    return with_item(questions, items, found, k)


def with_item(questions: Questions, items: DataFrame, found: DataFrame, k: int = CANDIDATES) -> DataFrame:
    meta = items.select(F.col("id").alias("item_id"), "kind", "name")
    return meta.join(_small(questions, k, found), "item_id")


def with_text(questions: Questions, chunks: DataFrame, ranked: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Texts of ranked rows. Chunks stored in folders by id are read from the rows' folders alone."""
    keys = ["item_id", "chunk_ix"]
    if "id_folder" in chunks.columns:
        ranked = ranked.withColumn("id_folder", id_folder(F.col("item_id")))
        keys = ["id_folder", *keys]
    texts = chunks.select(*keys, "chunk_text")
    return texts.join(_small(questions, k, ranked), keys).drop("id_folder")


def kept_once(scored: DataFrame) -> DataFrame:
    """Candidates that are read more than once: few rows, which took a reading of all vectors to find."""
    return durable(scored)


def above(scored: DataFrame, min_sim: float | None) -> DataFrame:
    return scored if min_sim is None else scored.filter(F.col("sim") >= min_sim)


def rerank(scored: DataFrame, knobs: Knobs) -> DataFrame:
    return mmr(above(scored, knobs.min_sim), knobs.topk, knobs.lam, knobs.per_item_cap, knobs.kind_caps or None)


def retrieve(
    questions: DataFrame, items: DataFrame, chunks: DataFrame, knobs: Knobs = Knobs(), index: CellIndex | None = None
) -> DataFrame:
    """Final ranked chunks per question, with their texts."""
    batch = prepare(questions)
    ranked = rerank(candidates(batch, items, chunks, knobs, index), knobs)
    return with_text(batch, chunks, ranked, knobs.candidates)


def retrieve_prompts(questions: DataFrame, items: DataFrame, chunks: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """(query_id, prompt) per question that found anything."""
    return context_prompt(retrieve(questions, items, chunks, knobs))


def funnel(scored: DataFrame, knobs: Knobs) -> DataFrame:
    """Candidates, rows above the threshold and final rows per question."""
    scored = kept_once(scored)
    kept = F.lit(True) if knobs.min_sim is None else F.col("sim") >= knobs.min_sim
    seen = scored.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(kept).alias("after_threshold")
    )
    final = rerank(scored, knobs).groupBy("query_id").agg(F.count(F.lit(1)).alias("final"))
    return seen.join(final, "query_id", "left").fillna(0, ["final"])


def answer_candidates(scored: DataFrame, kinds: Sequence[str], min_sim: float = ANSWER_MIN_SIM) -> DataFrame:
    """Candidates for the answer's context: strictly above the threshold, of the given kinds."""
    return scored.filter((F.col("sim") > min_sim) & F.col("kind").isin(list(kinds)))


def two_contexts(
    scored: DataFrame, answer_kinds: Sequence[str], min_sim: float = ANSWER_MIN_SIM, knobs: Knobs = Knobs()
) -> DataFrame:
    """One candidate pass, two rankings: ``sql`` context of 6 and ``answer`` context of 12 rows."""
    scored = kept_once(scored)
    caps = KIND_CAPS if knobs.kind_caps is None else knobs.kind_caps
    for_sql = mmr(scored, SQL_TOPK, knobs.lam, CONTEXT_PER_ITEM_CAP, caps)
    for_answer = mmr(answer_candidates(scored, answer_kinds, min_sim), TOPK, knobs.lam, CONTEXT_PER_ITEM_CAP, caps)
    return for_sql.withColumn("context", F.lit("sql")).unionByName(for_answer.withColumn("context", F.lit("answer")))


def final_json(ranked: DataFrame) -> DataFrame:
    """(query_id, rank, json) of the final chunks."""
    fields = ["item_id", "kind", "name", "chunk_ix", "chunk_text", "dist", "sim"]
    return ranked.select("query_id", "rank", F.to_json(F.struct(*fields)).alias("json"))
