"""Diversity reranking: relevance against repetition of an item, as windows over a question's candidates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def mmr(
    candidates: DataFrame,
    topk: int = 12,
    lam: float = 0.5,
    per_item_cap: int | None = 2,
    kind_caps: Mapping[str, int] | None = None,
) -> DataFrame:
    """Rank candidates by ``lam * sim - (1 - lam) * [an earlier pick has the same item]``.

    The penalty depends only on whether a candidate is the first of its item, so the greedy choice
    is a sort. A question has at most the candidates of its top-k search, hence bounded windows.
    ``kind_caps`` limits the picks of a kind after the first pick.
    """
    if not 0 < lam <= 1:
        raise ValueError("lam must lie in (0, 1]")
    by_item = W.partitionBy("query_id", "item_id").orderBy("cand_ix")
    # One shuffle by question serves every window below.
    rows = candidates.repartition("query_id").withColumn("_in_item", F.row_number().over(by_item))
    if per_item_cap:
        rows = rows.filter(F.col("_in_item") <= per_item_cap)
    repeated = (F.col("_in_item") > 1).cast("double")
    rows = rows.withColumn("score", F.lit(lam) * F.col("sim") - F.lit(1.0 - lam) * repeated)
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("cand_ix"))
    rows = rows.withColumn("rank", F.row_number().over(by_score))
    if kind_caps:
        cap = F.element_at(F.create_map(*[F.lit(v) for pair in kind_caps.items() for v in pair]), F.col("kind"))
        by_kind = W.partitionBy("query_id", "kind", F.col("rank") > 1).orderBy("rank")
        rows = (
            rows.withColumn("_in_kind", F.row_number().over(by_kind))
            .filter((F.col("rank") == 1) | cap.isNull() | (F.col("_in_kind") <= cap))
            .withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
            .drop("_in_kind")
        )
    return rows.filter(F.col("rank") <= max(topk, 1)).drop("_in_item")
