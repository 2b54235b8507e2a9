"""The windowed rerank against the greedy loop it replaces."""

import random

import pytest

from quern.operators.rerank import mmr


def greedy(cands, k, lam, item_cap, kind_caps):
    """Pick by best score; a kind's cap counts the picks after the first."""
    picked, per_item, left = [0], {cands[0]["item_id"]: 1}, dict(kind_caps or {})
    while len(picked) < k:
        best = None
        for i, c in enumerate(cands):
            if i in picked or (item_cap and per_item.get(c["item_id"], 0) >= item_cap) or left.get(c["kind"], 1) <= 0:
                continue
            score = lam * c["sim"] - (1 - lam) * (c["item_id"] in per_item)
            if best is None or score > best[0]:
                best = (score, i)
        if best is None:
            break
        chosen = cands[best[1]]
        picked.append(best[1])
        per_item[chosen["item_id"]] = per_item.get(chosen["item_id"], 0) + 1
        if chosen["kind"] in left:
            left[chosen["kind"]] -= 1
    return picked


@pytest.mark.parametrize("lam, item_cap, kind_caps", [(0.5, 2, None), (0.3, None, {"example": 2}), (1.0, 1, None), (0.7, 3, {"example": 0, "info": 1})])
def test_matches_greedy(spark, lam, item_cap, kind_caps):
    rng = random.Random(int(lam * 10))
    rows, want = [], {}
    for query in range(120):
        n = rng.randrange(1, 40)
        sims = sorted((round(rng.random(), 1 if query % 2 else 6) for _ in range(n)), reverse=True)
        cands = []
        for i, sim in enumerate(sims):
            item = rng.randrange(8)
            cands.append({"item_id": item, "kind": ["example", "info", "table"][item % 3], "sim": sim})
            rows.append((query, item, cands[-1]["kind"], i, sim, i + 1))
        want[query] = greedy(cands, 12, lam, item_cap, kind_caps)
    df = spark.createDataFrame(rows, "query_id long, item_id long, kind string, chunk_ix int, sim double, cand_ix int")
    got = {}
    for r in mmr(df, 12, lam, item_cap, kind_caps).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["cand_ix"] - 1)
    assert got == want


def test_first_pick_is_always_kept(spark):
    df = spark.createDataFrame([(1, 1, "info", 0, 0.9, 1), (1, 2, "info", 0, 0.8, 2)], "query_id long, item_id long, kind string, chunk_ix int, sim double, cand_ix int")
    assert mmr(df, topk=0).count() == 1
    with pytest.raises(ValueError):
        mmr(df, lam=0)
