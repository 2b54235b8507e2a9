"""Jaccard groups, decontamination, sharding, mixing and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import components, decontamination, mixing, ngram_jaccard, sharding
from quern.llm.queries import QUERIES

from . import plain

SF = "/root/testdata/sf0.001"


def _noisy(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], ["new%d" % rng.randrange(10**6)], [words[at], words[at]]])
    return " ".join(words)


@pytest.fixture(scope="module")
def near_texts():
    """Groups of near copies of several sizes, many of them around the threshold, a passage that all share."""
    rng = random.Random(11)
    texts = []
    for size, copies in ((12, 6), (30, 12), (80, 60), (200, 40), (600, 8)):
        original = [f"w{rng.randrange(5000)}" for _ in range(size)]
        texts += [_noisy(rng, original, rng.randrange(0, max(2, size // 20))) for _ in range(copies)]
    shared = " ".join(f"p{i}" for i in range(40))
    texts += [shared + " " + " ".join(f"u{rng.randrange(10**7)}" for _ in range(30)) for _ in range(40)]
    texts += texts[:10] + [None, "", "one", "one two", "one two", "ONE Two three", "one two three"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_groups_match_all_pairs(make_docs, near_texts, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SAMPLED", 2)
    docs = make_docs(list(near_texts.items()))
    want = plain.groups(near_texts)
    got = {r["doc_id"]: r for r in ngram_jaccard.link_groups(docs).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert {d: r["n_shingles"] for d, r in got.items()} == {d: len(plain.shingles(t)) for d, t in near_texts.items()}


@pytest.mark.parametrize("words,percent", [(5, 80), (2, 60)])
def test_groups_by_another_rule(make_docs, near_texts, monkeypatch, words, percent):
    monkeypatch.setattr(ngram_jaccard, "SAMPLED", 2)
    found = ngram_jaccard.link_groups(make_docs(list(near_texts.items())), ngram_jaccard.Rule(words, percent))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == plain.groups(near_texts, percent, words)


def test_smallest_sets_that_link():
    for percent, smallest in ((90, 9), (80, 4), (50, 1), (85, 6)):
        rule = ngram_jaccard.Rule(3, percent)
        linked = [n for n in range(1, 40) if 100 * n >= percent * (n + 1)]
        assert rule.smallest == smallest == linked[0]


def test_groups_in_blocks(make_docs, near_texts, monkeypatch):
    """Small blocks, so that frequent roots are dealt out and guests are needed."""
    for name, value in (("SAMPLED", 1), ("BLOCK", 4), ("LEAF", 2), ("FAN", 2)):
        monkeypatch.setattr(ngram_jaccard, name, value)
    docs = make_docs(list(near_texts.items()))
    assert {r["doc_id"]: r["component_id"] for r in ngram_jaccard.link_groups(docs).collect()} == plain.groups(near_texts)


def test_copies_of_several_tasks_keep_their_links(make_docs):
    """One text in every partition and one larger near copy, which stands after all its copies under a root."""
    words = [f"w{i}" for i in range(80)]
    texts = {0: " ".join([*words, "more"])} | {i: " ".join(words) for i in range(1, 9)}
    docs = make_docs(list(texts.items())).repartition(9, "doc_id")
    assert {r["doc_id"]: r["component_id"] for r in ngram_jaccard.link_groups(docs).collect()} == plain.groups(texts) == dict.fromkeys(texts, 0)


def test_tree_keeps_every_possible_pair():
    rng = np.random.default_rng(2)
    base = [rng.choice(10**6, 120, replace=False) for _ in range(6)]
    sets = sorted((np.unique(np.concatenate([rng.choice(b, 118, replace=False), rng.integers(10**6, 10**9, rng.integers(0, 6))])) for b in base for _ in range(30)), key=len)
    values = np.concatenate(sets).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    before = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    bits = ngram_jaccard.signatures(values, before).view(np.uint64)
    n = np.diff(before)
    a, b = ngram_jaccard.tree_pairs(n, np.zeros(len(n), np.int64), bits, np.arange(len(n)), np.zeros(len(n), bool))
    found = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    linked = set()
    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 90 * (len(sets[i]) + len(sets[j]) - k):
                linked.add((j, i))
    assert linked <= found and len(found) < len(n) * (len(n) - 1) / 3


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = top(u), top(v)
        parent[max(a, b)] = min(a, b)
    got = {r["v"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in parent if any(x in e for e in edges if e[0] != e[1])}


def test_components_ask_little_of_the_driver(spark, monkeypatch):
    """A round's plan shuffles few times, stars take no round, and a chain takes few."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    plan = components._small_star(components._large_star(edges)).distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 7
    written, staged = [], components.staged
    monkeypatch.setattr(components, "staged", lambda df, label: written.append(label) or staged(df, label))
    stars = spark.createDataFrame([(1, 2), (3, 1), (4, 5), (5, 4), (6, 6)], "u long, v long")
    assert {(r["v"], r["label"]) for r in components.components(stars).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    assert len(written) == 1
    assert components.components(stars.limit(0)).count() == 0
    assert {(r["v"], r["label"]) for r in components.components(edges).collect()} == {(i, 0) for i in range(41)}


def test_op6_odd(odd_docs, no_docs):
    got = ngram_jaccard.link_groups(odd_docs.withColumn("n", F.lit("clash"))).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter(
        [(1, 1), (2, 2), (3, 3), (None, 4), (4, 4), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8), (9, 9)]
    )
    assert ngram_jaccard.link_groups(no_docs).count() == 0
    kept = ngram_jaccard.drop_near_copies(odd_docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8, 9] and kept.schema == odd_docs.schema


def _plain_matches(texts, items):
    out = {}
    for item, body in items.items():
        k = plain.words(plain.lower(body))
        if not k:
            continue
        size = min(5, len(k))
        cut = lambda w: Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
        want = cut(k)
        for d, t in texts.items():
            w = plain.words(plain.lower(t))
            for s in range(max(0, len(w) - len(k)) + 1):
                have = cut(w[s : s + len(k)])
                both = sum((have & want).values())
                score = both / (sum(have.values()) + sum(want.values()) - both)
                if score >= 0.8 and score > out.get((d, item), (0, 0))[1]:
                    out[(d, item)] = (s, score)
    return out


def test_decontamination_matches_all_windows(make_docs, spark):
    rng = random.Random(8)
    items = {i: " ".join(f"w{rng.randrange(400)}" for _ in range(n)) for i, n in enumerate([3, 4, 5, 8, 20, 45, 60, 60])}
    items |= {20: items[5], 21: "", 22: None}
    texts = {}
    for d in range(120):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 150))]
        for i in rng.sample(sorted(set(items) - {21, 22}), 2):
            at = rng.randrange(len(words) + 1)
            words[at:at] = _noisy(rng, items[i].split(), rng.choice([0, 0, 1, 2, 3])).upper().split()
        texts[d] = " ".join(words)
    texts |= {200: None, 201: "", 202: items[4] + " " + items[4]}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["similarity"]) for r in decontamination.find_matches(make_docs(list(texts.items())), bench).collect()}
    want = _plain_matches(texts, items)
    assert {k: (s, pytest.approx(x)) for k, (s, x) in got.items()} == want


def test_hamming_blocks_miss_nothing():
    rng = np.random.default_rng(7)
    item = rng.random(decontamination.BITS) < 0.5
    prints = item ^ (rng.random((3000, decontamination.BITS)) < rng.random((3000, 1)) * 0.6)
    want = np.flatnonzero((prints != item).sum(axis=1) <= decontamination.RADIUS)
    assert decontamination.within_radius(prints, item).tolist() == want.tolist()


def test_op8(spark):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_simhash_decontamination"](spark, SF).collect()}
    assert {(d, i) for d, t in docs.items() for i, b in items.items() if b in t} <= got


def test_op8_odd(odd_docs, no_docs, spark, monkeypatch):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, "漢字 \U0001f600"), (None, "w1x1 w2x2 w3x3 w4x4 w5x5"), (4, None)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 20)
    got = decontamination.find_matches(odd_docs.withColumn("item_id", F.lit("clash")), bench)
    assert Counter((r["doc_id"], r["item_id"]) for r in got.collect()) == Counter([(None, 1), (4, 1), (4, 1), (5, 1), (8, 2), (6, None)])
    assert sorted(r["doc_id"] for r in decontamination.drop_contaminated(odd_docs, bench).collect()) == [1, 2, 3, 7, 9]
    assert decontamination.find_matches(no_docs, bench).count() == 0
    assert decontamination.find_matches(odd_docs, bench.where("false")).count() == 0


def _check_shards(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for group in by.values():
        assert sorted(r["slot"] for r in group) == list(range(len(group)))
    sums = [sum(r["size"] for r in by.get(s, [])) for s in range(shards)]
    most = max(r["size"] for r in rows)
    mean = sum(sums) / shards
    assert max(sums) <= mean + most + 0.02 * mean and min(sums) >= mean - most - 0.02 * mean


def test_op3(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op3_sampled_splitters"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        body = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 16, zlib.crc32(body), "bytes", None)
    _check_shards(got, 40)


def test_shards_of_a_hot_group(make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    rng = random.Random(3)
    rows = [(i, "same text " * 20) for i in range(900)] + [(1000 + i, "t%d " % i * rng.randrange(1, 40)) for i in range(1500)] + [(5000 + i % 3, "row") for i in range(30)]
    docs = make_docs(rows)
    got = sharding.shard_digests(docs, 8).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    _check_shards(got, 8)
    whole = sharding.shard_documents(docs.withColumn("Shard", F.lit("clash")), 8)
    assert {(r["doc_id"], r["shard"]) for r in whole.where("doc_id < 4000").collect()} == {(r["doc_id"], r["shard"]) for r in got if r["doc_id"] < 4000}
    assert len({r["shard"] for r in got if r["doc_id"] < 900}) > 1


def test_boundaries_lie_within_half_a_record(spark):
    """The bytes up to the end of every shard are off their even share by half of the largest record or less."""
    rows = QUERIES["op3_sampled_splitters"](spark, "/root/testdata/sf0.01").collect()
    share, most, seen = sum(r["size"] for r in rows) / 40, max(r["size"] for r in rows), 0
    for s in range(39):
        seen += sum(r["size"] for r in rows if r["shard"] == s)
        assert abs(seen - (s + 1) * share) <= most / 2 + 1


def test_written_shards(make_docs, spark, tmp_path):
    docs = make_docs([(i, "word " * (i % 17)) for i in range(300)])
    sharding.write_shards(docs, str(tmp_path / "shards"), 5)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r["doc_id"], r["text"]) for r in docs.collect())


def test_op3_odd(odd_docs, no_docs):
    got = sharding.shard_digests(odd_docs, 4).collect()
    assert len(got) == 11 and {r["size"] for r in got if r["doc_id"] in (1, 2)} == {16}
    assert sharding.shard_digests(no_docs, 4).count() == 0
    assert sharding.shard_documents(no_docs, 4).count() == 0


def _plain_targets(sizes):
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: [5, 2, 1][i % 3] for i, s in enumerate(sources)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        weight = sum(weights[s] for s in sources if s not in full and sizes[s])
        out = {s: 3.0 * sizes[s] if s in full else (left * weights[s] / weight if sizes[s] else 0.0) for s in sources}
        more = {s for s in sources if s not in full and out[s] > 3 * sizes[s]}
        if not more:
            return out
        full |= more


def _check_mix(rows, texts_of, near):
    sizes = Counter()
    for d, t, s in texts_of:
        sizes[s] += len(plain.words(t))
    targets = _plain_targets(dict(sizes))
    source = {}
    for d, t, s in texts_of:
        source[d] = s
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s, target in targets.items():
        assert abs(taken[s] - target) <= near + 0.01 * target


def test_op10(spark):
    texts = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op10_mix_sources"](spark, SF).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {d: len(plain.words(t)) for d, t, _ in texts}
    _check_mix(got, texts, mixing.BLOCK_WORDS)
    again = QUERIES["op10_mix_sources"](spark, SF).collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in got}


def test_mix_of_uneven_sources(make_docs):
    rows = [(i, "w " * (i % 40), "en", "big") for i in range(400)] + [(1000 + i, "z " * 30, "en", "a") for i in range(5)] + [(2000, "n " * 50, "en", None), (2001, None, "en", None)]
    got = mixing.mix_documents(make_docs(rows), block_words=8).collect()
    assert len(got) == len(rows)
    _check_mix(got, [(r[0], r[1], r[3]) for r in rows], 3 * 8)
    small = [r for r in got if 1000 <= r["doc_id"] < 1005]
    assert {r["target"] for r in small} == {450.0} and sum(r["taken"] for r in small) == 450


def test_mix_of_small_sources(make_docs):
    """Sources far below a block reach their targets too: all words as often as the target holds them."""
    rows = [(0, "w " * 10_000, "en", "z")] + [(i, "s " * n, "en", f"small{i}") for i, n in enumerate((10, 10, 20, 70, 1), 1)]
    got = {r["doc_id"]: r for r in mixing.mix_documents(make_docs(rows)).collect()}
    assert {i: got[i]["target"] for i in range(1, 6)} == {1: 30.0, 2: 30.0, 3: 60.0, 4: 210.0, 5: 3.0}
    assert all(got[i]["taken"] == got[i]["target"] for i in range(1, 6))
    assert abs(got[0]["taken"] - got[0]["target"]) <= mixing.BLOCK_WORDS


def test_permutations_reach_every_block(spark):
    for blocks in (1, 2, 6, 97, 1000):
        source = {"source_no": 3, "blocks": blocks, "slots": 3 * blocks}
        rows = mixing.slot_rows(spark, [source]).collect()
        assert Counter(r["block"] for r in rows) == {b: 3 for b in range(blocks)}


def test_mixed_documents_match_taken(make_docs, spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got, whole = Counter(), 0
    for r in mixing.mixed_documents(docs).collect():
        got[r["doc_id"]] += len(plain.words(r["text"]))
        whole += r["text"] == texts[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
        assert set(plain.words(r["text"])) <= set(plain.words(texts[r["doc_id"]]))
    assert dict(got) == {d: n for d, n in want.items() if n} and whole


def test_op10_odd(odd_docs, no_docs):
    assert mixing.mix_documents(odd_docs.withColumn("size", F.lit("clash"))).count() == 11
    assert mixing.mix_documents(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    mixed = mixing.mixed_documents(odd_docs.withColumn("shard", F.lit(1)))
    assert mixed.columns == [*odd_docs.columns, "shard"] and mixed.count() > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "benchmark", "mixing", "sharding"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    from quern.llm.queries import QUERIES as queries

    good = {r["doc_id"] for r in queries["op5_quality_ranking"](spark, SF).where("predicted = 1").collect()}
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == good
    groups = plain.groups({d: texts[d] for d in good}, 80, 5)
    single = corpus_pipeline.near_copies(spark, kept, SF)
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(set(groups.values()))
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = corpus_pipeline.benchmark(spark, single, SF)
    left = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == columns and not [d for d in left if any(i in texts[d] for i in items)]
    assert len(set(groups.values()) - left) <= 2 * sum(any(i in texts[d] for i in items) for d in set(groups.values()))
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*columns, "size", "text_crc32", "shard", "slot"]
    rows = out.collect()
    assert {r["doc_id"] for r in rows} <= left and all(re.search(r"\S", r["text"]) for r in rows)
    _check_shards(rows, 40)


def test_pipeline_odd(odd_docs, no_docs, spark, tmp_path):
    spark.createDataFrame([(4, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such passage in any text at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd_docs.withColumn("size", F.lit("clash")), no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.count()


def test_joins_of_near_copies_do_not_pass_through_the_driver(spark):
    rooted = spark.createDataFrame([(1, 10, 20, 0), (1, 11, 20, 1)], "root long, f long, n int, pos int")
    reps = spark.createDataFrame([(10, 20, b"x"), (11, 20, b"y")], "f long, n long, sig binary")
    pairs = ngram_jaccard.central_pairs(rooted, ngram_jaccard.QUERY)
    edges = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    for frame in (pairs, ngram_jaccard.bounded_pairs(pairs, reps, ngram_jaccard.QUERY), components._large_star(edges)):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
    assert {(r["v"], r["label"]) for r in components.components(edges).collect()} == {(1, 1), (2, 1), (3, 1)}
