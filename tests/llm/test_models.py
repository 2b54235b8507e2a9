"""Language identification, quality ranking and language-model scoring."""

import math
import random
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import flat, language_id, language_model, quality_ranking
from quern.llm.queries import QUERIES
from quern.session import checkpoint_root

from . import plain

SF = "/root/testdata/sf0.01"


def test_forward_sums_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b"bc", b" ab"]
    table = language_id.piece_table(pieces)
    rng = np.random.default_rng(3)
    p = rng.random((len(pieces), 2))
    p /= p.sum(axis=0)
    index = {x: i for i, x in enumerate(pieces)}

    def every(word, column):
        if not word:
            return 1.0
        return sum(p[index[word[:k]], column] * every(word[k:], column) for k in range(1, len(word) + 1) if word[:k] in index)

    words = ["abcab", "a", "zabc", "abcabcabc"]
    data, starts, ends = language_id._word_bytes([w.encode() for w in words])
    got = language_id.word_log_likelihoods(table, p, data, starts, ends)
    for i, w in enumerate(words):
        for c in range(2):
            assert got[i, c] == pytest.approx(math.log(every(b" " + w.encode(), c)))
    counts = language_id.expected_counts(table, p[:, 0], np.array([2.0]), *language_id._word_bytes([b"ab"]))
    whole = every(b" ab", 0)
    assert counts[index[b" ab"]] == pytest.approx(2 * p[index[b" ab"], 0] / whole)


def test_op4(spark):
    got = QUERIES["op4_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98


def test_runs_are_cut_between_characters():
    runs = ["x" * 200, "漢字" * 40, "Привет" * 15, "é" * 44, "a" + "é" * 60, "short", "a" * 44, "😀" * 30]
    data = np.frombuffer("".join(runs).encode(), np.uint8)
    ends = np.cumsum([len(r.encode()) for r in runs])
    starts = np.concatenate([[0], ends[:-1]])
    new, stop, before = language_id.cut_words(data, starts, ends, np.arange(len(runs) + 1))
    for i, run in enumerate(runs):
        parts = [bytes(data[a:b]) for a, b in zip(new[before[i] : before[i + 1]], stop[before[i] : before[i + 1]])]
        assert parts == language_id.cut_run(run.encode()) and "".join(p.decode() for p in parts) == run
        assert max(map(len, parts)) < language_id.WORD_MOST


def test_scripts_without_spaces_and_a_nameless_language(make_docs):
    """Chinese and Japanese are told apart by what stands deep in their clauses; '' is a language like others."""
    rng = random.Random(3)
    shared, own = [chr(0x4E00 + i) for i in range(60)], {"zh": [chr(0x5100 + i) for i in range(30)], "ja": [chr(0x3041 + i) for i in range(30)]}
    kinds = {"ru": "привет это простой русский текст", "": "qux zot blip vorp snag", "uk": "привіт це простий український текст"}

    def text(lang):
        if lang in own:  # the first 20 characters of a clause tell nothing
            return " ".join("".join(rng.choices(shared, k=20) + rng.choices(own[lang], k=15)) for _ in range(6))
        return " ".join(rng.choices(kinds[lang].split(), k=30))

    langs = [*own, *kinds]
    rows = [(i, text(langs[i % 5]), langs[i % 5]) for i in range(400)]
    got = {r["doc_id"]: r for r in language_id.identify(make_docs(rows)).collect()}
    held = [(d, lang) for d, _, lang in rows if got[d]["held_out"]]
    assert len(held) > 80 and sum(got[d]["lang_pred"] == lang for d, lang in held) > 0.97 * len(held)


def test_op4_odd(odd_docs, no_docs, spark):
    got = language_id.identify(odd_docs.withColumn("score", F.lit("clash"))).collect()
    assert len(got) == 11
    by = {(r["doc_id"]): r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0.0 for i in (1, 2, 3, 9))
    assert by[4]["lang_pred"] == "en"
    assert language_id.identify(no_docs).count() == 0
    unlabeled = language_id.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabeled} == {"und"}


def test_op5(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op5_quality_ranking"](spark, SF)
    assert got.count() == 1000 and got.where("score < 0 OR score > 1 OR predicted <> int(score >= 0.3)").count() == 0
    held = got.where("held_out").join(labels, "doc_id")
    assert held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
    again = {r["doc_id"]: r["score"] for r in QUERIES["op5_quality_ranking"](spark, SF).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got.collect()}


def test_op5_odd(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(4, 1), (6, 1), (7, 0), (9, 0), (5, None), (None, 1), (4, 1)], "doc_id long, quality int")
    got = quality_ranking.rank_quality(odd_docs.withColumn("label", F.lit("clash")), labels).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    assert quality_ranking.rank_quality(no_docs, labels).count() == 0
    one_class = quality_ranking.rank_quality(odd_docs, labels.where("quality = 1")).collect()
    assert {r["score"] for r in one_class} == {0.5}
    assert quality_ranking.keep_good(odd_docs, labels).schema == odd_docs.schema


def test_pairs_are_ranked():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    labels = (x @ np.array([2.0, -1, 0, 0, 1]) + rng.normal(size=400) * 0.3 > -1.5).astype(int)
    model = quality_ranking.fit(labels, x)
    s = quality_ranking.scores(model, x)
    good, bad = s[labels == 1], s[labels == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert abs((s < quality_ranking.CUT).mean() - (labels == 0).mean()) < 0.01


def test_op5_learns_from_all_labels(spark):
    n = 24_000
    text = "concat(repeat(concat('Word', id % 97, ' and '), 3 + id * 31 % 41), if(id % 7 = 3, repeat(concat('#! ', id % 13, '$ '), 1 + id % 29), 'more. It ends here.'))"
    docs = spark.range(n).selectExpr("id AS doc_id", f"{text} AS text").unionAll(spark.createDataFrame([(None, "x"), (n, "y")], "doc_id long, text string"))
    labels = spark.range(n).selectExpr("id AS doc_id", "int(id % 7 <> 3 OR id % 5 = 0) AS quality")
    texts = [r["text"] for r in docs.where(f"doc_id < {n}").orderBy("doc_id").collect()]
    x = quality_ranking.features(*flat.column(pa.array(texts)))
    y = np.array([int(i % 7 != 3 or i % 5 == 0) for i in range(n)])
    order = sorted(range(n), key=lambda i: (y[i], x[i].tolist()))
    want, got = quality_ranking.fit(y[order], x[order]), quality_ranking.train(docs, labels)
    for name in ("mean", "scale", "w", "threshold"):
        assert np.allclose(got[name], want[name], rtol=1e-7, atol=1e-9), name
    u = np.sort(np.clip((x - want["mean"]) / want["scale"], -8, 8) @ want["w"])
    assert abs(want["threshold"] - u[(y == 0).sum() - 1 :][:2].mean()) < 1e-12
    again = quality_ranking.train(docs.repartition(7), labels.repartition(3))
    assert all(np.array_equal(got[k], again[k]) for k in got)


@pytest.mark.parametrize(("good", "bad"), [(1, 1), (1, 20_000), (20_000, 1), (7919, 1000), (9000, 700), (5, 3)])
def test_every_label_is_in_a_pair(good, bad, spark):
    each, step = quality_ranking.rivals(good, bad)
    assert each >= 8 and set((np.arange(bad * each) * step % good).tolist()) == set(range(good))
    if max(good, bad) == 20_000:
        docs = spark.range(good + bad).selectExpr("id AS doc_id", "concat(repeat('some words ', 1 + id % 50), id * 7919 % 1000) AS text")
        labels = spark.range(good + bad).selectExpr("id AS doc_id", f"int(id < {good}) AS quality")
        rows = docs.orderBy("doc_id").collect()
        x = quality_ranking.features(*flat.column(pa.array([r["text"] for r in rows])))
        order = sorted(range(good + bad), key=lambda i: (i < good, x[i].tolist()))
        want = quality_ranking.fit(np.array(order) < good, x[order])
        assert np.allclose(quality_ranking.train(docs, labels)["w"], want["w"], rtol=1e-6, atol=1e-9)


def _tokens(text):
    return plain.words(plain.lower(text)) + ["\n"]


def _plain_model(texts, least_share):
    """The interpolated model by plain dictionaries."""
    one, two, three = Counter(), Counter(), Counter()
    for t in texts:
        k = _tokens(t)
        one.update(k)
        two.update(zip(k, k[1:]))
        three.update(zip(k, k[1:], k[2:]))
    total, kinds = sum(one.values()), len(one)
    least = max(2.0, least_share * total)
    words = {w for w, c in one.items() if c >= least}
    two = {g: c for g, c in two.items() if c >= least}
    three = {g: c for g, c in three.items() if c >= least}
    d = language_model.DISCOUNT

    def p1(w):
        return (one[w] + 0.1) / (total + 0.1 * (kinds + 1))

    def backoff(h, table, c):
        return 1 - sum(n - d for g, n in table.items() if g[:-1] == h) / c

    fail1 = {w: backoff((w,), two, one[w]) for w in words}
    fail2 = {g: backoff(g, three, c) for g, c in two.items()}

    def p2(v, w):
        if v not in words:
            return p1(w)
        return (max(two.get((v, w), 0) - d, 0) / one[v] if (v, w) in two else 0) + fail1[v] * p1(w)

    def p3(u, v, w):
        if (u, v) not in two:
            return p2(v, w)
        return ((three[(u, v, w)] - d) / two[(u, v)] if (u, v, w) in three else 0) + fail2[(u, v)] * p2(v, w)

    def score(t):
        k, out = _tokens(t), 0.0
        for i, w in enumerate(k):
            out += math.log10(p1(w) if i == 0 else p2(k[i - 1], w) if i == 1 else p3(k[i - 2], k[i - 1], w))
        return out

    base = lambda t: sum(math.log10(p1(w)) for w in _tokens(t))
    return score, base, one, total


def test_automaton_equals_plain_model(make_docs, monkeypatch):
    monkeypatch.setattr(language_model, "LANE", 7)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(0, 120))) for _ in range(60)] + [None, "", "A ax AX", "never seen words here"]
    docs = make_docs(list(enumerate(texts)))
    training = docs.where("doc_id % 3 <> 0")
    score, base, one, total = _plain_model([t for i, t in enumerate(texts) if i % 3], 1e-3)
    automaton, _, n, _ = language_model.train(training, 1e-3)
    assert n == total and len(automaton["arcs"]) > 50
    got = language_model.score_texts(docs, training, 1e-3).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["n_tokens"] == len(_tokens(t)) and r["n_known"] == sum(one[w] > 0 for w in _tokens(t)) and r["train_tokens"] == total
        assert r["base_score"] == pytest.approx(base(t), rel=1e-9)
        assert r["score"] == pytest.approx(score(t), rel=1e-9)


def test_rare_ngrams_are_scored_exactly(make_docs, monkeypatch):
    """With next to nothing sent to the tasks, every n-gram that stands twice still has its arc."""
    monkeypatch.setattr(language_model, "SENT_SHARE", 0.02, raising=False)
    rng = random.Random(6)
    words, weights = [f"w{i}" for i in range(60)], [1 / (i + 1) for i in range(60)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randrange(0, 120))) for _ in range(60)] + [None, "", "once w1 only", "W0 w0 w1"]
    docs = make_docs(list(enumerate(texts)))
    training = docs.where("doc_id % 3 <> 0")
    score, base, one, total = _plain_model([t for i, t in enumerate(texts) if i % 3], 0.0)
    automaton, _, _, _ = language_model.train(training)
    assert 0 < len(automaton["words"]) < sum(c >= 2 for c in one.values()) and not len(automaton["triples"])
    for r in language_model.score_texts(docs, training).collect():
        t = texts[r["doc_id"]]
        assert r["n_known"] == sum(one[w] > 0 for w in _tokens(t)) and r["base_score"] == pytest.approx(base(t), rel=1e-9)
        assert r["score"] == pytest.approx(score(t), rel=1e-9)


def test_scoring_leaves_only_what_it_reads(make_docs, spark):
    folder = Path(checkpoint_root(spark).removeprefix("file:"))
    docs = make_docs([(i, f"some words stand here and there {i % 3} and some words stand again") for i in range(20)])
    before = set(folder.iterdir())
    assert language_model.score_texts(docs, docs).count() == 20
    left = [p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before]
    assert left == ["values"]


def test_triples_travel_apart_from_words_and_pairs(make_docs, monkeypatch):
    """What the last join reads holds one value for the triples of a text, also of a repeated one."""
    monkeypatch.setattr(language_model, "SENT_SHARE", 0.02, raising=False)
    written, staged = {}, language_model.staged

    def counted(df, label):
        kept = staged(df, label)
        written[label] = kept.count()
        return kept

    monkeypatch.setattr(language_model, "staged", counted)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(100)) for _ in range(20)]
    docs = make_docs([*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, texts[3])])
    got = language_model.score_texts(docs, docs.where("doc_id is not null")).collect()
    score = _plain_model([*texts, texts[3], texts[3]], 0.0)[0]
    assert len(got) == 23 and all(r["score"] == pytest.approx(score(texts[3 if r["doc_id"] is None else r["doc_id"]]), rel=1e-9) for r in got)
    assert written["triple_weights"] > 200 and written["values"] <= written["word_weights"] + written["pair_weights"] + 21


def test_gram_counts_at_any_merge(monkeypatch):
    monkeypatch.setattr(language_model, "MERGE_AT", 64)
    rng = np.random.default_rng(3)
    counter, want = language_model._GramCounter(), Counter()
    assert not list(counter.batches())
    for _ in range(30):
        a, b = rng.integers(0, 9, 10), rng.integers(0, 9, 10)
        counter.add(a, b)
        want.update(zip(a.tolist(), b.tolist()))
    got = [row for batch in counter.batches() for row in zip(*(c.to_pylist() for c in batch.columns))]
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want


def test_a_counting_task_holds_little():
    """All grams differ, so nothing that is merged gets smaller."""
    rng = np.random.default_rng(5)
    texts = (pa.RecordBatch.from_pydict({"text": ["a"]}) for _ in range(50))
    counting = language_model._counted_grams(lambda batch: (rng.integers(0, 1 << 60, 80_000), rng.integers(0, 1 << 60, 80_000)))(texts)
    tracemalloc.start()
    rows = sum(batch.num_rows for batch in counting)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 50 * 80_000 and peak < 120 << 20


def test_grams_travel_in_groups(make_docs, monkeypatch):
    """Counted grams cross the shuffle as arrays, merged by group, in place of a row for each gram."""
    monkeypatch.setattr(language_model, "GROUP_GRAMS", 50, raising=False)
    monkeypatch.setattr(language_model, "HAND_ON", 64)
    monkeypatch.setattr(language_model, "MERGE_AT", 32)
    plans, staged = [], language_model.staged

    def planned(df, label):
        if label == "grams":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return staged(df, label)

    monkeypatch.setattr(language_model, "staged", planned)
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 60))) for _ in range(80)] + ["a b " * 300, None, ""]
    docs = make_docs([*enumerate(texts), (0, texts[0])]).repartition(5)
    score, _, _, _ = _plain_model([*texts, texts[0]], 0.0)
    got = language_model.score_texts(docs, docs).collect()
    assert len(got) == len(texts) + 1 and all(r["score"] == pytest.approx(score(texts[r["doc_id"]]), rel=1e-9) for r in got)
    assert len(plans) == 2 and all("FlatMapGroupsInArrow" in p and "Aggregate" not in p for p in plans)


def test_groups_hold_every_gram_once():
    rng = np.random.default_rng(7)
    a, b, n = rng.integers(-(1 << 62), 1 << 62, 5000), rng.integers(0, 1 << 62, 5000), rng.integers(1, 99, 5000)
    order = np.argsort(language_model._gram_key(a, b))
    a, b, n = a[order], b[order], n[order]
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 1300]) for x in (a, b, n)], names=["a", "b", "n"]) for i in range(0, 5000, 1300)]
    for groups in (1, 7, 40):
        rows = [r for batch in language_model._grouped(batches, groups) for r in batch.to_pylist()]
        assert len(rows) <= groups + len(batches) and {r["g"] for r in rows} == set(range(groups))
        assert [x for r in rows for x in zip(r["a"], r["b"], r["n"])] == list(zip(a.tolist(), b.tolist(), n.tolist()))
        for r in rows:
            assert set(language_model._group_of(language_model._gram_key(np.array(r["a"]), np.array(r["b"])), groups).tolist()) == {r["g"]}


@pytest.mark.parametrize("bits", [2, 22])
def test_places_are_those_of_lookup(monkeypatch, bits):
    monkeypatch.setattr(flat.Places, "SLOT_BITS", bits)
    rng = np.random.default_rng(4)
    for size in (0, 1, 2, 3, 1000):
        keys = np.unique(np.concatenate([rng.integers(-(1 << 63), (1 << 63) - 1, size), np.arange(size)])[:size])
        wanted = np.concatenate([keys, keys + 1, keys - 1, rng.integers(-(1 << 63), (1 << 63) - 1, 500), [0, -1, -2]])
        assert (flat.Places(keys).find(wanted) == flat.lookup(keys, wanted)).all()
        assert not len(flat.Places(keys).find(wanted[:0]))


@pytest.mark.parametrize("bits", [64, 1 << 10, 1 << 27])
def test_maps_hold_every_key(spark, monkeypatch, bits):
    """Each batch of keys is merged before Spark adds the batches up, and no key is lost at any size of the map."""
    monkeypatch.setattr(language_model, "KEPT_BITS", bits)
    rng = np.random.default_rng(2)
    keys = np.concatenate([np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, 3000)), [0, -1, 1, (1 << 63) - 1, -(1 << 63)]])
    kept = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(3)
    flags = language_model._kept_map(kept, "k")
    assert len(flags) == bits // 64 and language_model._may_hold(flags, keys).all()
    assert sum(int(x).bit_count() for x in flags.view(np.uint64)) == len(set(language_model._slot(keys).tolist()))
    assert not language_model._kept_map(kept.limit(0), "k").any()


def test_arcs_are_sorted_once(make_docs):
    docs = make_docs([(i, "some words stand here and some words stand again") for i in range(5)])
    arcs = language_model.train(docs)[0]["arcs"]
    assert len(arcs) > 5 and (np.diff(arcs) > 0).all()


def test_op7(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    import zlib

    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in rows}
    counts = Counter(w for r in rows if not held[r["doc_id"]] for w in _tokens(r["text"]))
    total, kinds = sum(counts.values()), len(counts)
    texts = {r["doc_id"]: r["text"] for r in rows}
    better = []
    for r in QUERIES["op7_backoff_automaton"](spark, "/root/testdata/sf0.001").collect():
        want = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in _tokens(texts[r["doc_id"]]))
        assert r["base_score"] == pytest.approx(want, rel=1e-9) and r["held_out"] == held[r["doc_id"]] and r["train_tokens"] == total
        if r["held_out"]:
            better.append(r["score"] - r["base_score"])
    assert sum(better) > 0


def test_op7_odd(odd_docs, no_docs):
    got = language_model.score_texts(odd_docs.withColumn("row", F.lit(1)), odd_docs).collect()
    assert len(got) == 11 and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert language_model.score_texts(no_docs, no_docs).count() == 0
    untrained = language_model.score_texts(odd_docs, no_docs).collect()
    assert {r["n_known"] for r in untrained} == {0} and all(math.isfinite(r["score"]) for r in untrained)


def test_words_match_plain(odd_docs):
    import pyarrow as pa

    texts = [r["text"] for r in odd_docs.collect()] + ["a\x0bb\x0cc d e f\x1cg"]
    data, bounds = flat.column(pa.array(texts, pa.string()))
    starts, ends, before = flat.word_spans(data, bounds)
    for i, t in enumerate(texts):
        assert [bytes(data[a:b]).decode() for a, b in zip(starts[before[i] : before[i + 1]], ends[before[i] : before[i + 1]])] == plain.words(t)


def test_long_words_hash_alike():
    data = np.frombuffer(b"q" * 3_000_000 + b" " + b"q" * 3_000_000 + b" " + b"q" * 2_999_999, np.uint8)
    starts, ends, _ = flat.word_spans(data, np.array([0, len(data)]))
    a, b, c = flat.span_hashes(data, starts, ends)
    assert a == b != c


def test_short_hashes_tell_words_apart():
    """At every length, wherever a word stands and whatever follows it."""
    rng = random.Random(5)
    words = [b"a", b"a\x00", b"\x00", b"\x00\x00", *(bytes(rng.choices(b"ab", k=n)) for n in range(1, 150) for _ in range(6)), "Привет".encode()]
    spans = words + words[::-1]
    data = np.frombuffer(b"".join(w + rng.choice([b" ", b"\n\n", b"\xff"]) for w in spans)[:-1], np.uint8)
    starts, at = [], 0
    for w in spans:
        at = bytes(data).index(w, at)
        starts.append(at)
        at += len(w)
    got = flat.short_hashes(data, np.array(starts), np.array([s + len(w) for s, w in zip(starts, spans)])).tolist()
    assert len(set(zip(spans, got))) == len(set(got)) == len(set(spans))
    none = np.zeros(0, np.int64)
    assert not len(flat.short_hashes(np.zeros(0, np.uint8), none, none))


def test_lower_ascii_at_every_byte():
    every = np.arange(256, dtype=np.uint8)
    assert bytes(flat.lower_ascii(every)) == bytes(every).lower() and not len(flat.lower_ascii(every[:0]))
