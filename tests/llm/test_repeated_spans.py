"""Repeated strings against a count of all strings of the span's length."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quern.llm import queries, repeated_spans

SF = "/root/testdata/sf0.001"
SPAN = repeated_spans.SPAN


def _plain(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(x[i : i + SPAN] for _, x in texts for i in range(len(x) - SPAN + 1))
    out = []
    for d, x in texts:
        spans, end = [], 0
        for i in range(len(x) - SPAN + 1):
            if count[x[i : i + SPAN]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + SPAN
                else:
                    spans.append([i, i + SPAN])
        kept = b"".join(x[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(x)]))
        out.append((d, len(x), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _found(docs):
    got = repeated_spans.span_digests(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def _noise(seed, size):
    return "".join(random.Random(seed).choices("abcdefghij klmnop", k=size))


def test_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_suffix_ranks"](spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == _plain(rows)


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.selectExpr("*", "doc_id AS name", "1 AS Kept", "text AS spans", "2 AS _doc_key").repartition(5)
    assert _found(docs) == _plain([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    cut = repeated_spans.cut_repeats(docs)
    assert cut.columns == ["doc_id", "text", "lang", "source", "n_chars", "name", "kept", "spans"]
    for row in cut.collect():
        left, text = b"", (row["text"] or "").encode()
        for a, b in zip([0, *(s["stop"] for s in row["spans"])], [*(s["start"] for s in row["spans"]), len(text)]):
            left += text[a:b]
        assert left == bytes(row["kept"])


def test_lengths_at_the_bound(make_docs):
    """A string of one byte less than the span stays, of the span goes; spans that touch are one."""
    a, b = _noise(1, SPAN - 1), _noise(2, SPAN)
    rows = [(1, "x" + a + "y"), (2, "p" + a + "q"), (3, "x" + b + "y"), (4, b), (5, "1" + b + _noise(3, SPAN) + "2"), (6, _noise(3, SPAN))]
    got = _found(make_docs(rows).repartition(3))
    assert got == _plain(rows)
    assert [r[2:4] for r in got] == [(0, 0), (0, 0), (SPAN, 1), (SPAN, 1), (2 * SPAN, 1), (SPAN, 1)]


def test_overlaps_within_a_document(make_docs):
    rows = [(1, "ab" * 150), (2, "z" * 201), (3, "y" * 200), (4, _noise(4, 700) * 2), (5, "xyz" * 400), (6, "é" * 150)]
    assert _found(make_docs(rows)) == _plain(rows)


def test_many_runs_under_one_name(make_docs):
    """A passage within more texts than one task compares: ends that some of them share, and ends of their own."""
    passage = _noise(5, 150)
    rows = [(i, _noise(10_000 + i, 90) + passage + _noise(20_000 + i, 90)) for i in range(repeated_spans.GROUP + 900)]
    rows += [(50_000 + i, _noise(i, 60) + _noise(6, 40) + passage + _noise(7 + i % 3, 30) + _noise(i, 70)) for i in range(400)]
    rows += [(60_000 + i, _noise(8, 500)) for i in range(300)]
    got = _found(make_docs(rows).repartition(7))
    assert got == _plain(rows)
    assert sum(r[2] > 0 for r in got) == 700


def test_long_texts_in_pieces(make_docs):
    """Repeats across the ends of pieces, found from either side."""
    size = repeated_spans.PIECE
    shared = [_noise(30 + i, 900) for i in range(4)]
    long = bytearray(_noise(40, size * 2 + 5_000).encode())
    for at, text in zip((size - 450, size + 300, 2 * size - 850, 2 * size + 4_100), shared):
        long[at : at + 900] = text.encode()
    rows = [(1, long.decode()), (2, "q".join(shared)), (3, shared[1][100:400] + shared[0][:250])]
    assert _found(make_docs(rows)) == _plain(rows)


@pytest.mark.parametrize("seed", range(3))
def test_near_copies(make_docs, seed):
    rng = random.Random(seed)
    base = _noise(seed, 4_000)
    rows = []
    for i in range(60):
        text = list(base[rng.randrange(500) : rng.randrange(2_000, 4_000)])
        for _ in range(rng.randrange(12)):
            text[rng.randrange(len(text))] = rng.choice(["", "ZZ", "#"])
        rows.append((i, "".join(text)))
    assert _found(make_docs(rows).repartition(1 + 4 * seed)) == _plain(rows)


def test_nothing(no_docs, make_docs):
    assert _found(no_docs) == []
    assert _found(make_docs([(1, None), (2, "short"), (2, "short")])) == _plain([(1, None), (2, "short"), (2, "short")])


def test_every_window_has_a_place():
    """Equal windows choose equal places, whatever stands around them, and few places are chosen."""
    rng = np.random.default_rng(1)
    data = rng.integers(97, 120, 30_000).astype(np.uint8)
    data[20_000:21_000] = data[3_000:4_000]
    runs = {int(low) + k: (int(name), int(low)) for low, count, name, _ in zip(*next(repeated_spans.runs_of(data, np.array([0, 30_000])))) for k in range(count)}
    assert sorted(runs) == list(range(30_000 - SPAN + 1))
    assert all(runs[p][0] == runs[p + 17_000][0] for p in range(3_000, 4_000 - SPAN + 1))
    assert len({low for _, low in runs.values()}) < 30_000 / 30
