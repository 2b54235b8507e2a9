"""The filter audit against its SQL and plain loops, vector codes against plain integers."""

import hashlib
import itertools
import math
import re

import duckdb
import numpy as np
import pytest

from quern.llm import filter_audit, queries, vector_codes
from tests.llm import plain

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>, label int"


def _plain_audit(docs, labels):
    """{(part, order, step): figures} by walking through every order document by document."""
    texts = [(d, t or "", lang or "") for d, t, lang in docs]
    rows = []
    for d, t, part in texts:
        w = plain.words(t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and any(e is not None and e < d and t == u for e, u, _ in texts),
        }
        marks = [x for x in labels if d is not None and x[0] == d]
        rows.append((part, {f for f, bad in fails.items() if bad}, any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks)))
    out, shares = {}, {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                own, gone = [r for r in left if f in r[1]], [r for r in rows if r[0] == part and r not in left]
                before = set(order[: step - 1])
                redundant = sum(r[0] == part and f in r[1] and bool(r[1] & before) for r in rows)
                left = [r for r in left if f not in r[1]]
                unique = sum(r[0] == part and r[1] == {f} for r in rows)
                out[part, "".join(order), step] = [len(left), len(own), redundant, unique, sum(r[2] for r in own), sum(r[3] for r in own)]
                shares[part, f] = shares.get((part, f), 0) + len(own)
                assert redundant == sum(f in r[1] for r in gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _audit(found):
    rows = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found.collect()}
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return rows


def test_audit_matches_its_sql(spark):
    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = queries.QUERIES["op11_filter_audit"](spark, SF)
    want = duck.sql(queries.ORACLES["op11_filter_audit"])
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.select(*got.columns).fetchall())


def test_audit_of_odd_rows(spark, odd_docs):
    labels = [(4, 1, 1), (4, 0, 0), (5, 1, None), (6, None, 1), (None, 1, 1), (99, 1, 1)]
    docs = odd_docs.selectExpr("*", "doc_id AS mask", "text AS Part", "1 AS cells")
    want = _plain_audit([(r["doc_id"], r["text"], r["lang"]) for r in odd_docs.collect()], labels)
    assert _audit(filter_audit.audit_filters(docs, spark.createDataFrame(labels, LABELS))) == want


def test_audit_of_a_large_group_of_copies(spark, make_docs):
    docs = [(i, "the same few words", "en") for i in range(300)] + [(1000 + i, f"word{i} # B" * 60, "fr") for i in range(40)] + [(2000, "X", None)]
    got = _audit(filter_audit.audit_filters(make_docs(docs), spark.createDataFrame([(i, i % 2, 1) for i in range(300)], LABELS)))
    assert got == _plain_audit(docs, [(i, i % 2, 1) for i in range(300)])
    assert got["en", "EABCD", 1] == (1, 299, 0, 0, 150, 299, got["en", "EABCD", 1][-1])


def test_audit_of_many_parts(spark, make_docs):
    """More rows than Spark lets a recursion make by default; the session's setting stays."""
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "500")
    try:
        found = filter_audit.audit_filters(make_docs([(i, "a b", f"l{i}") for i in range(12)]), spark.createDataFrame([], LABELS))
        assert found.count() == 12 * 600
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "500"
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)


def test_audit_of_nothing(spark, no_docs):
    assert filter_audit.audit_filters(no_docs, spark.createDataFrame([], LABELS)).count() == 0


def _plain_codes(rows):
    kept = [(v, [max(-(1 << 52), min(1 << 52, math.floor(4096 * float(c)))) for c in e], lab) for v, e, lab in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    length = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == length]
    parts = [[r[1][i * length // 8 : (i + 1) * length // 8] for r in kept] for i in range(8)]
    books = [list(p[:16]) for p in parts]

    def assign(part, book):
        each = [[sum((a - b) ** 2 for a, b in zip(x, e)) for e in book] for x in part]
        return [d.index(min(d)) for d in each], [min(d) for d in each]

    for _ in range(6):
        for part, book in zip(parts, books):
            which, _ = assign(part, book)
            for e in range(len(book)):
                own = [x for x, w in zip(part, which) if w == e]
                if own:
                    book[e] = [sum(c) // len(own) for c in zip(*own)]
    found = [assign(p, b) for p, b in zip(parts, books)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [min(sum(f[1][i] for f in found), (1 << 63) - 1) for i in range(len(kept))]
    total = {}
    for r, e in zip(kept, errors):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{f[0][i]:02x}" for f in found), errors[i], min(total[r[2]], (1 << 63) - 1), digest) for i, r in enumerate(kept)), key=str)


def _codes(spark, rows, parts=3):
    got = vector_codes.code_digests(spark.createDataFrame(rows, VECTORS).repartition(parts))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def test_codes_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = queries.QUERIES["op13_vector_codes"](spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == _plain_codes(rows)


def _vectors(n, length, seed, scale=1.0):
    values = (np.random.default_rng(seed).normal(size=(n, length)) * scale).astype(np.float32)
    return [(i, [float(x) for x in v], i % 4 if i % 5 else None) for i, v in enumerate(values)]


def test_codes_of_odd_vectors(spark):
    rows = _vectors(60, 16, 1)
    rows += [(None, rows[3][1], 2), (100, None, 1), (101, [None] + [0.5] * 15, 1), (102, [float("nan")] * 16, 1), (103, [float("-inf")] + [1.0] * 15, 1)]
    rows += [(104, [1.0] * 15, 1), (105, [], 1), (7, rows[7][1], 3), (7, rows[8][1], 3)] + [(200 + i, rows[0][1], 0) for i in range(50)]
    assert _codes(spark, rows) == _plain_codes(rows)


@pytest.mark.parametrize("length", [0, 3, 8, 20])
def test_codes_of_other_lengths(spark, length):
    rows = _vectors(30, length, 2)
    assert _codes(spark, rows) == _plain_codes(rows)


def test_codes_with_ties_and_few_rows(spark):
    ties = [(i, [float((i >> b) % 2) for b in range(8)] * 2, 0) for i in range(64)]
    assert _codes(spark, ties) == _plain_codes(ties)
    assert _codes(spark, ties[:5]) == _plain_codes(ties[:5])


def test_codes_of_large_numbers(spark):
    rows = _vectors(40, 16, 3) + [(100 + i, v, lab) for i, v, lab in _vectors(20, 16, 4, 1e5)]
    assert _codes(spark, rows) == _plain_codes(rows)
    huge = rows + [(300, [3e38] * 16, 1), (301, [-3e38] * 16, None), (302, [1e30, -1e30] * 8, None)]
    assert _codes(spark, huge) == _plain_codes(huge)


def test_no_codes(spark):
    assert _codes(spark, []) == []
    assert _codes(spark, [(1, None, 1), (2, [float("inf")], 1)]) == []


def test_bounds_prune_without_changing_anything():
    """Far fewer exact distances than points times entries, and the entry that all distances give."""
    rng = np.random.default_rng(5)
    book = rng.integers(-4000, 4000, (16, 8))
    points = book[rng.integers(0, 16, 500)] + rng.integers(-200, 200, (500, 8))
    pivots = vector_codes.spread_pivots(book)
    far, between = vector_codes.roots(points, pivots), vector_codes.roots(book, pivots)
    which, best = vector_codes.nearest_entries(points, far, book, between)
    each = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (which == each.argmin(axis=1)).all() and (best == each.min(axis=1)).all()
    bound = np.abs(far[:, None] - between[None]).max(axis=2) - 2
    assert (bound.clip(0) ** 2 <= each).all() and (bound.clip(0) ** 2 <= best[:, None]).sum() < 2 * len(points)
