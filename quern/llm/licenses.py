"""License scans: phrase places, and an exact set-similarity join of text blocks with license templates.

A block is a run of lines up to an empty one, so a notice wrapped over lines is compared as a whole; it is
cut further after a full stop, question or exclamation mark and white space.
Its tokens are compared as a set with each template's tokens; a block meets a template when it holds at
least `threshold` of the template's distinct tokens. The join is exact: tokens are ordered by how often
they stand in the whole corpus, rarest first. A block that meets a template must hold one of the first
|T| - need + 1 tokens of the template in that order (prefix filter), must hold at least `need` tokens of
the template vocabulary (length filter), and from the first shared token on both must have enough tokens
left (positional filter). Pairs that pass are counted in full.

The inverted index (prefix token to templates) is as large as the templates, which are a fixed list; it
travels as a literal, so no text is shuffled and a line that stands in a third of all texts costs no more
than any other.

Null text: as an empty text, with no words and no labels. Empty table: empty result. Each row is handled
by itself: repeated rows and doc_ids give a row each; equal labels are listed once. Other columns are not
read.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.columns import let, whole_text

#: Runs of characters that part words once A-Z are a-z, what parts blocks, and the base phrases.
PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_ENDS = r"\n[^\S\n]*+\n|(?<=[.!?])\s+"
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
#: The usual notice of each license.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
]
THRESHOLD = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: Column) -> Column:
    return F.filter(F.split(text, PARTS), lambda w: w != "")


def _literals(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def token_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """How often each word of a fixed vocabulary stands in all whole texts."""
    found = docs.select(F.explode(_split(F.lower(whole_text(text)))).alias("w")).where(F.col("w").isin(vocabulary))
    return {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}


def template_index(templates: list[tuple[str, str]], counts: dict[str, int], threshold: float) -> tuple[list[str], list, dict]:
    """The vocabulary in rising frequency, each template as (label, ranks, need), and prefix rank to templates."""
    order = sorted({w for _, t in templates for w in t.split()}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows, index = [], {}
    for number, (label, body) in enumerate(templates):
        ranks = sorted({rank[w] for w in body.split()})
        need = ceil(threshold * len(ranks) - 1e-9)
        rows.append((label, ranks, need))
        for r in ranks[: len(ranks) - need + 1]:
            index.setdefault(r, []).append(number)
    return order, rows, index


def _starts(w: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after another, words counted from 0."""
    parts = phrase.split()

    def here(x: Column, i: Column) -> Column:
        found = x == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & (F.coalesce(F.get(w, i + k), F.lit("")) == part)
        return F.when(found, i)

    return F.filter(F.transform(w, here), lambda i: i.isNotNull())


def _block_matches(text: Column, order: list[str], rows: list, index: dict, threshold: float) -> Column:
    """For every block and template that meet: struct(label, containment)."""
    vocabulary = F.create_map(*[F.lit(v) for i, w in enumerate(order) for v in (w, i)])
    first_least = min(need for _, _, need in rows)
    postings = F.create_map(*[x for r, ids in sorted(index.items()) for x in (F.lit(r), _literals(ids))])
    templates = F.array(*[F.struct(F.lit(label).alias("label"), _literals(ranks).alias("ranks"), F.lit(need).alias("need")) for label, ranks, need in rows])

    def of_block(ranks: Column) -> Column:
        candidates = F.array_distinct(F.flatten(F.filter(F.transform(ranks, lambda r: postings[r]), lambda p: p.isNotNull())))

        def checked(number: Column) -> Column:
            t = F.get(templates, number)
            shared = let(F.array_intersect(t["ranks"], ranks), lambda s: s)
            first = F.get(shared, F.lit(0))
            left_t = F.size(t["ranks"]) - F.array_position(t["ranks"], first).cast("int") + 1
            left_b = F.size(ranks) - F.array_position(ranks, first).cast("int") + 1
            passes = (F.size(ranks) >= t["need"]) & (F.least(left_t, left_b) >= t["need"]) & (F.size(shared) >= t["need"])
            return F.when(passes, F.struct(t["label"].alias("label"), (F.size(shared) / F.size(t["ranks"])).alias("score")))

        return F.filter(F.transform(candidates, checked), lambda m: m.isNotNull())

    def ranks(block: Column) -> Column:
        known = F.filter(F.transform(F.array_distinct(_split(block)), lambda w: vocabulary[w]), lambda r: r.isNotNull())
        return F.array_sort(known)

    blocks = F.filter(F.transform(F.split(text, BLOCK_ENDS), ranks), lambda b: F.size(b) >= first_least)
    return F.flatten(F.transform(blocks, of_block))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id with n_words, the base phrase places, base_labels, labels and the highest containment."""
    body = docs.select("doc_id", whole_text().alias("_text"))
    counts = token_counts(body, sorted({w for _, t in templates for w in t.split()}), "_text")
    order, rows, index = template_index(templates, counts, threshold)
    anchors = sorted({order[r] for r in index} | {p.split()[0] for p in PHRASES.values()})
    # Only texts with an anchor word can have a place or a match; lower() finds at least those words.
    seen = body.select("doc_id", "_text", let(_split(F.lower("_text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.arrays_overlap(w, _literals(anchors)).alias("hit"))).alias("_w"))
    plain = F.translate("_text", _UPPER, _LOWER)
    no_starts, no_match = F.array().cast("array<int>"), F.array().cast("array<struct<label:string,score:double>>")
    places = let(_split(plain), lambda w: F.struct(*[_starts(w, p).alias(label) for label, p in PHRASES.items()]))
    found = seen.select(
        "doc_id",
        F.col("_w.n").alias("n_words"),
        F.when(F.col("_w.hit"), F.struct(places.alias("places"), _block_matches(plain, order, rows, index, threshold).alias("matches"))).alias("_f"),
    ).select(
        "doc_id",
        "n_words",
        *[F.coalesce(F.col("_f.places")[label], no_starts).alias(f"_p{k}") for k, label in enumerate(PHRASES)],
        F.coalesce(F.col("_f.matches"), no_match).alias("_m"),
    )
    every = F.concat(*[f"_p{k}" for k in range(len(PHRASES))])
    base = F.filter(F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES)]), lambda x: x.isNotNull())
    return found.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("_m", lambda m: m["label"])))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("_m", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
