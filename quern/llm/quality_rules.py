"""Quality rules: base counts of every text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams (single tokens and pairs) are counted: one over the trusted target
texts, one over the whole raw corpus. A text's score is the mean of log(target / raw) over its n-grams,
so its length does not matter; a text is kept when the score reaches a fixed threshold. There is no
sampling: equal texts always get equal verdicts.

Null text: as an empty text, with no words, and so base_failed. Empty table: empty result. An unlabelled
corpus (no trusted text): all ratios are 0 and only the base rules decide. Rows are handled one by one,
so repeated rows and repeated doc_ids give a row each. Other columns of the inputs are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.columns import let, whole_text, words

#: A run of letters, digits and underscores, or a run of other visible characters.
TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
BUCKETS = 16384
#: Added to each bucket's count before both multinomials are normalised.
SMOOTHING = 1.0
#: Mean log ratio per n-gram below which a text is rejected.
THRESHOLD = -0.1
WINDOW = 8


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKENS), F.lit(0))


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.hash(*parts), F.lit(BUCKETS))


def _ngram_buckets(toks: Column) -> Column:
    """Buckets of the single tokens, then of the pairs."""
    single = F.transform(toks, lambda t: _bucket(t))
    pair = F.transform(F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0))), lambda t, i: _bucket(F.get(toks, i), t))
    return F.concat(single, pair)


def bucket_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): n-grams of all whole texts by bucket; counted in each task before the shuffle."""
    buckets = let(tokens(whole_text(text)), _ngram_buckets)
    return docs.select(F.explode(buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def ratios(raw: DataFrame, target: DataFrame) -> DataFrame:
    """One row: the log ratio of the two smoothed multinomials for every bucket, by bucket number."""
    every = raw.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw.withColumnRenamed("n", "r"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["r", "t"])
    row = both.agg(F.sort_array(F.collect_list(F.struct("bucket", "r", "t"))).alias("b"), F.sum("r").alias("r"), F.sum("t").alias("t"))
    pad = SMOOTHING * BUCKETS
    ratio = F.transform("b", lambda x: F.log((x.t + SMOOTHING) / (F.col("t") + pad)) - F.log((x.r + SMOOTHING) / (F.col("r") + pad)))
    return row.select(F.when(F.col("t") > 0, ratio).otherwise(F.transform("b", lambda x: F.lit(0.0))).alias("ratios"))


def mean_ratio(text: Column, model: Column) -> Column:
    """Mean log ratio over the n-grams of a text; 0 without any."""
    zero = F.lit(0.0)
    total = let(
        tokens(text),
        lambda toks: F.aggregate(
            _ngram_buckets(toks), zero, lambda a, b: a + F.get(model, b), lambda a: a / F.greatest(2 * F.size(toks) - 1, F.lit(1))
        ),
    )
    return F.coalesce(total, zero)


def repeated_words(w: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of `size` words which stands at two or more places of the text."""

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twin = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            found = F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))
            steps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size))))
            return let(found, lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x))

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, of_sorted))

    def windows(ids: Column) -> Column:
        firsts = F.slice(ids, F.lit(1), F.size(ids) - (size - 1))
        return F.transform(firsts, lambda x, i: F.xxhash64(x, *[F.get(ids, i + k) for k in range(1, size)]))

    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) <= size, F.lit(0)).otherwise(let(hashed, lambda ids: let(windows(ids), covered))).cast("long")


def base_counts(docs: DataFrame, text: str = "text", *keep: str | Column) -> DataFrame:
    body = whole_text(text)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    per_word = let(
        words(body),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0), lambda a, x: a + F.char_length(x)).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    return docs.select(
        *keep,
        per_word.alias("_w"),
        F.char_length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select(*_names(docs, keep), "_w.n_words", "_w.word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words")


def _names(docs: DataFrame, keep) -> list[str]:
    return docs.select(*keep).columns


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id with the base counts, base_failed, the score and the verdict `kept` of every document.

    docs: doc_id, text. trusted: doc_ids of the trusted target texts; those texts are found by a
    shuffled join on doc_id, the only step that moves texts.
    """
    body = docs.select("doc_id", "text")
    # One plan at every size: the texts are dealt out by doc_id once, whatever the number of trusted ids.
    target = body.join(trusted.select("doc_id").where("doc_id IS NOT NULL").hint("shuffle_merge"), "doc_id", "left_semi")
    model = ratios(bucket_counts(body), bucket_counts(target))
    held = body.select("doc_id", "text", model.scalar().alias("_ratios"))
    found = base_counts(held, "text", "doc_id", mean_ratio(whole_text(), F.col("_ratios")).alias("score"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score",
    )
