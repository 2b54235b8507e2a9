"""Filter interaction audit by recursive enumeration: what every order of the filters removes at every step.

One pass over the texts gives every document the bits of the filters that it fails; after that only counts
move. The documents of a part (a lang) fall into mask cells, one per set of failed filters. A recursive
common table expression then extends filter prefixes by each unused letter, joins the cells of the part and
carries the applied bits, so that each level of the recursion emits the figures of its step; the 325
prefixes stand for all 120 orders, which share them.

A: fewer than MIN_WORDS words. B: distinct words below DISTINCT_PERCENT of the words. C: A-Z above
UPPER_PERCENT of the code points. D: one of MARKS. E: the text of a smaller doc_id, whatever was removed.

Null text: empty. Null lang: the part of the empty string. Null doc_id: no copy of another and no model for
one, without labels. Repeated rows (one doc_id) are counted each, and are no copies of one another. Several
labels of a document: it is good, or toxic, if one of them says so. Empty table: empty result. Other columns
are not read. Copies are found by digest and smallest doc_id, and every row asks only for its own pair of
both, so a text that fills a third of the table makes no hot key.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.columns import let, whole_text, words
from quern.session import staged

LETTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
MARKS = "[#$%&*|]"


def failed_bits(text: Column) -> Column:
    """Bits of the filters A to D (1, 2, 4, 8) that a text fails."""
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def of(counts: Column) -> Column:
        checks = [
            counts["words"] < MIN_WORDS,
            100 * counts["kinds"] < DISTINCT_PERCENT * counts["words"],
            100 * upper > UPPER_PERCENT * F.length(text),
            text.rlike(MARKS),
        ]
        return sum((F.when(check, 1 << bit).otherwise(0) for bit, check in enumerate(checks)), F.lit(0))

    sizes = let(words(text), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("kinds")))
    return let(sizes, of)


def read_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every document, all five filters; the texts are read once."""
    text = whole_text()
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), failed_bits(text).alias("bits"), F.md5(text.cast("binary")).alias("digest"))
    rows = staged(rows, "filters")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"))
    first = first.withColumnRenamed("digest", "copied")
    found = rows.join(first, (rows["digest"] == first["copied"]) & (rows["doc_id"] == first["least"]), "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("least").isNull(), 1 << LETTERS.index("E")).otherwise(0)
    return found.select("doc_id", "part", (F.col("bits") + copy).cast("int").alias("mask"))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): for each part its at most 32 cells of mask, documents, good and toxic ones."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic")
    )
    counts = [F.count("*").alias("n")] + [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    cells = read_masks(docs).join(marks, "doc_id", "left").groupBy("part", "mask").agg(*counts)
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def _total(of: str, where: str) -> str:
    return f"aggregate(filter(cells, c -> {where}), 0L, (total, c) -> total + c.{of})"


_STEPS = f"""
WITH RECURSIVE audit (part, prefix, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
    SELECT part, '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
    UNION ALL
    SELECT
        part, concat(prefix, letter), applied | bit, step + 1,
        {_total("n", "c.mask & (applied | bit) = 0")},
        {_total("n", "c.mask & applied = 0 AND c.mask & bit <> 0")},
        {_total("n", "c.mask & applied <> 0 AND c.mask & bit <> 0")},
        {_total("n", "c.mask = bit")},
        {_total("good", "c.mask & applied = 0 AND c.mask & bit <> 0")},
        {_total("toxic", "c.mask & applied = 0 AND c.mask & bit <> 0")}
    FROM (
        SELECT part, prefix, applied, step, cells, letter, shiftleft(1, place) AS bit
        FROM (SELECT a.part, a.prefix, a.applied, a.step, c.cells FROM audit a JOIN {{cells}} c ON a.part = c.part)
        LATERAL VIEW posexplode(split('{LETTERS}', '')) letters AS place, letter
    )
    WHERE applied & bit = 0
)
SELECT * FROM audit WHERE step > 0
"""
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def prefix_steps(cells: DataFrame) -> DataFrame:
    """One row per part and filter prefix: the figures of the prefix's last step; written once.

    The recursion makes 326 rows a part, so the session's limit of rows, meant for endless ones, is lifted
    while it runs.
    """
    spark = cells.sparkSession
    before = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        return staged(spark.sql(_STEPS, cells=cells), "steps")
    finally:
        spark.conf.set(_ROW_LIMIT, before)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    kept, removed, redundant, unique_fails, good_lost and toxic_lost count documents of the part; shapley is
    what the step's filter removes, added up over all orders.
    """
    steps = prefix_steps(staged(mask_cells(docs, labels), "cells")).withColumn("letter", F.expr("right(prefix, 1)"))
    left = len(LETTERS) - F.col("step")
    orders = F.element_at(F.array(*[F.lit(factorial(k)).cast("long") for k in range(len(LETTERS))]), (left + 1).cast("int"))
    shares = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    whole = steps.where(F.col("step") == len(LETTERS)).select("part", F.col("prefix").alias("filter_order"))
    each = whole.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("_step"))
    each = each.withColumn("prefix", F.expr("substring(filter_order, 1, _step)")).drop("_step")
    figures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return each.join(steps, ["part", "prefix"]).join(shares, ["part", "letter"]).select("part", "filter_order", "step", *figures, "shapley")
