"""Mixing sources to target weights by packed token blocks and permuted block indexes.

The words of each source form one stream, in an order that only doc_id and text decide, and are packed
into blocks of `block_words`. A source's target gives its number of output slots: as many whole rounds of all its
blocks as the target holds, then blocks for the rest, by the mean of their words. Every slot falls into
an output shard by a hash, which makes the source counts of a shard a multinomial draw whose totals over
all shards keep to the targets. Slot k of a source with B blocks reads block perm(k mod B) of round
k div B, where perm is a pseudorandom affine permutation of 0..B-1 per source and round; slots and blocks
are then joined by (source, index). A block is read at most once a round, so no text is taken more than
three times.

Null text: size 0, taken 0. Null source: a source of its own, last in the order of sources. Null doc_id:
kept as any other. Repeated rows are separate rows and may be taken differently. Empty table: empty
result. Columns named as the outputs are dropped from the input; other columns are not read by the plan.

Positions in a source's stream come from bucket totals and a running sum within small buckets, so no
window holds a whole source.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.columns import BREAKS, let, whole_text
from quern.session import staged

WEIGHTS = (5, 2, 1)
#: A target never exceeds this many times its source's size.
MOST_ROUNDS = 3
BLOCK_WORDS = 64
OUTPUT_SHARDS = 64
#: Documents of one running-sum window, on average.
BUCKET_ROWS = 4_000
#: Slots made from one row at once.
SLOT_RUN = 8192


def word_count(text: Column) -> Column:
    """Words of the text, without keeping them: break runs that a word follows, plus a leading word."""
    return F.size(F.filter(F.split(text, BREAKS), lambda w: w != "")).cast("long")


def shared_targets(sizes: list[int], weights: list[float], most: float = MOST_ROUNDS) -> list[float]:
    """Targets that share the sum of the sizes by weight; what exceeds most times a size is shared anew."""
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = float(most * sizes[i])
        open_ = [i for i in open_ if i not in full]
        left = total - sum(targets)
    return targets


def _source_rows(spark, sources: list[dict]) -> DataFrame:
    fields = ("source_no", "source_size", "target", "blocks", "slots")
    rows = [F.struct(*[F.lit(s[f]).cast("double" if f == "target" else "long").alias(f) for f in fields]) for s in sources]
    return spark.range(1).select(F.inline(F.array(*rows)))


def plan_sources(sized: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS) -> list[dict]:
    """One entry per source, in code point order with null last: its number, name, size, target, blocks, slots.

    The list has as many entries as there are sources; documents never pass through it.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["size"]) for r in rows]
    targets = shared_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))])
    out = []
    for number, (row, size, target) in enumerate(zip(rows, sizes, targets)):
        blocks = -(-size // block_words)
        rounds = min(MOST_ROUNDS, int(target // size)) if size else 0
        rest = 0 if not size or rounds == MOST_ROUNDS else round((target - rounds * size) * blocks / size)
        slots = rounds * blocks + rest
        out.append({"source_no": number, "source": row["source"], "source_size": size, "target": target, "blocks": blocks, "slots": slots})
    return out


def _multiplier(blocks: int, seed: int) -> int:
    """A number without a common divisor with the number of blocks, near the golden section of it."""
    a = max(1, int(blocks * 0.6180339887498949) + seed)
    while gcd(a, blocks) != 1:
        a += 1
    return a


def slot_rows(spark, sources: list[dict], shards: int = OUTPUT_SHARDS) -> DataFrame:
    """(shard, source_no, slot, block): one row per output slot, its block chosen by the permutation."""
    used = [s for s in sources if s["slots"] > 0]
    if not used:
        return spark.range(0).select(F.lit(0).alias("shard"), F.lit(0).cast("long").alias("source_no"), F.col("id").alias("slot"), F.col("id").alias("block"))
    rows = []
    for s in used:
        steps = F.array(*[F.lit(_multiplier(s["blocks"], 7 * s["source_no"] + 31 * r)).cast("long") for r in range(MOST_ROUNDS)])
        shift = F.array(*[F.lit((s["blocks"] // 3 * (r + 1) + s["source_no"]) % s["blocks"]).cast("long") for r in range(MOST_ROUNDS)])
        rows.append(F.struct(*[F.lit(s[f]).cast("long").alias(f) for f in ("source_no", "blocks", "slots")], steps.alias("steps"), shift.alias("shift")))
    parts = max(1, min(20_000, sum(s["slots"] for s in used) // (SLOT_RUN * 4)))
    runs = (
        spark.range(1)
        .select(F.inline(F.array(*rows)))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOT_RUN))).alias("run"))
        .repartition(parts, "source_no", "run")  # a number, as the few rows stand for many slots
    )
    each = runs.select("*", F.explode(F.sequence(F.col("run") * SLOT_RUN, F.least(F.col("slots"), (F.col("run") + 1) * SLOT_RUN) - 1)).alias("slot"))
    turn = F.floor(F.col("slot") / F.col("blocks")).cast("int")
    wide = F.pmod("slot", "blocks").cast("decimal(19,0)") * F.get("steps", turn).cast("decimal(19,0)") + F.get("shift", turn)
    return each.select(
        F.pmod(F.xxhash64("source_no", "slot"), F.lit(shards)).cast("int").alias("shard"),
        "source_no",
        "slot",
        (wide % F.col("blocks").cast("decimal(19,0)")).cast("long").alias("block"),
    )


def stream_positions(sized: DataFrame, sources: list[dict]) -> DataFrame:
    """Adds source_no, source_size, target and start: where a row's words begin in its source's stream.

    sized: doc_id, source, size, tie (a hash of the text).
    """
    spark = sized.sparkSession
    named = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(s["source"]).cast("string").alias("_source"), F.lit(s["source_no"]).cast("long").alias("source_no")) for s in sources])))
    known = F.broadcast(named.join(_source_rows(spark, sources), "source_no"))  # as many rows as sources
    buckets = max(1, sized.count() // BUCKET_ROWS)
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
    totals = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source_no", "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_run", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .join(offsets, ["source_no", "bucket"])
        .withColumn("start", F.col("_offset") + F.col("_run"))
        .drop("_run", "_offset", "bucket")
    )


def block_segments(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source_no, block, start, first, words): the words of each row that lie in each block."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    each = placed.where("size > 0").select("source_no", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)).alias("block"))
    low = F.greatest("start", F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return each.select("source_no", "block", "start", (low - F.col("start")).alias("first"), (high - low).alias("words"))


def mix_plan(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, weights=WEIGHTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, segments, slots): the placed rows, what each holds of each block, and the output slots."""
    body = whole_text()
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(body).alias("size"), F.xxhash64("text").alias("tie"))
    sized = staged(sized, "sizes")  # a few numbers a row; the texts are read once
    sources = plan_sources(sized, block_words, weights)
    if not sources:
        sources = [{"source_no": 0, "source": None, "source_size": 0, "target": 0.0, "blocks": 0, "slots": 0}]
    placed = stream_positions(sized, sources)
    return placed, block_segments(placed, block_words), slot_rows(docs.sparkSession, sources, shards)


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, weights=WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken and start, source_no of every row.

    taken sums the words of the row over all slots that read one of its blocks.
    """
    placed, segments, slots = mix_plan(docs, block_words, shards, weights)
    taken = segments.join(slots.hint("shuffle_merge"), ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum("words").alias("taken"))
    empty = F.col("size") == 0
    key = placed.withColumn("_key", F.when(~empty, F.col("start")))
    out = key.join(taken.withColumnRenamed("start", "_key"), ["source_no", "_key"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source_no", "start", "tie")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, weights=WEIGHTS) -> DataFrame:
    """The mix as documents: a row for every round in which words of a document are taken.

    A round that takes all of a document's words has its text as it is; one that takes a part has the words of
    the taken blocks, parted by spaces, and n_chars (where there is such a column) of that text. All other columns are
    as they were. Rows that are equal in doc_id, text and source are told apart by number only. Documents
    without words are not taken.
    """
    placed, segments, slots = mix_plan(docs, block_words, shards, weights)
    uses = segments.join(slots.hint("shuffle_merge"), ["source_no", "block"]).groupBy("source_no", "start", "first", "words").agg(F.count("*").cast("int").alias("uses"))
    parts = uses.groupBy("source_no", "start").agg(F.array_sort(F.collect_list(F.struct("first", "words", "uses"))).alias("parts"))
    taken = placed.where("size > 0").join(parts, ["source_no", "start"])
    rounds = F.array(*[F.lit(r) for r in range(1, MOST_ROUNDS + 1)])
    of_round = F.transform(rounds, lambda r: F.filter("parts", lambda p: p["uses"] >= r))
    outputs = F.filter(of_round, lambda o: F.size(o) > 0)
    whole = lambda o: F.aggregate(o, F.lit(0).cast("long"), lambda a, p: a + p["words"]) == F.col("size")
    # A whole text needs no list of its parts.
    short = F.transform(outputs, lambda o: F.when(whole(o), F.array().cast("array<struct<first:bigint,words:bigint>>")).otherwise(F.transform(o, lambda p: F.struct(p["first"].alias("first"), p["words"].alias("words")))))
    listed = taken.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_t"), F.col("source").alias("_s"), short.alias("_out"))
    listed = listed.groupBy("_id", "_t", "_s").agg(F.flatten(F.collect_list("_out")).alias("_out"))
    keyed = docs.withColumns({"_doc": F.col("doc_id"), "_text": F.xxhash64("text"), "_source": F.col("source").cast("string")})
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t")) & F.col("_source").eqNullSafe(F.col("_s"))
    found = keyed.join(listed.hint("shuffle_merge"), same).dropDuplicates(["_doc", "_text", "_source"])
    each = found.select(*[found[f"`{c}`"] for c in docs.columns], F.explode("_out").alias("_o"))
    cut = let(F.filter(F.split(F.col("text"), BREAKS), lambda w: w != ""), lambda w: F.array_join(F.flatten(F.transform("_o", lambda p: F.slice(w, p["first"].cast("int") + 1, p["words"].cast("int")))), " "))
    partial = F.size("_o") > 0
    made = each.withColumn("text", F.when(partial, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(partial, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return made.select(*[made[f"`{c}`"] for c in docs.columns])
