"""Sharding by sampled splitters: near-equal bytes per shard, equal texts side by side.

Records are ordered by (hash of the text, hash of doc_id). Keys are sampled with a chance in proportion
to their size; weighted quantiles of the sample cut the order into ranges, and each range whose exact
row count or byte count is too high is cut again from a sample of its own. With exact totals per range,
a running sum inside each range gives every record its byte position, and the middle of it its shard: each
boundary lies within half a record of its even place. So a window holds one range, never a shard, and a group of copies that is larger than a range is cut by
doc_id like any other run of keys. A group below GROUP_SHARE of a shard stays whole.

Null text: 0 bytes of text; null texts count as equal. Null doc_id and repeated rows: placed like any
other record, each row once. Empty table: empty result. The general operator keeps all columns of the
input; a column named as an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.columns import replace_columns, whole_text
from quern.session import staged

SHARDS = 40
ROW_BYTES = 16
#: Ranges per shard before any is subdivided, and sampled keys per range.
RANGES_PER_SHARD = 8
SAMPLES = 48
#: A range with more rows, or with more than twice its share of the bytes, is subdivided.
RANGE_ROWS = 50_000
#: Groups of equal texts up to this share of a shard are kept in one shard.
GROUP_SHARE = 0.01


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds size, text_crc32 and the sort keys _key and _sub."""
    body = whole_text(text)
    docs = replace_columns(docs, "size", "text_crc32", "_key", "_sub")
    return docs.withColumns({
        "size": (F.octet_length(body) + ROW_BYTES).cast("long"),
        "text_crc32": F.crc32(body.cast("binary")),
        "_key": F.xxhash64(text),
        "_sub": F.xxhash64("doc_id"),
    })


def _chance(salt: int) -> Column:
    """A number in [0, 1) that only the record's keys decide."""
    return F.pmod(F.xxhash64("_key", "_sub", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)


def _with_range(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Adds _range: how many bounds are not above the record's keys, found by halving."""
    one = rows.sparkSession.createDataFrame([([{"k": k, "s": s} for k, s in bounds],)], "b array<struct<k:long,s:long>>")
    steps = [1 << i for i in range(max(1, len(bounds)).bit_length() - 1, -1, -1)]

    def halve(at: Column, step: Column) -> Column:
        x = F.get("_bounds", at + step - 1)
        below = (x["k"] < F.col("_key")) | ((x["k"] == F.col("_key")) & (x["s"] <= F.col("_sub")))
        return F.when(F.coalesce(below, F.lit(False)), at + step).otherwise(at)

    held = rows.withColumn("_bounds", one.scalar())
    return held.withColumn("_range", F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), halve)).drop("_bounds")


def _quantiles(sample: list, parts: int) -> list[tuple[int, int]]:
    """Bounds that cut the weighted sample into equal parts; a key that one bound names is not cut."""
    sample = sorted(sample)
    total, seen, found = sum(w for _, _, w in sample), 0.0, []
    for k, s, w in sample:
        while len(found) < parts - 1 and seen + w > total * (len(found) + 1) / parts:
            found.append((k, s))
        seen += w
    often = {}
    for k, _ in found:
        often[k] = often.get(k, 0) + 1
    return sorted({(k, s) if often[k] > 1 else (k, -(1 << 63)) for k, s in found})


def _range_totals(rows: DataFrame, bounds) -> dict[int, tuple[int, int]]:
    found = _with_range(rows, bounds).groupBy("_range").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    return {r["_range"]: (r["n"], int(r["b"])) for r in found}


def splitters(rows: DataFrame, shards: int = SHARDS) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """The bounds of the ranges and the exact (rows, bytes) of each.

    The driver holds SAMPLES keys per range of the first cut and per new range of a later one, and the
    bounds themselves: at most a few per RANGE_ROWS records.
    """
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    if not total["n"]:
        return [], {}
    parts = shards * RANGES_PER_SHARD
    wanted = parts * SAMPLES
    share = F.least(F.lit(1.0), F.col("size") * (wanted / float(total["b"])))
    drawn = rows.where(_chance(0) < share).select("_key", "_sub", (F.col("size") / share).alias("w")).collect()
    bounds = _quantiles([tuple(r) for r in drawn], parts)
    most_bytes = 2 * total["b"] / parts
    for salt in range(1, 9):
        totals = _range_totals(rows, bounds)
        over = {r: max(-(-n // RANGE_ROWS), int(2 * b / most_bytes) + 1) for r, (n, b) in totals.items() if n > 1 and (n > RANGE_ROWS or b > most_bytes)}
        if not over:
            break
        rate = F.create_map(*[F.lit(x) for r, cuts in over.items() for x in (r, cuts * SAMPLES / float(totals[r][0]))])
        drawn = _with_range(rows, bounds).where(F.col("_range").isin(list(over))).where(_chance(salt) < rate[F.col("_range")]).select("_range", "_key", "_sub", "size").collect()
        more = set()
        for r, cuts in over.items():
            # Equal weights cut by rows, sizes by bytes; the wider fault decides.
            by_rows = totals[r][0] > RANGE_ROWS
            more.update(_quantiles([(x["_key"], x["_sub"], 1 if by_rows else x["size"]) for x in drawn if x["_range"] == r], cuts))
        if more <= set(bounds):
            break
        bounds = sorted(set(bounds) | more)
    return bounds, _range_totals(rows, bounds)


def place(rows: DataFrame, bounds, totals: dict[int, tuple[int, int]], shards: int = SHARDS) -> DataFrame:
    """Adds shard and _row, the record's place in the whole order. rows: as keyed() makes them."""
    offsets, row, at = [], 0, 0
    for r in sorted(totals):
        offsets.append((r, row, at))
        row, at = row + totals[r][0], at + totals[r][1]
    before = rows.sparkSession.createDataFrame(offsets, "_range int, _rows long, _bytes long")
    inside = Window.partitionBy("_range").orderBy("_key", "_sub")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("_range", "_key")
    share = at / shards if at else 1.0
    placed = (
        _with_range(rows, bounds)
        .withColumns({"_run": F.coalesce(F.sum("size").over(earlier), F.lit(0)), "_no": F.row_number().over(inside)})
        .withColumns({"_group": F.sum("size").over(group), "_first": F.min("_run").over(group)})
        .join(before, "_range")
    )
    # By the middle of the record or of its group, so that a boundary errs by half of it at most, to either side.
    whole_group = F.col("_first") + F.col("_group") / 2
    position = F.col("_bytes") + F.when(F.col("_group") <= GROUP_SHARE * share, whole_group).otherwise(F.col("_run") + F.col("size") / 2)
    return placed.withColumns({
        "shard": F.least(F.floor(position / share), F.lit(shards - 1)).cast("int"),
        "_row": F.col("_rows") + F.col("_no") - 1,
    }).drop("_range", "_run", "_no", "_group", "_first", "_rows", "_bytes")


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds slot: the record's number within its shard, from 0 without gaps."""
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_shard_row"))
    return _numbered(placed, firsts)


def _numbered(placed: DataFrame, firsts: DataFrame) -> DataFrame:
    kept = [c for c in placed.columns if c not in ("shard", "_row", "_key", "_sub")]
    slot = (F.col("_row") - F.col("_shard_row")).alias("slot")
    return placed.join(F.broadcast(firsts), "shard").select(*[placed[f"`{c}`"] for c in kept], "shard", slot)


def shard_digests(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every record; texts are read once and never shuffled."""
    digest = staged(keyed(docs.select("doc_id", "text")).drop("text"), "digests")
    bounds, totals = splitters(digest, shards)
    return with_slots(staged(place(digest, bounds, totals, shards), "placed"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All columns of the input with size, text_crc32, shard and slot."""
    docs = replace_columns(docs, "shard", "slot")
    rows = keyed(docs)
    digest = staged(rows.select("_key", "_sub", "size"), "digests")
    bounds, totals = splitters(digest, shards)
    firsts = place(digest, bounds, totals, shards).groupBy("shard").agg(F.min("_row").alias("_shard_row"))
    firsts = docs.sparkSession.createDataFrame(firsts.collect(), firsts.schema)  # a row per shard
    return _numbered(place(rows, bounds, totals, shards), firsts)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The records as Parquet, a folder per shard, each shard in files of at most RANGE_ROWS records."""
    out = shard_documents(docs, shards).withColumn("_part", F.floor(F.col("slot") / RANGE_ROWS))
    out.repartition("shard", "_part").sortWithinPartitions("shard", "slot").drop("_part").write.partitionBy("shard").parquet(path)
