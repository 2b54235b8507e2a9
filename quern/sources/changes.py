"""A store that is changed by adding to it: generations of change folders, read as one.

A generation is a folder of items, one of chunks, and one of the ids that it replaces or removes. A row is
present when no later generation names its item. A change therefore writes the changed rows and nothing
else. ``settle`` merges neighbouring generations of about one size, so their number grows with the
logarithm of the changes and a row is rewritten about once per size; ``gen=2-5`` stands for the generations
2 to 5 and takes their place.

Reading does not shuffle the rows of the store. The ids that later generations name become bit maps of 64
neighbouring ids, which go to every task; where they are too many, the ids are cut into ranges, and each
range reads its own rows, which lie sorted by id, with its own bit maps.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.sizes import SMALL_ROWS
from quern.sources.store import load, save_chunks, save_items

GEN = "gen"
PARTS = ("items", "chunks", "gone")
KEYS = {"items": "id", "chunks": "item_id"}
#: So many neighbouring generations of about one size become one; a size is so many times the one below it.
FANOUT = 4
#: Generations up to here count as one size.
SMALLEST_BYTES = 1 << 20
#: Bit maps that are sent to the tasks at once.
SENT_WORDS = SMALL_ROWS

Span = tuple[int, int]


def _folder(path: str, part: str, span: Span) -> str:
    return f"{path}/{part}/{GEN}={span[0]}" + (f"-{span[1]}" if span[1] > span[0] else "")


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def create(items: DataFrame, chunks: DataFrame, path: str) -> None:
    """A new store whose base are the given rows."""
    for rows, save, part in ((items, save_items, "items"), (chunks, save_chunks, "chunks")):
        if rows.isEmpty():  # cut into folders, no row would leave no schema
            rows.write.parquet(_folder(path, part, (0, 0)))
        else:
            save(rows, _folder(path, part, (0, 0)))
    items.select(F.col("id").alias("item_id")).limit(0).write.parquet(_folder(path, "gone", (0, 0)))


def folder_spans(spark: SparkSession, path: str) -> list[Span]:
    """The first and last number of the finished generations in a folder, without those that a merged one replaces."""
    files, top = _files(spark, path)
    found = []
    for status in files.listStatus(top) if files.exists(top) else []:
        folder = status.getPath()
        if folder.getName().startswith(f"{GEN}=") and files.exists(_files(spark, f"{folder}/_SUCCESS")[1]):
            first, _, last = folder.getName().split("=")[1].partition("-")
            found.append((int(first), int(last or first)))
    within = lambda a, b: a != b and b[0] <= a[0] and a[1] <= b[1]
    return sorted(s for s in found if not any(within(s, other) for other in found))


def spans(spark: SparkSession, path: str) -> list[Span]:
    """The generations that hold the store, oldest first; a folder whose ids are not all written is not counted."""
    return folder_spans(spark, f"{path}/gone")


def generations(spark: SparkSession, path: str) -> list[int]:
    """The last number of each generation."""
    return [last for _, last in spans(spark, path)]


def _gone(spark: SparkSession, path: str, named: list[Span]) -> DataFrame:
    """(item_id, gen): the ids that each of the generations names."""
    frames = [load(spark, _folder(path, "gone", s)).withColumn(GEN, F.lit(s[1])) for s in named]
    return reduce(DataFrame.union, frames)


def _bit_maps(ids: DataFrame) -> DataFrame:
    """(_word, _bits): a row for each 64 neighbouring ids."""
    bit = F.expr("shiftleft(1L, int(item_id & 63))")
    return ids.groupBy(F.shiftright("item_id", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def _ranges(words: DataFrame) -> list[tuple[int | None, int | None]]:
    """Ranges of words, each with few enough of them to be sent out."""
    count = words.count()
    if count <= SENT_WORDS:
        return [(None, None)]
    parts = -(-2 * count // SENT_WORDS)
    shares = ", ".join(str(k / parts) for k in range(1, parts))
    cuts = sorted(set(words.agg(F.expr(f"percentile_approx(_word, array({shares}), {100 * parts})")).first()[0]))
    return list(zip([None, *cuts], [*cuts, None]))


def _present(rows: DataFrame, key: str, words: DataFrame, ranges) -> DataFrame:
    """The rows whose id is not in the bit maps, range by range; no row is shuffled."""
    parts = []
    bit = F.expr(f"shiftleft(1L, int({key} & 63))")
    for low, high in ranges:
        own, sent = rows, words
        if low is not None:
            own, sent = own.where(F.col(key) >= low * 64), sent.where(F.col("_word") >= low)
        if high is not None:
            own, sent = own.where(F.col(key) < high * 64), sent.where(F.col("_word") < high)
        met = own.join(F.broadcast(sent), F.shiftright(key, 6) == F.col("_word"), "left")  # at most SENT_WORDS rows
        parts.append(met.where(F.coalesce(F.col("_bits").bitwiseAND(bit), F.lit(0)) == 0).select(*rows.columns))
    return reduce(DataFrame.unionByName, parts)


def _read(spark: SparkSession, path: str, held: list[Span]) -> tuple[DataFrame, DataFrame]:
    """The items and chunks of neighbouring generations that none of the later ones among them replaces."""
    later = _gone(spark, path, held)
    ranges = _ranges(_bit_maps(later)) if len(held) > 1 else []
    out = []
    for part, key in KEYS.items():
        frames = []
        for span in held:
            rows = load(spark, _folder(path, part, span))
            words = _bit_maps(later.where(F.col(GEN) > span[1]))
            frames.append(rows if span == held[-1] else _present(rows, key, words, ranges))
        out.append(reduce(DataFrame.unionByName, frames))
    return out[0], out[1]


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The present items and chunks."""
    return _read(spark, path, spans(spark, path))


def _write(path: str, span: Span, items: DataFrame, chunks: DataFrame, gone: DataFrame) -> None:
    """A generation's folders; its ids are written last, and before that readers do not see it."""
    items.write.mode("overwrite").parquet(_folder(path, "items", span))
    chunks.sortWithinPartitions("item_id", "chunk_ix").write.mode("overwrite").parquet(_folder(path, "chunks", span))
    gone.select("item_id").distinct().write.mode("overwrite").parquet(_folder(path, "gone", span))


def change(spark: SparkSession, path: str, items: DataFrame, chunks: DataFrame, gone: DataFrame) -> int:
    """Add a generation: changed and new items, their chunks, and (item_id) of all it replaces or removes.

    A change that runs again after it broke off takes the same number.
    """
    number = generations(spark, path)[-1] + 1
    _write(path, (number, number), items, chunks, gone)
    return number


def merge(spark: SparkSession, path: str, first: int, last: int) -> None:
    """One generation in place of the neighbouring ones from the first to the last number."""
    held = [s for s in spans(spark, path) if first <= s[0] and s[1] <= last]
    if len(held) < 2:
        return
    items, chunks = _read(spark, path, held)
    gone = _gone(spark, path, held)
    by_id = chunks.repartitionByRange("item_id")  # ranges of ids then lie in few files
    _write(path, (held[0][0], held[-1][1]), items, by_id, gone.limit(0) if held[0][0] == 0 else gone)


def sizes_of(spark: SparkSession, generations: list[list[str]]) -> list[int]:
    """The size of each generation, given by its folders, in powers of FANOUT."""
    out = []
    for folders in generations:
        total = 0
        for name in folders:
            files, folder = _files(spark, name)
            total += files.getContentSummary(folder).getLength()
        out.append(max(0, int(log(max(total, 1) / SMALLEST_BYTES, FANOUT)) + 1) if total > SMALLEST_BYTES else 0)
    return out


def due(sizes: list[int]) -> bool:
    """Whether the latest FANOUT generations are of about one size."""
    return len(sizes) >= FANOUT and sizes[-FANOUT] <= max(sizes[1 - FANOUT :])


def settle(spark: SparkSession, path: str) -> int:
    """Merge the latest generations as long as FANOUT of them are of about one size; the number that are left.

    Generations that were merged stay where they are, for readers that have them open, until ``sweep``.
    """
    while True:
        held = spans(spark, path)
        if not due(sizes_of(spark, [[_folder(path, part, s) for part in PARTS] for s in held])):
            return len(held)
        merge(spark, path, held[-FANOUT][0], held[-1][1])


def sweep(spark: SparkSession, path: str) -> None:
    """Remove the folders that merged generations replaced; nobody may be reading them."""
    held = {_folder(path, "gone", s).rsplit("/", 1)[1] for s in spans(spark, path)}
    for part in reversed(PARTS):
        files, folder = _files(spark, f"{path}/{part}")
        for status in files.listStatus(folder):
            if status.getPath().getName().startswith(f"{GEN}=") and status.getPath().getName() not in held:
                files.delete(status.getPath(), True)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The present rows as a new store with one generation."""
    create(*read(spark, path), target)
