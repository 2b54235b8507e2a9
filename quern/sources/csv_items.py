"""CSV inputs: one-column item files whose row position is the identity, and ragged entry files."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import normalize, strip
from quern.operators.ordering import dense_index, dense_index_by
from quern.sources.quoted_csv import line_records, quoted_records


def read_item_files(
    spark: SparkSession,
    paths: Mapping[str, str],
    has_header: bool = False,
    dedupe: bool = False,
    multiline: bool = True,
) -> DataFrame:
    """(kind, row_ix, body) from the first column of each kind's file or folder of files.

    Rows are numbered per kind after blank rows are dropped, in file order. Files of a folder follow
    each other by name; a shorter name comes first, so numbered part files keep their order. Cells may
    hold line feeds, and large files are read by many tasks all the same, twice; ``multiline=False`` spares
    the second reading where no cell holds one. A file that ends inside a quoted cell ends with that cell.
    """
    frames = []
    for kind, path in paths.items():
        if multiline:
            records = quoted_records(spark, path)
            if has_header:
                records = records.filter((F.col("rec") > 0) | (F.col("pos") > 0))
            file, block, at = F.col("file"), F.col("block"), F.struct("rec", "pos")
            body = F.get("cells", F.lit(0))
        else:
            records = spark.read.schema("body string").option("header", has_header).option("escape", '"').csv(path)
            file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
            # Rises with the reading order inside a file block, which is never split further.
            at = F.struct(F.monotonically_increasing_id().alias("rec"), F.lit(0).alias("pos"))
            body = F.col("body")
        columns = [strip(body).alias("body"), F.length(file).alias("_len"), file.alias("_file"), block.alias("_block"), at.alias("_at")]
        frames.append(records.select(F.lit(kind).alias("kind"), *columns))
    rows = reduce(DataFrame.unionByName, frames).filter(F.length("body") > 0)
    placed = dense_index(rows, ["kind"], ["_len", "_file", "_block"], ["_at"], "row_ix")
    placed = placed.select("kind", "row_ix", "body")
    return first_by_text(placed) if dedupe else placed


def first_by_text(rows: DataFrame) -> DataFrame:
    """Keep the first row of each normalised text within a kind, and close the gaps in ``row_ix``.

    Copies meet only as (kind, digest, position); a text that fills a third of the rows combines to
    one row per partition before the shuffle.
    """
    digest = F.sha2(normalize(F.col("body")), 256).alias("_digest")
    first = rows.groupBy("kind", digest).agg(F.min("row_ix").alias("row_ix")).select("kind", "row_ix")
    # Numbered without the texts, which then move once.
    places = dense_index_by(first, ["kind"], "row_ix", "_ix")
    return rows.join(places, ["kind", "row_ix"]).select("kind", F.col("_ix").alias("row_ix"), "body")


def read_ragged(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """(cells array<string>, seq, closed) per non-empty record of files whose records differ in length.

    Spark's CSV reader needs one fixed width; here every record keeps all of its cells. Large files are
    read by many tasks; ``multiline=False`` spares the second reading where no cell holds a line feed.
    ``seq`` rises in file order. A record whose last cell is never closed has ``closed`` false.
    """
    records = quoted_records(spark, path) if multiline else line_records(spark, path)
    seq = F.struct(F.length("file").alias("len"), "file", "block", "rec", "pos")
    return records.filter(F.size("cells") > 0).select("cells", seq.alias("seq"), "closed")


def ragged_entries(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (kind, name, body, metadata, seq) and rejects with their reason.

    Cells after the third alternate metadata key and value; a repeated key keeps its last value. A record
    that is too short, has a key without a value, or ends inside a quoted cell is a reject.
    """
    cells = F.col("cells")
    reason = F.when(F.size(cells) < 3, F.lit("too few cells")).when(F.size(cells) % 2 == 0, F.lit("key without value"))
    if "closed" in records.columns:
        reason = F.when(~F.col("closed"), F.lit("unclosed quote")).otherwise(reason)
    records = records.withColumn("reason", reason)
    fits = F.col("reason").isNull()
    tail = F.slice(cells, 4, F.greatest(F.size(cells) - 3, F.lit(0)))
    keys = F.filter(tail, lambda x, i: i % 2 == 0)
    values = F.filter(tail, lambda x, i: i % 2 == 1)
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    shaped = records.filter(fits).select(
        cells[0].alias("kind"), cells[1].alias("name"), cells[2].alias("body"), keys.alias("_k"), pairs.alias("_p"), "seq"
    )
    last = F.filter(
        F.col("_p"),
        lambda pair, i: ~F.array_contains(F.slice(F.col("_k"), i + 2, F.size("_k")), pair["k"]),
    )
    entries = shaped.select("kind", "name", "body", F.map_from_entries(last).alias("metadata"), "seq")
    return entries, records.filter(~fits)
