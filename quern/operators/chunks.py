"""Items to chunks, and chunks to vectors through a caller's model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import CHUNK_CHARS, pieces
from quern.functions.vectors import hash_embedding
from quern.operators.sizes import sent_if_small
from quern.session import staged


# Adds ``embedding`` to chunks.
Embed = Callable[[DataFrame], DataFrame]


def chunk_items(items: DataFrame, size: int = CHUNK_CHARS, keep_empty: bool = False, with_kind: bool = False) -> DataFrame:
    """(item_id, chunk_ix, chunk_text) from items' bodies, without a shuffle.

    ``with_kind`` carries the item's kind and dataset along, which spares searches a join.
    """
    cut = F.posexplode(pieces(F.col("body"), size, keep_empty)).alias("chunk_ix", "chunk_text")
    own = [F.col("kind"), F.element_at("metadata", F.lit("dataset")).alias("dataset")] if with_kind else []
    return items.select(F.col("id").alias("item_id"), *own, cut)


def embed_hashed(df: DataFrame, text: str = "chunk_text", out: str = "embedding") -> DataFrame:
    return df.withColumn(out, hash_embedding(F.col(text)))


def embed_with(
    df: DataFrame,
    load_model: Callable[[], Callable[[list[str]], list[list[float]]]],
    text: str = "chunk_text",
    out: str = "embedding",
) -> DataFrame:
    """Embed a text column with a caller's model, loaded once per task and fed batch by batch.

    An empty vector fails the job, as a store must not hold chunks that search cannot see.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            found = model(texts.tolist())
            if len(found) != len(texts) or any(len(v) == 0 for v in found):
                raise ValueError("the model gave no vector for a text")
            yield pd.Series(list(found), dtype=object)

    return df.withColumn(out, vectors(F.col(text)))


def embed_known(df: DataFrame, embed: Embed, path: str, model: str, text: str = "chunk_text") -> DataFrame:
    """``embed`` for texts that no earlier call has seen: vectors are kept by the model's name and the text's digest.

    ``path`` is a folder that grows by the vectors of each call's new texts, one row per text and model, so
    equal and unchanged texts reach a model once. Digests of all texts are compared; only texts without a
    vector move, once each. A call that runs again finds what it has written. Keeps every column of ``df``;
    a null text has no vector.
    """
    spark = df.sparkSession
    kept = f"{path}/model={hashlib.sha256(model.encode()).hexdigest()[:16]}"
    digest = F.sha2(F.col(text), 256)
    held = _vectors(spark, kept)
    keys = df.select(digest.alias("_digest")).where("_digest is not null").distinct()
    new = staged(keys if held is None else keys.join(held, "_digest", "left_anti"), "new-texts")
    if not new.isEmpty():
        texts = df.select(digest.alias("_digest"), F.col(text).alias("chunk_text")).join(sent_if_small(new), "_digest", "left_semi")
        first = texts.groupBy("_digest").agg(F.first("chunk_text").alias("chunk_text"))
        embed(first).select("_digest", "embedding").write.mode("append").parquet(kept)
        held = _vectors(spark, kept)
    if held is None:
        return df.withColumn("embedding", F.lit(None).cast("array<float>"))
    own = [c for c in df.columns if c != "embedding"]
    vectors = held.groupBy("_digest").agg(F.first("embedding").alias("embedding"))  # two calls side by side may both have written one
    return df.select(*own, digest.alias("_digest")).join(vectors, "_digest", "left").select(*own, "embedding")


def _vectors(spark, path: str) -> DataFrame | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if files.exists(hadoop.suffix("/_SUCCESS")) else None


# Fixed value: the constant reply of the stand-in model.
STAND_IN_REPLY = "SELECT name FROM users WHERE country = 'USA'"


def stand_in_model() -> Callable[[list[str]], list[str]]:
    return lambda prompts: [STAND_IN_REPLY] * len(prompts)


def complete_with(
    prompts: DataFrame, load_model: Callable[[], Callable[[list[str]], list[str]]] = stand_in_model, out: str = "reply"
) -> DataFrame:
    """Prompt text to reply text through a caller's model; keeps every column of ``prompts``."""
    schema = prompts.withColumn(out, F.lit("")).schema

    def replies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for frame in frames:
            yield frame.assign(**{out: [str(r).strip() for r in model(frame["prompt"].tolist())]})

    return prompts.mapInPandas(replies, schema)


#: Whole prompts that a model is given at once: so many, and so many characters of them.
AT_ONCE = 64
AT_ONCE_CHARS = 8 << 20


def reads_parts(load_model: Callable) -> Callable:
    """Marks a model that takes one prompt as an iterator of its parts, and so may read texts of any length."""
    load_model.reads_parts = True
    return load_model


def complete_parts(parts: DataFrame, load_model: Callable[[], Callable] = stand_in_model, out: str = "reply") -> DataFrame:
    """(query_id, reply) for prompts given as parts: query_id, segment (their order), text.

    A query's parts reach one task in order. A model that reads parts gets them one by one as they come;
    any other gets whole prompts, a few at once.
    """
    kind = parts.schema["query_id"].dataType.simpleString()
    by_part = getattr(load_model, "reads_parts", False)

    def replies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()

        def answered(ids: list, texts: list[str]) -> pd.DataFrame:
            return pd.DataFrame({"query_id": ids, out: [str(r).strip() for r in model(texts)]})

        rows = (row for frame in frames for row in zip(frame["query_id"], frame["text"]))
        ids, prompts = [], []
        for query_id, own in groupby(rows, key=lambda row: row[0]):
            texts = (text for _, text in own)
            if by_part:
                yield pd.DataFrame({"query_id": [query_id], out: [str(model(texts)).strip()]})
                continue
            ids.append(query_id)
            prompts.append("".join(texts))
            if len(ids) == AT_ONCE or sum(map(len, prompts)) > AT_ONCE_CHARS:
                yield answered(ids, prompts)
                ids, prompts = [], []
        if ids:
            yield answered(ids, prompts)

    dealt = parts.select("query_id", "segment", "text").repartition("query_id").sortWithinPartitions("query_id", "segment")
    return dealt.mapInPandas(replies, f"query_id {kind}, {out} string")
