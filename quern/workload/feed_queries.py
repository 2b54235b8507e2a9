"""Feeds made from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import to_int
from quern.operators.ordering import first_per_key
from quern.plans import feed, newest
from quern.session import scratch_path
from quern.sources.payload import coerce_rows, read_landing
from quern.streaming.feed_stream import run_feed
from quern.workload import tables as t
from quern.workload.registry import query

KEYS, SEQ = ["user_id"], ["ts", "event_id"]
INGESTED = "2024-06-01 00:00:00"


def _k(props):
    return F.get_json_object(props, "$.k")


@query(
    "payload_rows",
    """WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events)
    SELECT event_id, CAST(event_id AS VARCHAR) AS event, event_type || ', "' || k || '"' AS note, CAST(k AS INTEGER) AS k FROM e WHERE event_type = 'error'
    UNION ALL SELECT event_id, CAST(event_id AS VARCHAR), event_type, CAST(k AS INTEGER) FROM e WHERE event_type IN ('click', 'view')
    UNION ALL SELECT event_id, NULL, NULL, NULL FROM e WHERE event_type = 'view'
    UNION ALL SELECT event_id, CAST(event_id AS VARCHAR), '{broken', NULL FROM e WHERE event_type = 'signup'""",
)
def payload_rows(spark, sf):
    """Events as JSON objects, JSON lists, CSV texts, malformed JSON, and no payload at all."""
    events = t.table(spark, sf, "events")
    key, kind, k = F.col("event_id").cast("string"), F.col("event_type"), _k(F.col("props"))
    record = F.to_json(F.struct(key.alias("EVENT"), kind.alias("NOTE"), k.alias("K")))
    as_csv = F.concat(F.lit("EVENT,NOTE,K\r\n"), key, F.lit(',"'), kind, F.lit(', ""'), k, F.lit('""",'), k, F.lit("\r\n"))
    broken = F.concat(F.lit("{broken,EVENT,K\n{broken,"), key, F.lit(",x\n"))
    payload = (
        F.when(kind == "click", F.concat(F.lit("  "), record))
        .when(kind == "view", F.concat(F.lit("["), record, F.lit(',{"K":"none"}]')))
        .when(kind == "error", as_csv)
        .when(kind == "signup", broken)
    )
    rows = coerce_rows(events.select("event_id", payload.alias("payload")), "payload")
    field = lambda name: F.element_at("record", F.lit(name))
    note = F.coalesce(field("NOTE"), field("{broken"))
    return rows.select("event_id", field("EVENT").alias("event"), note.alias("note"), to_int(field("K")).alias("k"))


def _typed(records):
    return records.select(*KEYS, *SEQ, "event_type", to_int(_k(F.col("props"))).alias("k"))


_LATEST = "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
_SQL_TYPED = f"SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events {_LATEST}"
_SQL_RAW = f"""SELECT user_id, event_id, event_type AS type_in_json, json_extract_string(props, '$.k') AS k_in_json,
  '2024-06-01 00:00:00' AS ingested_at FROM events {_LATEST}"""


def _landed(spark, sf):
    """The events as JSON files in a landing folder, and the folder of the feed's tables."""
    path = scratch_path(spark, "feed")
    t.table(spark, sf, "events").write.json(f"{path}/landing")
    return f"{path}/landing", f"{path}/tables"


_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def _ingested(spark, sf):
    landing, path = _landed(spark, sf)
    records = read_landing(spark, landing, _SCHEMA)
    feed.ingest_batch(records, 0, _typed, path, KEYS, SEQ, t.moment(INGESTED))
    return path


@query("feed_upsert", _SQL_TYPED)
def feed_upsert(spark, sf):
    return feed.read_feed(spark, _ingested(spark, sf), "typed", KEYS, SEQ).select("user_id", "event_id", "event_type", "k")


@query("feed_raw", _SQL_RAW)
def feed_raw(spark, sf):
    rows = feed.read_feed(spark, _ingested(spark, sf), "raw", KEYS, SEQ)
    payload = F.col("payload")
    return rows.select(
        "user_id",
        "event_id",
        F.get_json_object(payload, "$.event_type").alias("type_in_json"),
        _k(F.get_json_object(payload, "$.props")).alias("k_in_json"),
        F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"),
    )


@query("stream_feed", _SQL_TYPED)
def stream_feed(spark, sf):
    """The same tables filled by a stream over the landing folder, run twice; the second finds nothing new."""
    landing, path = _landed(spark, sf)
    for _ in range(2):
        run_feed(spark, landing, _SCHEMA, path, _typed, KEYS, SEQ, t.moment(INGESTED), fmt="json")
    return feed.read_feed(spark, path, "typed", KEYS, SEQ).select("user_id", "event_id", "event_type", "k")


@query("stream_feed_compacted", _SQL_TYPED)
def stream_feed_compacted(spark, sf):
    """The earlier events land and run, the tables are compacted, the later ones land and run there."""
    path = scratch_path(spark, "feed")
    events = t.table(spark, sf, "events")
    middle = events.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("ts")).first()["ts"]
    late = F.col("ts") >= F.lit(middle).cast("timestamp_ntz")
    for step, tables in ((~late, "tables"), (late, "compacted")):
        events.filter(step).write.mode("append").json(f"{path}/landing")
        run_feed(spark, f"{path}/landing", _SCHEMA, f"{path}/{tables}", _typed, KEYS, SEQ, t.moment(INGESTED), fmt="json")
        if tables == "tables":
            feed.compact_feed(spark, f"{path}/tables", f"{path}/compacted", KEYS, SEQ)
    return feed.read_feed(spark, f"{path}/compacted", "typed", KEYS, SEQ).select("user_id", "event_id", "event_type", "k")


@query("feed_totals", "SELECT 0 AS batch_id, count(*) AS n FROM events")
def feed_totals(spark, sf):
    return feed.batch_totals(spark, _ingested(spark, sf))


@query(
    "latest_per_entity",
    f"SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type, value, props FROM events {_LATEST}",
)
def latest_per_entity(spark, sf):
    order = [F.col(c) for c in SEQ]
    latest = first_per_key(t.table(spark, sf, "events"), KEYS, order, latest=True)
    return latest.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


BATCHES = 5


@query(
    "newest_kept",
    f"""SELECT user_id, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % {BATCHES} DESC, ts DESC, event_id DESC) = 1""",
)
def newest_kept(spark, sf):
    """The newest event of every user as it is kept over five batches, merged where they are of one size."""
    path, events = scratch_path(spark, "kept"), t.table(spark, sf, "events")
    for batch in range(BATCHES):
        newest.add_batch(events.filter(F.col("event_id") % BATCHES == batch), batch, path, KEYS, SEQ)
        newest.settle(spark, path, KEYS, SEQ)
    return newest.read_newest(spark, path, KEYS, SEQ).select("user_id", "event_id", "event_type", "value")
