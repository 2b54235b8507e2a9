"""Store changes, CSV sync and audit over items made from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import csv_cell, has_text, row_name, utc_time
from quern.operators import upsert
from quern.operators.chunks import chunk_items, embed_hashed
from quern.operators.ordering import dense_index_by, spread_out
from quern.plans import audit, sync
from quern.plans.commit import commit_entries
from quern.session import durable, scratch_path, staged
from quern.sinks.files import write_audit_csv, write_item_files
from quern.sources import changes
from quern.sources.csv_items import first_by_text, ragged_entries, read_item_files, read_ragged
from quern.sources.quoted_csv import quoted_records
from quern.sources.store import items_of, load, save_items
from quern.workload import tables as t
from quern.workload.registry import query

DATASET = "docs"
NOW = "2024-06-01 00:00:00"


def _now():
    return t.moment(NOW)


# --- positions of documents within their kind, and the two sides of a sync ----------------------


def positions(spark, sf):
    """(kind, row_ix, doc_id, body): documents in id order, numbered per kind."""
    docs = t.table(spark, sf, "documents").select(
        t.kind_of_lang(F.col("lang")).alias("kind"), "doc_id", F.col("text").alias("body")
    )
    return dense_index_by(docs.filter(has_text(F.col("body"))), ["kind"], "doc_id", "row_ix")


def stored_items(spark, sf):
    """An older store: toxic documents are not in it yet, poor ones differ, benchmark texts are left over."""
    labels = t.table(spark, sf, "labels")
    rows = positions(spark, sf).join(labels, "doc_id", "left")
    docs = rows.filter(F.coalesce("toxic", F.lit(0)) == 0).select(
        F.col("doc_id").alias("id"),
        "kind",
        "row_ix",
        F.when(F.col("quality") == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")).alias("body"),
    )
    left_over = t.table(spark, sf, "benchmark").select(
        (F.lit(10_000_000_000) + F.col("item_id")).alias("id"),
        F.lit("key").alias("kind"),
        F.col("item_id").alias("row_ix"),
        F.col("text").alias("body"),
    )
    return docs.unionByName(left_over).select(
        "id",
        "kind",
        row_name(F.col("kind"), F.lit(DATASET), F.col("row_ix")).alias("name"),
        "body",
        F.create_map(F.lit("dataset"), F.lit(DATASET)).alias("metadata"),
        F.lit(1).alias("version"),
        t.moment(t.EPOCH).alias("created_at"),
        t.moment(t.EPOCH).alias("updated_at"),
    )


def sides(spark, sf):
    items = stored_items(spark, sf)
    desired = sync.desired_rows(positions(spark, sf))
    return desired, items, sync.current_rows(items_of(items, t.KINDS, DATASET))


SQL_POSITIONS = f"""positions AS (
  SELECT kind, doc_id, body, row_number() OVER (PARTITION BY kind ORDER BY doc_id) - 1 AS row_ix
  FROM (SELECT {t.SQL_KIND} AS kind, doc_id, text AS body FROM documents) WHERE {t.sql_strip('body')} <> '')"""
SQL_SIDES = f"""{SQL_POSITIONS},
stored AS (
  SELECT p.kind, p.row_ix, CASE WHEN l.quality = 0 THEN p.body || '!' ELSE p.body END AS body
  FROM positions p LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0
  UNION ALL SELECT 'key', item_id, text FROM benchmark),
desired AS (SELECT kind, row_ix, {t.sql_normalize('body')} AS body FROM positions),
now_held AS (SELECT kind, row_ix, {t.sql_normalize('body')} AS body, body AS raw FROM stored),
plan AS (
  SELECT kind, row_ix, d.body AS want, c.raw AS raw,
    CASE WHEN d.body IS NULL THEN 'DELETE' WHEN c.body IS NULL THEN 'CREATE' WHEN d.body <> c.body THEN 'UPDATE' ELSE 'KEEP' END AS action
  FROM desired d FULL JOIN now_held c USING (kind, row_ix))"""
SQL_APPLIED = f"""applied AS (
  SELECT kind, kind || '::{DATASET}::row::' || row_ix AS name, row_ix,
    CASE WHEN action = 'KEEP' THEN raw ELSE want END AS body, CASE WHEN action = 'UPDATE' THEN 2 ELSE 1 END AS version,
    CASE WHEN action = 'KEEP' THEN '{t.EPOCH}' ELSE '{NOW}' END AS updated_at,
    CASE WHEN action = 'CREATE' THEN '{NOW}' ELSE '{t.EPOCH}' END AS created_at,
    CASE WHEN action = 'KEEP' THEN NULL ELSE CAST(row_ix AS VARCHAR) END AS meta_row
  FROM plan WHERE action <> 'DELETE')"""


@query("sync_plan", f"WITH {SQL_SIDES} SELECT kind, row_ix, action FROM plan")
def sync_plan(spark, sf):
    desired, _, current = sides(spark, sf)
    return sync.plan_sync(desired, current)


@query(
    "sync_counts",
    f"""WITH {SQL_SIDES} SELECT '{DATASET}' AS dataset, '2024-06-01T00:00:00Z' AS ts_utc, 'hashed' AS embedding_model, false AS apply, kind,
      count(*) FILTER (action <> 'DELETE') AS desired, count(*) FILTER (action <> 'CREATE') AS current,
      count(*) FILTER (action = 'CREATE') AS creates, count(*) FILTER (action = 'UPDATE') AS updates,
      count(*) FILTER (action = 'DELETE') AS deletes
    FROM plan GROUP BY ROLLUP (kind)""",
)
def sync_counts(spark, sf):
    desired, _, current = sides(spark, sf)
    return sync.sync_record(sync.plan_sync(desired, current), DATASET, utc_time(_now()), "hashed", False)


@query(
    "sync_actions",
    f"""WITH {SQL_SIDES} SELECT kind, row_ix, kind || '::{DATASET}::row::' || row_ix AS name,
      CASE WHEN action = 'DELETE' THEN 'DELETE' ELSE 'UPSERT' END AS action,
      CASE WHEN action <> 'DELETE' THEN CAST(ceil(length(want) / 1500.0) AS INTEGER) END AS chunks
    FROM plan WHERE action <> 'KEEP'""",
)
def sync_actions(spark, sf):
    desired, _, current = sides(spark, sf)
    return sync.sync_actions(sync.plan_sync(desired, current), desired, DATASET, False)


@query(
    "sync_actions_applied",
    f"""WITH {SQL_SIDES} SELECT kind, row_ix, kind || '::{DATASET}::row::' || row_ix AS name,
      CASE WHEN action = 'DELETE' THEN 'DELETE_APPLIED' ELSE 'UPSERT_APPLIED' END AS action,
      CASE WHEN action <> 'DELETE' THEN CAST(ceil(length(want) / 1500.0) AS INTEGER) END AS chunks,
      CASE WHEN action = 'DELETE' THEN 1 END AS rows
    FROM plan WHERE action <> 'KEEP'""",
)
def sync_actions_applied(spark, sf):
    desired, _, current = sides(spark, sf)
    return sync.sync_actions(sync.plan_sync(desired, current), desired, DATASET, True, current=current)


def applied(spark, sf):
    """The store after one sync: the plan is kept, then applied to the saved items it was made from."""
    path = scratch_path(spark, "items")
    save_items(stored_items(spark, sf), path)
    items = load(spark, path)
    chunks = embed_hashed(chunk_items(spread_out(items, "id")))
    desired = staged(sync.desired_rows(positions(spark, sf)), "desired-rows")
    current = sync.current_rows(items_of(items, t.KINDS, DATASET))
    plan = durable(sync.plan_sync(desired, current))
    return desired, sync.apply_sync(plan, desired, items, chunks, DATASET, embed_hashed, _now())


_SQL_SYNCED = f"WITH {SQL_SIDES}, {SQL_APPLIED} SELECT kind, name, body, version, created_at, updated_at, meta_row FROM applied"


@query("sync_change_store", _SQL_SYNCED)
def sync_change_store(spark, sf):
    """The sync as a change to a stored base: only changed rows are written, and the present rows read."""
    path = scratch_path(spark, "store")
    stored = stored_items(spark, sf)
    changes.create(stored, chunk_items(spread_out(stored, "id")), path)
    items, _ = changes.read(spark, path)
    desired = staged(sync.desired_rows(positions(spark, sf)), "desired-rows")
    plan = durable(sync.plan_sync(desired, sync.current_rows(items_of(items, t.KINDS, DATASET))))
    sync.change_store(spark, path, plan, desired, DATASET, lambda cut: cut, _now())
    return _items_shown(changes.read(spark, path)[0])


@query("sync_apply", _SQL_SYNCED)
def sync_apply(spark, sf):
    return _items_shown(applied(spark, sf)[1][0])


def _items_shown(items):
    stamp = "yyyy-MM-dd HH:mm:ss"
    return items.select(
        "kind",
        "name",
        "body",
        "version",
        F.date_format("created_at", stamp).alias("created_at"),
        F.date_format("updated_at", stamp).alias("updated_at"),
        F.element_at("metadata", F.lit("row")).alias("meta_row"),
    )


@query(
    "sync_apply_chunks",
    f"""WITH {SQL_SIDES}, {SQL_APPLIED}, {t.sql_chunks('applied', 'name')}
    SELECT item_id AS name, chunk_ix, chunk_text FROM chunks""",
)
def sync_apply_chunks(spark, sf):
    _, (items, chunks) = applied(spark, sf)
    names = items.select(F.col("id").alias("item_id"), "name")
    return chunks.join(names, "item_id").select("name", "chunk_ix", "chunk_text")


@query(
    "sync_replan",
    f"""WITH {SQL_SIDES} SELECT kind, row_ix, 'KEEP' AS action FROM plan WHERE action <> 'DELETE'""",
)
def sync_replan(spark, sf):
    """A second plan after applying the first has nothing left to do."""
    desired, (items, _) = applied(spark, sf)
    return sync.plan_sync(desired, sync.current_rows(items_of(items, t.KINDS, DATASET)))


@query(
    "export_gapfill",
    f"""WITH {SQL_SIDES}, grid AS (SELECT kind, unnest(range(0, max(row_ix) + 1)) AS row_ix FROM now_held GROUP BY kind)
    SELECT kind, row_ix, coalesce(h.body, '') AS body FROM grid LEFT JOIN now_held h USING (kind, row_ix)""",
)
def export_gapfill(spark, sf):
    return sync.export_rows(sides(spark, sf)[2])


# --- CSV files ----------------------------------------------------------------------------------


@query("csv_kind_rows", f"WITH {SQL_POSITIONS} SELECT kind, row_ix, {t.sql_strip('body')} AS body FROM positions")
def csv_kind_rows(spark, sf):
    """Documents written as one CSV folder per kind, then read back with their positions."""
    path = scratch_path(spark, "item-files")
    write_item_files(positions(spark, sf), path)
    kinds = sorted(r["kind"] for r in positions(spark, sf).select("kind").distinct().collect())
    return read_item_files(spark, {k: f"{path}/kind={k}" for k in kinds})


@query(
    "dedupe_kind",
    f"""WITH {SQL_POSITIONS}, first AS (
      SELECT kind, row_ix AS was, body FROM positions
      QUALIFY row_number() OVER (PARTITION BY kind, {t.sql_normalize('body')} ORDER BY row_ix) = 1)
    SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY was) - 1 AS row_ix, body FROM first""",
)
def dedupe_kind(spark, sf):
    return first_by_text(positions(spark, sf).select("kind", "row_ix", "body"))


def _entry_lines(spark, sf):
    """Pages as ragged entry lines: a repeated key, quoted cells, and a key without value for some."""
    pages = t.table(spark, sf, "pages")
    size, page = F.length("html").cast("string"), F.col("page_id").cast("string")
    body = F.concat(F.lit('Page "'), page, F.lit('", of '), size, F.lit(" characters"))
    cells = [F.lit("info"), csv_cell(F.col("url")), csv_cell(body), F.lit("size"), F.lit("0"), F.lit("page"), page, F.lit("size"), size]
    line = F.concat_ws(",", *cells, F.when(F.col("url").contains("?"), F.lit("dangling")))
    return pages.select(line.alias("value"))


def _entries(spark, sf):
    path = scratch_path(spark, "entries")
    _entry_lines(spark, sf).write.text(path)
    return ragged_entries(read_ragged(spark, path))


SQL_ENTRIES = """entries AS (
  SELECT 'info' AS kind, url AS name, 'Page "' || page_id || '", of ' || length(html) || ' characters' AS body,
    CAST(page_id AS VARCHAR) AS page, CAST(length(html) AS VARCHAR) AS size, page_id
  FROM pages WHERE NOT contains(url, '?'))"""


@query(
    "ragged_metadata",
    f"""WITH {SQL_ENTRIES} SELECT kind, name, body, page, size, 2 AS keys FROM entries
    UNION ALL SELECT 'reject', url, 'dangling', NULL, NULL, 10 FROM pages WHERE contains(url, '?')""",
)
def ragged_metadata(spark, sf):
    entries, rejects = _entries(spark, sf)
    kept = entries.select(
        "kind",
        "name",
        "body",
        F.element_at("metadata", F.lit("page")).alias("page"),
        F.element_at("metadata", F.lit("size")).alias("size"),
        F.size("metadata").alias("keys"),
    )
    none = F.lit(None).cast("string")
    bad = rejects.select(
        F.lit("reject").alias("kind"),
        F.col("cells")[1].alias("name"),
        F.element_at("cells", -1).alias("body"),
        none.alias("page"),
        none.alias("size"),
        F.size("cells").alias("keys"),
    )
    return kept.unionByName(bad)


@query(
    "bulk_commit",
    f"""WITH {SQL_ENTRIES}, arrived AS (
      SELECT kind, name, arg_max(body, page_id) AS body, count(*) AS version FROM entries GROUP BY ALL),
    {t.SQL_ITEMS}, {t.sql_chunks()}
    SELECT kind, name, CAST(version AS INTEGER) AS version, 0 AS chunk_ix, body AS chunk_text FROM arrived
    UNION ALL SELECT i.kind, i.name, 1, c.chunk_ix, c.chunk_text FROM items i JOIN chunks c ON c.item_id = i.id""",
)
def bulk_commit(spark, sf):
    """Page entries committed into the document store, listed with every stored chunk."""
    entries, _ = _entries(spark, sf)
    items = t.items(spark, sf)
    new_items, new_chunks = commit_entries(entries, items, t.chunks(spark, sf), embed_hashed, _now())
    named = new_items.select(F.col("id").alias("item_id"), "kind", "name", "version")
    listed = new_chunks.select("item_id", "chunk_ix", "chunk_text")
    return listed.join(named, "item_id").select("kind", "name", "version", "chunk_ix", "chunk_text")


# --- store changes ------------------------------------------------------------------------------


def arrivals(spark, sf):
    """Labelled documents arrive again with their label; each turn of a conversation updates one item."""
    docs = t.items(spark, sf).join(t.table(spark, sf, "labels").withColumnRenamed("doc_id", "id"), "id")
    labelled = docs.select(
        "kind",
        "name",
        F.concat("body", F.lit(" [quality="), F.col("quality").cast("string"), F.lit("]")).alias("body"),
        "metadata",
        F.lit(0).cast("long").alias("seq"),
    )
    talk = t.table(spark, sf, "conversations").select(
        F.lit("info").alias("kind"),
        F.concat(F.lit("conv::"), F.col("conv_id").cast("string")).alias("name"),
        F.col("text").alias("body"),
        F.create_map(F.lit("turn"), F.col("turn").cast("string")).alias("metadata"),
        F.col("turn").alias("seq"),
    )
    return labelled.unionByName(talk)


@query(
    "item_upsert",
    f"""WITH {t.SQL_ITEMS}
    SELECT kind, name, CASE WHEN l.doc_id IS NULL THEN body ELSE body || ' [quality=' || quality || ']' END AS body,
      CASE WHEN l.doc_id IS NULL THEN 1 ELSE 2 END AS version, NULL AS turn, l.doc_id IS NOT NULL AS touched
    FROM items LEFT JOIN labels l ON l.doc_id = items.id
    UNION ALL
    SELECT 'info', 'conv::' || conv_id, arg_max(text, turn), CAST(count(*) AS INTEGER), CAST(max(turn) AS VARCHAR), true
    FROM conversations GROUP BY conv_id""",
)
def item_upsert(spark, sf):
    merged = upsert.upsert_items(t.items(spark, sf), arrivals(spark, sf), _now())
    return merged.select(
        "kind",
        "name",
        "body",
        "version",
        F.element_at("metadata", F.lit("turn")).alias("turn"),
        (F.col("updated_at") == _now()).alias("touched"),
    )


@query(
    "item_ids",
    f"""WITH {t.SQL_ITEMS} SELECT n AS items, n AS distinct_ids, n - (SELECT count(*) FROM items) AS new_items
    FROM (SELECT (SELECT count(*) FROM items) + (SELECT count(DISTINCT conv_id) FROM conversations) AS n)""",
)
def item_ids(spark, sf):
    """Every item has its own id after an upsert."""
    before = t.items(spark, sf).select("id").withColumn("_old", F.lit(True))
    merged = upsert.upsert_items(t.items(spark, sf), arrivals(spark, sf), _now())
    per_id = merged.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(before, "id", "left")
    return per_id.agg(
        F.sum("n").alias("items"), F.count(F.lit(1)).alias("distinct_ids"), F.count_if(F.col("_old").isNull()).alias("new_items")
    )


@query(
    "chunk_replace",
    f"""WITH {t.SQL_ITEMS}, mixed AS (
      SELECT id, CASE WHEN l.quality = 0 THEN 'Revised. ' || body ELSE body END AS body FROM items LEFT JOIN labels l ON l.doc_id = items.id),
    {t.sql_chunks('mixed')} SELECT item_id, chunk_ix, chunk_text FROM chunks""",
)
def chunk_replace(spark, sf):
    items = spread_out(t.items(spark, sf), "id")
    poor = t.table(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    revised = items.join(poor, "id").withColumn("body", F.concat(F.lit("Revised. "), F.col("body")))
    return upsert.replace_chunks(
        chunk_items(items), poor.select(F.col("id").alias("item_id")), chunk_items(revised)
    )


@query(
    "items_by_kind",
    f"""WITH {t.SQL_ITEMS} SELECT id, kind, name, body, id AS row_ix FROM items WHERE kind IN ('info', 'example') AND dataset = 'src3'""",
)
def items_by_kind(spark, sf):
    return items_of(t.items(spark, sf), ["info", "example"], "src3").select("id", "kind", "name", "body", "row_ix")


# --- audit --------------------------------------------------------------------------------------


def audited(spark, sf):
    """The document store, in which toxic documents were never chunked."""
    items = spread_out(t.items(spark, sf), "id")
    toxic = t.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return items, chunk_items(items.join(toxic, "id", "left_anti"))


SQL_AUDITED = f"""{t.SQL_ITEMS},
visible AS (SELECT * FROM items WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {t.sql_chunks('visible')}"""


@query("audit_chunks", f"WITH {SQL_AUDITED} SELECT *, length(chunk_text) AS chars FROM chunks")
def audit_chunks(spark, sf):
    return audit.chunk_listing(audited(spark, sf)[1])


@query("audit_csv_file", f"WITH {SQL_AUDITED} SELECT item_id, chunk_ix, md5(chunk_text) AS digest, length(chunk_text) AS chars FROM chunks")
def audit_csv_file(spark, sf):
    """The listing of chunks as the audit's CSV file, read back record by record."""
    path = scratch_path(spark, "audit")
    write_audit_csv(audit.chunk_listing(audited(spark, sf)[1]), path, ["item_id", "chunk_ix"])
    cells = F.col("cells")
    return quoted_records(spark, path).where("rec > 0").select(  # a file's first record is its header
        cells[0].cast("long").alias("item_id"), cells[1].cast("int").alias("chunk_ix"), F.md5(cells[2]).alias("digest"), cells[3].cast("int").alias("chars")
    )


@query("audit_missing", f"WITH {SQL_AUDITED} SELECT id, kind, name FROM items WHERE id NOT IN (SELECT item_id FROM chunks)")
def audit_missing(spark, sf):
    return audit.missing_items(*audited(spark, sf))


@query(
    "audit_missing_head",
    f"WITH {SQL_AUDITED} SELECT id, kind, name FROM items WHERE id NOT IN (SELECT item_id FROM chunks) ORDER BY kind, name LIMIT 10",
)
def audit_missing_head(spark, sf):
    return audit.missing_head(*audited(spark, sf))


@query(
    "audit_full_text",
    f"""WITH {SQL_AUDITED} SELECT id, kind, name, coalesce(string_agg(chunk_text, '' ORDER BY chunk_ix), '') AS full_text,
      CAST(count(chunk_ix) AS INTEGER) AS chunk_count
    FROM items LEFT JOIN chunks ON item_id = id GROUP BY id, kind, name""",
)
def audit_full_text(spark, sf):
    return audit.full_texts(*audited(spark, sf))


@query(
    "audit_snapshot",
    f"""WITH {SQL_AUDITED}, nested AS (
      SELECT item_id, string_agg(chunk_ix || ':' || length(chunk_text) || ':' || md5(chunk_text), ' ' ORDER BY chunk_ix) AS chunks,
        string_agg(chunk_text, '' ORDER BY chunk_ix) AS full_text, CAST(count(*) AS INTEGER) AS chunk_count
      FROM chunks GROUP BY item_id)
    SELECT id, kind, name, version, dataset, body AS item_body, coalesce(chunks, '') AS chunks, coalesce(full_text, '') AS full_text,
      coalesce(chunk_count, 0) AS chunk_count FROM items LEFT JOIN nested ON item_id = id""",
)
def audit_snapshot(spark, sf):
    listed = F.transform(
        "chunks", lambda c: F.concat_ws(":", c["chunk_ix"].cast("string"), c["chars"].cast("string"), F.md5(c["chunk_text"]))
    )
    return audit.snapshot(*audited(spark, sf)).select(
        "id",
        "kind",
        "name",
        "version",
        F.element_at("metadata", F.lit("dataset")).alias("dataset"),
        "item_body",
        F.array_join(listed, " ").alias("chunks"),
        "full_text",
        "chunk_count",
    )


@query("audit_by_kind", f"WITH {t.SQL_ITEMS} SELECT kind, count(*) AS n FROM items GROUP BY kind")
def audit_by_kind(spark, sf):
    return audit.items_by_kind(t.items(spark, sf))


@query(
    "audit_totals",
    f"""WITH {SQL_AUDITED} SELECT (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM chunks) AS chunks,
      (SELECT count(*) FROM items WHERE id NOT IN (SELECT item_id FROM chunks)) AS missing_items""",
)
def audit_totals(spark, sf):
    return audit.totals(*audited(spark, sf))


@query(
    "audit_preview",
    f"""WITH {SQL_AUDITED}, head AS (SELECT * FROM items ORDER BY kind, name LIMIT 5)
    SELECT kind, name, CAST(count(chunk_ix) AS INTEGER) AS chunk_count,
      replace(substr(coalesce(string_agg(chunk_text, '' ORDER BY chunk_ix), any_value(body)), 1, 200), chr(10), ' ') AS preview
    FROM head LEFT JOIN chunks ON item_id = id GROUP BY kind, name""",
)
def audit_preview(spark, sf):
    return audit.previews(*audited(spark, sf))


@query(
    "embedding_width",
    """SELECT 'float' AS element_type, min(len(embedding)) AS min_width, max(len(embedding)) AS max_width,
      count(*) FILTER (embedding IS NULL) AS missing FROM embeddings""",
)
def embedding_width(spark, sf):
    return audit.embedding_width(t.table(spark, sf, "embeddings"))


SEGMENT_TURNS = 8


@query(
    "stitch_conversations",
    f"""SELECT conv_id, turn // {SEGMENT_TURNS} AS segment, string_agg(text, '' ORDER BY turn) AS text, CAST(count(*) AS INTEGER) AS chunk_count
    FROM conversations GROUP BY ALL""",
)
def stitch_conversations(spark, sf):
    """Turns of each conversation end to end, a few turns to a segment."""
    turns = t.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("item_id"), F.col("turn").alias("chunk_ix"), F.col("text").alias("chunk_text")
    )
    return audit.stitched_segments(turns, SEGMENT_TURNS).withColumnRenamed("item_id", "conv_id")
