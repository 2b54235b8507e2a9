"""One query per operator over the whole tables, reduced to the contract's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.llm import decontamination, filter_audit, language_id, language_model, licenses, mixing, ngram_jaccard, pii, quality_ranking, repeated_spans, sharding
from quern.llm import quality_rules as rules
from quern.llm import vector_codes
from quern.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401


@query("op1_quality_rules")
def op1(spark, sf):
    trusted = table(spark, sf, "labels").where((F.col("quality") == 1) & (F.col("toxic") == 0))
    return rules.quality_rules(table(spark, sf, "documents"), trusted)


@query("op9_license_scans")
def op9(spark, sf):
    return licenses.scan_licenses(table(spark, sf, "documents"))


@query("op10_mix_sources")
def op10(spark, sf):
    mixed = mixing.mix_documents(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op3_sampled_splitters")
def op3(spark, sf):
    found = sharding.shard_digests(table(spark, sf, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_pii_weak_supervision")
def op2(spark, sf):
    found = pii.find_pii(table(spark, sf, "documents"))
    counts = [pii.kind_count(F.col("base"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("found")).alias("spans"))


@query("op4_language_id")
def op4(spark, sf):
    return language_id.identify(table(spark, sf, "documents"))


@query("op5_quality_ranking")
def op5(spark, sf):
    return quality_ranking.rank_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op7_backoff_automaton")
def op7(spark, sf):
    docs = table(spark, sf, "documents")
    fold = language_model.held_out(F.col("doc_id"))
    found = language_model.score_texts(docs, docs.where(~fold))
    return found.select("doc_id", fold.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_simhash_decontamination")
def op8(spark, sf):
    return decontamination.find_matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op6_signature_trees")
def op6(spark, sf):
    return ngram_jaccard.link_groups(table(spark, sf, "documents"))


_AUDIT_SQL = """
WITH RECURSIVE counted AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
    FROM documents
), smallest AS (
    SELECT body, min(doc_id) AS least FROM counted GROUP BY body
), failed AS (
    SELECT c.doc_id, c.part,
        [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
         100 * length(regexp_replace(c.body, '[^A-Z]', '', 'g')) > 10 * length(c.body),
         regexp_matches(c.body, '[#$%&*|]'), coalesce(c.doc_id > s.least, false)] AS fails
    FROM counted c JOIN smallest s ON c.body = s.body
), marked AS (
    SELECT part, fails, list_count(list_filter(fails, lambda f: f)) AS n_fails,
        doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
        doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
    FROM failed
), cells AS (
    SELECT part, fails, n_fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM marked GROUP BY part, fails, n_fails
), orders AS (
    SELECT '' AS filter_order
    UNION ALL
    SELECT filter_order || letter FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter) WHERE NOT contains(filter_order, letter)
), steps AS (
    SELECT filter_order, step, ascii(filter_order[step]) - 64 AS filter, [ascii(x) - 64 FOR x IN string_split(filter_order[1:step - 1], '') IF x <> ''] AS earlier
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5
), seen AS (
    SELECT c.*, s.*, fails[filter] AS fails_here, len([e FOR e IN earlier IF fails[e]]) > 0 AS gone FROM cells c, steps s
), figures AS (
    SELECT part, filter_order, step, filter,
        CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails_here), 0) AS BIGINT) AS kept,
        CAST(coalesce(sum(n) FILTER (NOT gone AND fails_here), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (gone AND fails_here), 0) AS BIGINT) AS redundant,
        CAST(coalesce(sum(n) FILTER (fails_here AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (NOT gone AND fails_here), 0) AS BIGINT) AS good_lost,
        CAST(coalesce(sum(toxic) FILTER (NOT gone AND fails_here), 0) AS BIGINT) AS toxic_lost
    FROM seen GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM figures
"""


@query("op11_filter_audit", _AUDIT_SQL)
def op11(spark, sf):
    return filter_audit.audit_filters(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op12_suffix_ranks")
def op12(spark, sf):
    return repeated_spans.span_digests(table(spark, sf, "documents"))


@query("op13_vector_codes")
def op13(spark, sf):
    return vector_codes.code_digests(table(spark, sf, "embeddings"))
