"""Queries of enrichment, keys and run rows, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import scalars as S
from gleanery.operators import enrichment as E
from gleanery.operators import ingest, processors
from gleanery.plans.ingest_plans import _WS, _field, _hash, _items, _parsed
from gleanery.plans.reference import ev, query
from gleanery.sources import table


@query("SELECT DISTINCT evidence_id, CASE source_kind WHEN 'x_account' THEN 'account/' || coalesce(nullif(author_handle, ''), evidence_id) WHEN 'media' THEN 'media/' || evidence_id ELSE evidence_id END AS point_key, CASE source_kind WHEN 'x_account' THEN 'account_dense' WHEN 'media' THEN CASE WHEN coalesce(has_ocr, 0) = 1 THEN 'ocr_dense' ELSE 'caption_dense' END ELSE 'text_dense' END AS vector_name FROM evidence_events")
def vector_routes(spark, d):
    k = F.col("source_kind")
    return ev(spark, d).select("evidence_id", E.point_key(k, F.col("evidence_id"), F.col("author_handle")).alias("point_key"), E.vector_name(k, F.col("has_ocr")).alias("vector_name")).distinct()


_TITLE, _SNIPPET = _field("x", "title"), _field("x", "snippet", "description", "text")


@query(_items("search_result") + f", t AS (SELECT rtrim(substring(concat_ws(' ', nullif({_TITLE}, ''), nullif({_SNIPPET}, '')), 1, 4000), ' ') AS text FROM i) SELECT text, count(*) AS n FROM t WHERE text <> '' GROUP BY 1")
def vector_texts_of_results(spark, d):
    made = E.vector_inputs(ingest.project_search_results(_parsed(spark, d)))
    return made.groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query()
def vector_inputs(spark, d):
    return E.vector_inputs(ingest.project_all(_parsed(spark, d)))


@query("WITH m AS (SELECT media_id AS evidence_id, sha256 AS sha, substring(sha256('media-v1' || chr(0) || 'max_bytes=26214400' || chr(0) || 'max_pixels=40000000' || chr(0) || 'vl_max_side=1600' || chr(0)), 1, 16) AS params_hash FROM media_observed) SELECT evidence_id, params_hash FROM m WHERE NOT EXISTS (SELECT 1 FROM media_ocr_results o WHERE o.status = 'ok' AND o.source_sha256 = m.sha AND o.params_hash = m.params_hash)")
def media_open(spark, d):
    m = table(spark, d, "media_observed").select(F.col("media_id").alias("evidence_id"), F.col("sha256").alias("artifact_sha256"), ingest.media_params_hash().alias("params_hash"))
    return E.open_requests(m, table(spark, d, "media_ocr_results")).select("evidence_id", "params_hash")


@query(f"SELECT ocr_id, 'ocr_' || substring({_hash('source_sha256', chr(39) + 'paddleocr' + chr(39), 'params_hash')}, 1, 24) AS made_id, CASE WHEN trim(coalesce(error_message, ''), {_WS}) <> '' THEN 'failed' ELSE 'completed' END AS status FROM media_ocr_results")
def recognition_ids(spark, d):
    r = table(spark, d, "media_ocr_results")
    blocks = F.array().cast("array<struct<text:string,confidence:double>>")
    made = E.recognition_rows(r.select(F.col("ocr_id").alias("evidence_id"), F.col("source_sha256").alias("artifact_sha256"), "params_hash", F.lit("").alias("text"), blocks.alias("blocks"), F.col("error_message").alias("error")))
    return made.select(F.col("evidence_id").alias("ocr_id"), F.col("ocr_id").alias("made_id"), "status")


@query("SELECT DISTINCT source_kind, CASE source_kind WHEN 'x_post' THEN 'X post' WHEN 'x_account' THEN 'X account' WHEN 'web_page' THEN 'Web/blog' WHEN 'search_result' THEN 'Search result' WHEN 'media' THEN 'Media' WHEN 'user_input' THEN 'Manual doc' WHEN 'capture' THEN 'Capture' ELSE coalesce(nullif(source_kind, ''), 'unknown') END AS label FROM evidence_events")
def kind_labels(spark, d):
    return ev(spark, d).select("source_kind").distinct().select("source_kind", E.kind_label(F.col("source_kind")).alias("label"))


@query("SELECT kafka_partition, kafka_offset, coalesce(nullif(json_extract_string(raw_value, '$.collector_run_id'), ''), 'unknown') || ':' || coalesce(nullif(json_extract_string(raw_value, '$.event_index'), ''), '0') AS key FROM capture_events WHERE json_valid(raw_value) AND json_type(raw_value::JSON) = 'OBJECT'")
def message_keys(spark, d):
    p = _parsed(spark, d).where(F.col("doc").isNotNull())
    return p.select("kafka_partition", "kafka_offset", E.message_key(F.lit("evidence.capture.events.v1"), F.col("raw_value")).alias("key"))


@query("SELECT run_id, status, duration_ms IS NOT NULL AND duration_ms = date_diff('millisecond', started_at, finished_at) AS exact FROM ops_canary_runs")
def canary_durations(spark, d):
    took = F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("finished_at"))
    return table(spark, d, "ops_canary_runs").select("run_id", "status", (F.col("duration_ms").isNotNull() & (F.col("duration_ms") == took)).alias("exact"))


@query("WITH c AS (SELECT DISTINCT engine AS model, engine_version IS NOT NULL AS installed FROM media_ocr_results), h AS (SELECT engine AS model, bool_or(status = 'ok') AS loaded FROM media_ocr_results GROUP BY 1) SELECT model, CASE WHEN coalesce(loaded, false) THEN 'loaded' WHEN installed THEN 'available' ELSE 'missing' END AS status FROM c LEFT JOIN h USING (model)")
def model_inventory(spark, d):
    r = table(spark, d, "media_ocr_results")
    catalogue = r.select(F.col("engine").alias("model"), F.col("engine_version").isNotNull().alias("installed")).distinct()
    return E.model_inventory(catalogue, r.select(F.col("engine").alias("model"), (F.col("status") == "ok").alias("loaded"))).select("model", "status")


@query("SELECT media_id, TRY_CAST(sha256 AS BIGINT) IS NOT NULL AS numeric_sha, greatest(2, least(8, coalesce(len(topics), 0) + 1))::BIGINT AS target FROM media_observed")
def media_targets(spark, d):
    return table(spark, d, "media_observed").select("media_id", F.col("sha256").try_cast("bigint").isNotNull().alias("numeric_sha"), S.target_count(F.coalesce(F.size("topics"), F.lit(0))).cast("long").alias("target"))


@query()
def processor_chain(spark, d):
    """The shadow run by configuration: parse, validate, keep the valid, project, wrap."""
    return processors.run(table(spark, d, "capture_events"), ["capture_parse", "capture_validate", "valid_only", "observed_event_projector", "observed_shadow_envelope"])[0]
