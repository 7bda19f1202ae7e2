"""Queries of ingest, labels and research plans over the capture and evidence tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import scalars as S
from gleanery.operators import ingest, labels
from gleanery.plans.reference import ev, query
from gleanery.sources import table

_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"


def _field(x: str, *names: str) -> str:
    """SQL of an object's first scalar field that is not blank, else empty."""
    one = "CASE WHEN json_type({x}, '$.{n}') IN ('OBJECT', 'ARRAY') THEN NULL ELSE nullif(regexp_replace(trim(json_extract_string({x}, '$.{n}'), {ws}), '^(-?[0-9]+)\\.0+$', '\\1'), '') END"
    return "coalesce(" + ", ".join(one.format(x=x, n=n, ws=_WS) for n in names) + ", '')"


def _objects(path: str) -> str:
    return f"list_filter(CASE WHEN json_type(j, '$.{path}') = 'ARRAY' THEN json_extract(j, '$.{path}[*]') ELSE [] END, lambda x: json_type(x) = 'OBJECT')"


def _list(kind: str) -> str:
    """SQL of the objects of a kind: the first of its places that holds any."""
    names, in_context = ingest.ARRAYS[kind]
    places = [*names, *([f"context.{n}" for n in names] if in_context else [])]
    return "CASE " + " ".join(f"WHEN len({_objects(p)}) > 0 THEN {_objects(p)}" for p in places) + " ELSE [] END"


_RECORDS = """r AS (SELECT topic_name, kafka_partition, kafka_offset, kafka_key, raw_value, CASE WHEN json_valid(raw_value) AND json_type(raw_value::JSON) = 'OBJECT' THEN raw_value::JSON END AS j FROM capture_events)"""
_HEAD = f"""{_RECORDS}, h AS (SELECT *, {_field("j", "collector_run_id")} AS run, {_field("j", "event_index")} AS idx_text, TRY_CAST(nullif({_field("j", "event_index")}, '') AS BIGINT) AS event_index FROM r)"""


def _items(kind: str) -> str:
    """SQL of the objects of a kind, one row each: x, idx, run, event_index, j."""
    return f"WITH {_HEAD}, l AS (SELECT run, event_index, j, {_list(kind)} AS xs FROM h WHERE j IS NOT NULL), i AS (SELECT run, event_index, j, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS idx FROM l)"


_EVENT = "concat_ws(':', run, event_index::VARCHAR) AS event_id"


def _host(url: str) -> str:
    return f"coalesce(regexp_replace(lower(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', ''), '')"


def _parsed(spark, d):
    return ingest.parse(table(spark, d, "capture_events"))


def _hash(*parts: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(({p})::VARCHAR, '') || chr(0)" for p in parts) + ")"


@query(f"WITH {_HEAD} SELECT kafka_partition, kafka_offset, j IS NOT NULL AS parsed, run AS collector_run_id, event_index FROM h")
def ingest_parse(spark, d):
    return _parsed(spark, d).select("kafka_partition", "kafka_offset", F.col("doc").isNotNull().alias("parsed"), "collector_run_id", "event_index")


_MISSING = "list_filter([" + ", ".join(f"CASE WHEN {'event_index IS NULL' if n == 'event_index' else _field('j', n) + chr(32) + '= ' + chr(39) * 2} THEN '{n}' END" for n in ingest.REQUIRED) + "], lambda x: x IS NOT NULL)"
_COUNT = " + ".join(f"coalesce(CASE WHEN json_type(j, '$.{a}') = 'ARRAY' THEN json_array_length(j, '$.{a}') END, 0)" for a in ingest.COUNTED)
_MADE = " + ".join(f"len({_list(k)})" for k in ingest.ARRAYS)
_CHECKED = f"""WITH {_HEAD}, m AS (SELECT *, {_MISSING} AS missing, {_COUNT} AS n_given, {_MADE} AS n_made FROM h),
    c AS (SELECT *, CASE WHEN j IS NULL THEN 'invalid json' WHEN len(missing) > 0 THEN 'missing required fields: ' || array_to_string(missing, ', ') WHEN event_index < 0 THEN 'event_index must be >= 0'
    WHEN n_given = 0 THEN 'capture event contains no evidence arrays' WHEN n_made = 0 THEN 'capture event produced no observed records' END AS error FROM m)"""


@query(_CHECKED + " SELECT kafka_partition, kafka_offset, error FROM c")
def ingest_validate(spark, d):
    return ingest.validate(_parsed(spark, d)).select("kafka_partition", "kafka_offset", "error")


_KIND = f"CASE WHEN {_field('j', 'page_url')} = '' THEN 'capture' WHEN contains({_host(_field('j', 'page_url'))}, 'x.com') OR contains({_host(_field('j', 'page_url'))}, 'twitter.com') THEN 'x_page' WHEN contains({_host(_field('j', 'page_url'))}, 'google.') THEN 'google_search_page' ELSE 'web_page' END"


@query(
    f"WITH {_HEAD}, n AS (SELECT kafka_partition, kafka_offset, {_KIND} AS own, [" + ", ".join(f"{{'k': '{k}', 'n': len({_list(k)})}}" for k in ingest.ARRAYS) + "] AS l FROM h WHERE j IS NOT NULL), "
    "p AS (SELECT *, list_filter(l, lambda x: x.n > 0) AS f FROM n) "
    "SELECT kafka_partition, kafka_offset, CASE WHEN len(f) > 0 THEN f[1].k ELSE own END AS primary_kind, CASE WHEN len(f) > 0 THEN list_sum(list_transform(f, lambda x: x.n))::BIGINT ELSE 1 END AS n_records, CASE WHEN len(f) > 0 THEN array_to_string(list_transform(f, lambda x: x.k || '=' || x.n::VARCHAR), ',') ELSE own || '=1' END AS counts FROM p"
)
def ingest_source_kinds(spark, d):
    k = ingest.source_kinds(_parsed(spark, d).where(F.col("doc").isNotNull()))
    counts = F.array_join(F.transform("kinds", lambda x: F.concat(x, F.lit("="), F.col("kind_counts")[x].cast("string"))), ",")
    return k.select("kafka_partition", "kafka_offset", "primary_kind", F.col("n_records").cast("long").alias("n_records"), counts.alias("counts"))


@query(
    _CHECKED + " SELECT 'v1' AS schema_version, CASE WHEN error = 'invalid json' THEN 'parse_error' ELSE 'validation_error' END AS error_class, error AS error_message, trim(topic_name) AS original_topic, kafka_partition::VARCHAR AS original_partition, "
    "kafka_offset::VARCHAR AS original_offset, coalesce(trim(kafka_key), '') AS original_key, sha256(coalesce(raw_value, '')) AS payload_sha256, raw_value AS raw, 'evidence.capture.shadow.errors.v1' AS target_topic, "
    "topic_name || '/' || kafka_partition::VARCHAR || '/' || kafka_offset::VARCHAR AS target_key FROM c WHERE error IS NOT NULL"
)
def ingest_dead_letters(spark, d):
    dead = ingest.dead_letters(ingest.validate(_parsed(spark, d)))
    return dead.select("schema_version", "error_class", "error_message", "original_topic", "original_partition", "original_offset", "original_key", "payload_sha256", "raw", "target_topic", "target_key")


_POST_URL, _POST_ID = _field("x", "canonical_url", "url", "href"), _field("x", "post_id", "id", "tweet_id", "status_id")
_STATUS = r"(?i)(?:x|twitter)\.com/([^/\s?#]+)/status/(\d+)"
_POST_TEXT = _field("x", "text", "full_text", "content", "body")
_AUTHOR = f"lower(regexp_replace(coalesce(nullif({_field('x', 'author_handle', 'handle', 'screen_name', 'username')}, ''), CASE WHEN {_POST_ID} = '' THEN lower(regexp_extract({_POST_URL}, '{_STATUS}', 1)) END, ''), '^@', ''))"


@query(
    _items("x_post") + f", p AS (SELECT *, {_POST_URL} AS given_url, coalesce(nullif({_POST_ID}, ''), regexp_extract({_POST_URL}, '{_STATUS}', 2)) AS pid, {_AUTHOR} AS author, {_POST_TEXT} AS body FROM i), "
    "u AS (SELECT *, CASE WHEN given_url = '' AND pid <> '' AND author <> '' THEN 'https://x.com/' || author || '/status/' || pid ELSE given_url END AS url FROM p), "
    f"k AS (SELECT *, CASE WHEN pid <> '' THEN pid ELSE substring({_hash('run', 'event_index', chr(39) + 'post' + chr(39), 'idx', 'url', 'body')}, 1, 16) END AS key FROM u) "
    f"SELECT {_EVENT}, idx, 'evidence.posts.observed.v1' AS target_topic, key AS evidence_id, {_hash('run', 'event_index', chr(39) + 'post' + chr(39), 'key', 'idx')} AS observation_id, url AS canonical_url, author AS author_handle, {_host('url')} AS domain, body AS text, {_field('x', 'author_name', 'name', 'display_name')} AS author_name FROM k"
)
def ingest_posts(spark, d):
    p = ingest.project_posts(_parsed(spark, d))
    return p.select("event_id", F.col("idx").cast("long").alias("idx"), "target_topic", "evidence_id", "observation_id", "canonical_url", "author_handle", "domain", "text", "author_name")


@query(
    _items("media") + f", k AS (SELECT *, {_field('x', 'media_id', 'id', 'sha256', 'url', 'local_path')} AS key FROM i) "
    f"SELECT {_EVENT}, idx, key AS evidence_id, {_hash('run', 'event_index', chr(39) + 'media' + chr(39), 'key', 'idx')} AS observation_id, {_field('x', 'media_kind', 'type', 'kind')} AS media_kind, {_field('x', 'url', 'src')} AS canonical_url, {_field('x', 'local_path', 'path')} AS local_path, {_field('x', 'sha256')} AS sha256, {_field('x', 'ocr_text')} AS text, {_field('x', 'caption', 'alt_text', 'description')} AS caption FROM k"
)
def ingest_media(spark, d):
    p = ingest.project_media(_parsed(spark, d))
    return p.select("event_id", F.col("idx").cast("long").alias("idx"), "evidence_id", "observation_id", "media_kind", "canonical_url", "local_path", "sha256", "text", "caption")


_QUERY = f"coalesce(nullif({_field('x', 'query')}, ''), nullif({_field('j', 'context.query')}, ''), '')"


@query(
    _items("search_result") + f", k AS (SELECT *, {_field('x', 'url', 'href', 'link')} AS url, {_QUERY} AS q FROM i) "
    f"SELECT {_EVENT}, idx, {_hash('q', 'url', 'idx')} AS evidence_id, url AS canonical_url, q AS query, coalesce(nullif({_field('x', 'engine', 'source')}, ''), nullif({_field('j', 'context.engine')}, ''), 'google') AS engine, {_field('x', 'title')} AS title, {_field('x', 'snippet', 'description', 'text')} AS text, "
    f"coalesce(trunc(TRY_CAST(nullif({_field('x', 'rank')}, '') AS DOUBLE))::BIGINT, trunc(TRY_CAST(nullif({_field('x', 'position')}, '') AS DOUBLE))::BIGINT, trunc(TRY_CAST(nullif({_field('x', 'index')}, '') AS DOUBLE))::BIGINT, idx + 1) AS rank FROM k"
)
def ingest_search_results(spark, d):
    p = ingest.project_search_results(_parsed(spark, d))
    return p.select("event_id", F.col("idx").cast("long").alias("idx"), "evidence_id", "canonical_url", "query", "engine", "title", "text", "rank")


_WEB_URL = _field("x", "canonical_url", "url", "source_url", "page_url", "href", "link")
_WEB_BODY = _field("x", "text", "content", "body", "markdown", "summary")


@query(
    _items("web_page") + f", k AS (SELECT *, {_WEB_URL} AS url, coalesce(nullif({_field('x', 'document_id', 'id')}, ''), substring({_hash(_WEB_URL, _field('x', 'text_hash', 'sha256'), _field('x', 'title'), _WEB_BODY, 'idx')}, 1, 24)) AS key FROM i) "
    f"SELECT {_EVENT}, idx, 'web_document/' || key AS evidence_id, {_hash('run', 'event_index', chr(39) + 'web_document' + chr(39), 'key', 'idx')} AS observation_id, url AS canonical_url, coalesce(nullif({_field('x', 'domain', 'host')}, ''), {_host('url')}) AS domain, {_field('x', 'title', 'page_title', 'headline')} AS title, {_field('x', 'text', 'content', 'body', 'markdown', 'summary', 'extracted_text')} AS text, {_field('x', 'document_kind', 'kind', 'content_form')} AS document_kind FROM k"
)
def ingest_web_documents(spark, d):
    p = ingest.project_web_documents(_parsed(spark, d))
    return p.select("event_id", F.col("idx").cast("long").alias("idx"), "evidence_id", "observation_id", "canonical_url", "domain", "title", "text", "document_kind")


@query(_items("x_account") + f" SELECT {_EVENT}, idx, lower(regexp_replace({_field('x', 'handle', 'author_handle', 'screen_name', 'username')}, '^@', '')) AS evidence_id, {_field('x', 'profile_url', 'url')} AS canonical_url, {_field('x', 'display_name', 'name', 'author_name')} AS title, {_field('x', 'bio', 'description', 'text')} AS text FROM i")
def ingest_accounts(spark, d):
    p = ingest.project_accounts(_parsed(spark, d))
    return p.select("event_id", F.col("idx").cast("long").alias("idx"), "evidence_id", "canonical_url", "title", "text")


_INPUT_TEXT = _field("x", "text", "content", "note", "body", "markdown", "summary")


@query(_items("user_input") + f" SELECT {_EVENT}, idx, 'user_input/' || coalesce(nullif({_field('x', 'input_id', 'note_id', 'id')}, ''), substring({_hash('run', 'event_index', chr(39) + 'user_input' + chr(39), _INPUT_TEXT, 'idx')}, 1, 24)) AS evidence_id, {_field('x', 'author', 'user', 'created_by')} AS author_handle, {_field('x', 'title', 'subject', 'heading')} AS title, {_INPUT_TEXT} AS text FROM i")
def ingest_user_inputs(spark, d):
    p = ingest.project_user_inputs(_parsed(spark, d))
    return p.select("event_id", F.col("idx").cast("long").alias("idx"), "evidence_id", "author_handle", "title", "text")


@query(
    f"WITH {_HEAD} SELECT kind AS source_kind, target_topic, count(*) AS n FROM (SELECT unnest([" + ", ".join(f"{{'kind': '{k}', 'target_topic': '{t}', 'n': len({_list(k)})}}" for k, t in ingest.TOPICS.items()) + "], recursive := true) FROM h WHERE j IS NOT NULL), range(10000) t(i) WHERE i < n GROUP BY ALL"
)
def ingest_topics(spark, d):
    """All kinds from one pass, counted by topic; the rows themselves are in the queries of the kinds."""
    return ingest.project_all(_parsed(spark, d)).groupBy("source_kind", "target_topic").agg(F.count(F.lit(1)).alias("n"))


@query()
def ingest_observed(spark, d):
    return ingest.project_all(_parsed(spark, d))


_FLAGGED = "list_filter([" + ", ".join(f"CASE WHEN coalesce(lower(trim(json_extract_string(j, '$.quality.{n}'))) IN ('true', '1', 'yes') OR coalesce(TRY_CAST(json_extract_string(j, '$.quality.{n}') AS DOUBLE), 0) <> 0, false) THEN '{n}' END" for n in ingest.FLAGS) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {_HEAD} SELECT kafka_partition, kafka_offset, array_to_string({_FLAGGED}, ',') AS flags, len(list_filter({_FLAGGED}, lambda x: x <> 'partial')) > 0 AS challenged FROM h WHERE j IS NOT NULL")
def capture_flags(spark, d):
    p = _parsed(spark, d).where(F.col("doc").isNotNull())
    return p.select("kafka_partition", "kafka_offset", F.array_join(ingest.quality_flags(F.col("quality")), ",").alias("flags"), ingest.challenged(F.col("quality")).alias("challenged"))


_TEXT_OF = f"coalesce(nullif({_field('j', 'context.query')}, ''), nullif({_field('j', 'context.text')}, ''), nullif({_field('j', 'context.summary')}, ''), {_field('j', 'page_title')})"


@query(
    f"WITH {_HEAD} SELECT {_EVENT}, 'capture/' || concat_ws(':', run, event_index::VARCHAR) AS evidence_id, {_KIND} AS source_kind, {_field('j', 'page_url')} AS canonical_url, {_field('j', 'page_title')} AS title, {_TEXT_OF} AS text, "
    f"(len({_list('media')}) > 0)::INTEGER AS has_media FROM h WHERE j IS NOT NULL"
)
def ingest_root_rows(spark, d):
    return ingest.root_rows(_parsed(spark, d)).select("event_id", "evidence_id", "source_kind", "canonical_url", "title", "text", "has_media")


@query(f"WITH {_HEAD} SELECT run AS collector_run_id, {_field('j', 'source_project')} AS source_project, {_field('j', 'capture_method')} AS capture_method, ({' + '.join(f'len({_list(k)})' for k in ingest.ARRAYS if k != 'search_result')})::BIGINT AS records_emitted FROM h WHERE j IS NOT NULL")
def ingest_collector_runs(spark, d):
    return ingest.collector_runs(_parsed(spark, d)).select("collector_run_id", "source_project", "capture_method", F.col("records_emitted").cast("long").alias("records_emitted"))


_DEEP = lambda *names: _field("x", *names, *[f"raw.{n}" for n in names])


@query(
    _items("media") + f", k AS (SELECT *, {_field('x', 'media_id', 'id', 'sha256', 'url', 'local_path')} AS key, {_DEEP('local_path', 'storage_path', 'path', 'artifact_path')} AS path FROM i), s AS (SELECT *, coalesce(nullif({_DEEP('sha256')}, ''), substring({_hash('key', 'path')}, 1, 32)) AS sha, coalesce(nullif({_DEEP('media_kind', 'kind', 'type')}, ''), 'image') AS role FROM k) "
    f"SELECT 'media_req_' || substring({_hash('key', 'sha', 'path')}, 1, 24) AS request_id, key AS evidence_id, sha AS artifact_sha256, path AS storage_path, CASE WHEN contains(lower(role), 'screenshot') THEN 'screenshot_full_page' ELSE role END AS artifact_role, unnest(['osint.media.enrichment.requested.v1', 'osint.media.ocr.requested.v1', 'osint.media.vl_embedding.requested.v1']) AS target_topic FROM s"
)
def ingest_media_requests(spark, d):
    m = ingest.media_requests(ingest.project_media(_parsed(spark, d)))
    return m.select("request_id", "evidence_id", "artifact_sha256", "storage_path", "artifact_role", "target_topic")


@query()
def ingest_shadow(spark, d):
    return ingest.shadow_envelope(ingest.project_all(_parsed(spark, d)))


@query()
def ingest_media_shadow(spark, d):
    return ingest.media_shadow_envelope(ingest.media_requests(ingest.project_media(_parsed(spark, d))))


# ------------------------------------------------------------------ labels

_LOOK = "lower(concat_ws(' ', trim(coalesce(text, ''), {ws}), trim(coalesce(title, ''), {ws}), trim(coalesce(canonical_url, ''), {ws})))".format(ws=_WS)
_ACT = "lower(concat_ws(' ', trim(coalesce(source_kind, ''), {ws}), trim(coalesce(title, ''), {ws}), trim(coalesce(text, ''), {ws}), array_to_string(coalesce(topics, []), ' ')))".format(ws=_WS)


def _any(hay: str, needles) -> str:
    return "(" + " OR ".join(f"contains({hay}, '{n}')" for n in needles) + ")"


_ROWS = f"h AS (SELECT *, {_LOOK} AS look, {_ACT} AS act FROM evidence_events)"
_SLUG = "trim(regexp_replace(lower(trim({x}, {ws})), '[^a-z0-9]+', '_', 'g'), '_')"


@query(
    f"WITH {_ROWS} SELECT event_id, evidence_id, coalesce(text, '') <> '' OR coalesce(title, '') <> '' AS is_text, coalesce(has_media = 1, false) OR {_any('look', labels.IMAGE)} AS is_image, {_any('look', labels.VIDEO)} AS is_video, contains(look, '.pdf') AS is_pdf, {_any('look', labels.TABLE)} AS is_table, {_any('look', labels.CODE)} AS is_code FROM h"
)
def modality_labels(spark, d):
    e = labels.with_haystacks(ev(spark, d)).select("event_id", "evidence_id", labels.modality_labels().alias("m"))
    return e.select("event_id", "evidence_id", *[F.array_contains("m", f"modality.{k}").alias(f"is_{k}") for k in ("text", "image", "video", "pdf", "table", "code")])


@query(f"WITH {_ROWS} SELECT event_id, evidence_id, {_any('act', labels.COMPARE)} AS compare, {_any('act', labels.VERIFY)} AS verify, coalesce(source_kind = 'search_result', false) OR coalesce(len(links), 0) > 0 AS collect_more, coalesce(source_kind = 'user_input', false) AS review FROM h")
def action_labels(spark, d):
    e = labels.with_haystacks(ev(spark, d)).select("event_id", "evidence_id", labels.action_labels().alias("a"))
    return e.select("event_id", "evidence_id", *[F.array_contains("a", f"action.{k}").alias(k) for k in ("compare", "verify", "collect_more", "review")])


def _annotated(spark, d):
    return labels.annotation_ids(labels.annotate(ev(spark, d)))


_INPUT = "sha256(coalesce(raw_json, '') || chr(0))"


@query(
    f"""WITH t AS (SELECT event_id, evidence_id, {_INPUT} AS input_hash, unnest(list_distinct(list_filter(list_transform(coalesce(topics, []), lambda x: trim(x, {_WS})), lambda x: x <> ''))) AS topic FROM evidence_events), l AS (SELECT *, 'topic.' || {_SLUG.format(x="topic", ws=_WS)} AS label_id, to_json({{'topic_text': topic}})::VARCHAR AS value_json FROM t)
    SELECT event_id, evidence_id, label_id, 'proposed' AS status, 0.72::DOUBLE AS confidence, value_json, 'ann_' || substring({_hash("evidence_id", "'topic'", "label_id", "value_json", "input_hash")}, 1, 24) AS annotation_id, 'act_' || substring({_hash("'semantic'", "event_id", "evidence_id", "input_hash")}, 1, 24) AS activity_id FROM l WHERE label_id <> 'topic.'"""
)
def topic_annotations(spark, d):
    a = _annotated(spark, d).where("family = 'topic'")
    return a.select("event_id", "evidence_id", "label_id", "status", "confidence", "value_json", "annotation_id", "activity_id")


@query()
def annotations(spark, d):
    return _annotated(spark, d).dropDuplicates(["annotation_id"])


@query()
def annotation_states(spark, d):
    return labels.label_states(_annotated(spark, d))


@query()
def annotations_again(spark, d):
    """Re-labelling of every id's latest row with the wider profile."""
    from gleanery.operators import analytics as A

    latest = A.latest_by(ev(spark, d), ["evidence_id"], ["captured_at", "event_id"])
    return labels.annotation_ids(labels.annotate(latest, again=True), "semantic_backfill")


_FAMILIES = f"""WITH {_ROWS}, n AS (SELECT (coalesce(source_kind, '') <> '')::INT AS source, (coalesce(text, '') <> '' OR coalesce(title, '') <> '')::INT + (coalesce(has_media = 1, false) OR {_any('look', labels.IMAGE)})::INT + {_any('look', labels.VIDEO)}::INT + contains(look, '.pdf')::INT + {_any('look', labels.TABLE)}::INT + {_any('look', labels.CODE)}::INT AS modality,
    len(list_filter(list_distinct(list_transform(coalesce(entities, []), lambda x: trim(x, {_WS}))), lambda x: x <> '')) AS entity, {_any('act', labels.COMPARE)}::INT + {_any('act', labels.VERIFY)}::INT + (coalesce(source_kind = 'search_result', false) OR coalesce(len(links), 0) > 0)::INT + coalesce(source_kind = 'user_input', false)::INT AS actionability,
    coalesce(has_ocr = 1, false)::INT + (trim(coalesce(canonical_url, ''), {_WS}) <> '' AND coalesce(source_kind = 'web_page', false))::INT + coalesce(source_kind = 'user_input', false)::INT AS evidence_quality FROM h)
    SELECT family, n FROM (SELECT sum(source)::BIGINT AS source, sum(modality)::BIGINT AS modality, count(*) AS content_form, sum(entity)::BIGINT AS entity, sum(evidence_quality)::BIGINT AS evidence_quality, sum(actionability)::BIGINT AS actionability FROM n) UNPIVOT (n FOR family IN (source, modality, content_form, entity, evidence_quality, actionability))"""


@query(_FAMILIES)
def annotation_families(spark, d):
    a = labels.annotate(ev(spark, d)).where("family <> 'topic'")
    return a.groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query()
def annotation_totals(spark, d):
    a = labels.annotate(ev(spark, d))
    return a.groupBy("family", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 3).alias("confidence"))


# ------------------------------------------------------------------ plans

_ORDER = ("ingested_at", "event_id")


def _planned(spark, d):
    return labels.plan(ev(spark, d), _annotated(spark, d), _ORDER)


_PLAN = f"""WITH {_ROWS}, e AS (SELECT evidence_id, bool_or(coalesce(source_kind = 'user_input', false)) AS u, bool_or({_any('act', labels.COMPARE)}) AS c, bool_or({_any('act', labels.VERIFY)}) AS v, bool_or(coalesce(source_kind = 'search_result', false) OR coalesce(len(links), 0) > 0) AS m,
    bool_or(trim(coalesce(canonical_url, ''), {_WS}) <> '' AND coalesce(source_kind = 'web_page', false)) AS direct,
    min(list_filter(list_transform(coalesce(topics, []), lambda x: {_SLUG.format(x='x', ws=_WS)}), lambda x: x <> '')[1]) AS topic,
    arg_max({{'k': source_kind, 't': title, 'x': text, 'u': canonical_url}}, (ingested_at, event_id)) AS r FROM h GROUP BY 1),
    p AS (SELECT *, CASE WHEN u THEN 'user_seed' WHEN c THEN 'comparison_opportunity' WHEN v THEN 'verification_needed' WHEN m THEN 'source_expansion' END AS signal_type FROM e),
    q AS (SELECT *, 'deterministic_research_planner:0.1.0:' || signal_type || ':' || evidence_id AS dedupe_key, coalesce('topic.' || topic, 'topic.uncategorized') AS topic_label_id, CASE WHEN direct OR r.k IN ('web_page', 'x_post', 'x_account') THEN 0.75 WHEN r.k = 'search_result' THEN 0.45 WHEN u THEN 0.65 ELSE 0.55 END::DOUBLE AS source_strength,
    substring(coalesce(nullif(trim(r.t, {_WS}), ''), nullif(trim(substring(r.x, 1, 800), {_WS}), ''), nullif(trim(r.u, {_WS}), ''), trim(evidence_id, {_WS})), 1, 140) AS shown FROM p WHERE signal_type IS NOT NULL)"""


def _sql_case(values: dict[str, str]) -> str:
    return "CASE signal_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


@query(_PLAN + f" SELECT 'sig_' || substring({_hash('dedupe_key')}, 1, 24) AS signal_id, evidence_id, signal_type, topic_label_id, source_strength AS source_strength_score, " + _sql_case({s[1]: f"{s[6][4]}::DOUBLE" for s in labels.SIGNALS}) + " AS impact_score, " + _sql_case({s[1]: f"{s[6][3]}::DOUBLE" for s in labels.SIGNALS}) + " AS novelty_score FROM q")
def planner_signals(spark, d):
    s = labels.signals(_planned(spark, d))
    return s.select("signal_id", F.col("evidence_ids")[0].alias("evidence_id"), "signal_type", "topic_label_id", "source_strength_score", "impact_score", "novelty_score")


@query(_PLAN + f" SELECT 'q_' || substring({_hash('dedupe_key')}, 1, 24) AS question_id, evidence_id, " + _sql_case({s[1]: "'" + s[4].replace("{}", "' || shown || '") + "'" for s in labels.SIGNALS}) + " AS question_text, " + _sql_case({s[1]: f"'{s[2]}'" for s in labels.SIGNALS}) + " AS question_type, " + _sql_case({s[1]: f"{s[6][0]}::DOUBLE" for s in labels.SIGNALS}) + " AS priority FROM q")
def planner_questions(spark, d):
    return labels.questions(_planned(spark, d)).select("question_id", F.col("seed_evidence_ids")[0].alias("evidence_id"), "question_text", "question_type", "priority")


@query(_PLAN + f" SELECT 'task_' || substring({_hash('dedupe_key')}, 1, 24) AS task_id, dedupe_key, " + _sql_case({s[1]: f"'{s[3]}'" for s in labels.SIGNALS}) + " AS task_type, CASE WHEN r.k = 'search_result' THEN 'open_search_result,' ELSE '' END || " + _sql_case({s[1]: f"'{','.join(s[7])}'" for s in labels.SIGNALS}) + " AS actions FROM q")
def planner_tasks(spark, d):
    t = labels.tasks(_planned(spark, d))
    actions = F.array_join(F.from_json(F.get_json_object("task_payload_json", "$.suggested_actions"), "array<string>"), ",")
    return t.select("task_id", "dedupe_key", "task_type", actions.alias("actions"))


@query(_PLAN + f" SELECT 'sig_' || substring({_hash('dedupe_key')}, 1, 24) AS signal_id FROM q WHERE evidence_id NOT IN (SELECT evidence_id FROM evidence_latest WHERE evidence_id IS NOT NULL)")
def planner_new_signals(spark, d):
    """Signals that are not stored yet; what is stored are those of the ids in evidence_latest."""
    made = labels.signals(_planned(spark, d)).withColumn("evidence_id", F.col("evidence_ids")[0])
    stored = made.join(table(spark, d, "evidence_latest").select("evidence_id").distinct(), "evidence_id", "left_semi")
    return labels.only_new(made, stored, "signal_id").select("signal_id")


@query("""SELECT evidence_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list(coalesce(topics, []))), lambda x: trim(x)), lambda x: x <> ''))), '|') AS topics, substring(arg_max({'t': text}, (ingested_at, event_id)).t, 1, 800) AS text_preview FROM evidence_events GROUP BY 1""")
def planner_evidence(spark, d):
    e = labels.planner_evidence(ev(spark, d), _ORDER)
    return e.select("evidence_id", F.array_join("topics", "|").alias("topics"), "text_preview")


@query()
def capture_times(spark, d):
    p = _parsed(spark, d)
    return p.select("kafka_partition", "kafka_offset", S.time_text(F.col("captured_at"), F.lit("")).alias("captured_at"), S.day_text(F.col("captured_at")).alias("day"), S.date_precision(F.col("captured_at")).alias("precision"))
