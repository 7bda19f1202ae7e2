"""Enrichment of media and the rows around it: requests, limits, recognition results, failures, re-captures, model and run rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import scalars as S
from gleanery.operators.ingest import MEDIA_LIMITS

#: Vectors and point keys by kind of source (fixed values).
POINT_PREFIX = {"x_account": "account/", "media": "media/"}


def point_key(kind: Column, evidence: Column, handle: Column | None = None) -> Column:
    """Under which key a source's vectors are stored."""
    named = F.coalesce(F.nullif(handle, F.lit("")), evidence) if handle is not None else evidence
    return F.when(kind == "x_account", F.concat(F.lit(POINT_PREFIX["x_account"]), named)).when(kind == "media", F.concat(F.lit(POINT_PREFIX["media"]), evidence)).otherwise(evidence)


def vector_name(kind: Column, has_ocr: Column) -> Column:
    """Which vector a stored row's text belongs to."""
    return F.when(kind == "x_account", "account_dense").when((kind == "media") & (F.coalesce(has_ocr, F.lit(0)) == 1), "ocr_dense").when(kind == "media", "caption_dense").otherwise("text_dense")


def vector_inputs(observed: DataFrame, most: int = 4000) -> DataFrame:
    """``evidence_id, point_key, source_kind, day, vector_name, text`` of observed events of all six kinds.

    Media give recognised text and caption, if these differ; search results title and snippet together. Empty texts
    give none.
    """
    k = F.col("source_kind")
    body = S.truncate(S.text(F.when(k == "search_result", F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("text", F.lit("")))).otherwise(F.col("text"))), most)
    caption = S.truncate(S.text(F.col("title")), most)
    name = F.when(k == "x_account", "account_dense").when(k == "media", "ocr_dense").otherwise("text_dense")
    made = F.array(F.struct(name.alias("vector_name"), body.alias("text")), F.struct(F.lit("caption_dense").alias("vector_name"), F.when((k == "media") & (caption != body), caption).otherwise(F.lit("")).alias("text")))
    rows = observed.select("evidence_id", point_key(k, F.col("evidence_id"), F.col("author_handle")).alias("point_key"), "source_kind", F.substring("captured_at", 1, 10).alias("day"), F.inline(made))
    return rows.where(F.col("text") != "")


def with_limits(requests: DataFrame, limits: dict[str, int] = MEDIA_LIMITS) -> DataFrame:
    """Requests with ``skip``: why a medium is too large to be worked on, null where it is not."""
    pixels = F.col("width").cast("long") * F.col("height").cast("long")
    return requests.withColumn("skip", F.when(F.col("byte_size") > limits["max_bytes"], "too many bytes").when(pixels > limits["max_pixels"], "too many pixels"))


def open_requests(requests: DataFrame, results: DataFrame, sha: str = "artifact_sha256", params: str = "params_hash", done: str = "ok") -> DataFrame:
    """Requests whose content was not finished yet with the same parameters."""
    of = results.where(F.col("status") == done).select(F.col("source_sha256").alias(sha), F.col("params_hash").alias(params)).distinct()
    return requests.join(of, [sha, params], "left_anti")


def recognition_rows(outputs: DataFrame, engine: str = "paddleocr") -> DataFrame:
    """Result rows of recognition outputs: ids, sizes and confidences from blocks, or the failure.

    ``outputs`` has evidence_id, artifact_sha256, params_hash, text, blocks (array of struct with text and
    confidence) and error. A text that lacks is made of the blocks' texts by line.
    """
    conf = F.transform(F.coalesce("blocks", F.array()), lambda b: F.coalesce(b["confidence"].cast("double"), F.lit(0.0)))
    joined = F.array_join(F.transform("blocks", lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    text = F.coalesce(F.nullif(S.text(F.col("text")), F.lit("")), joined, F.lit(""))
    failed = S.text(F.col("error")) != ""
    n = F.size(conf)
    mean = F.when(n > 0, F.aggregate(conf, F.lit(0.0), lambda s, x: s + x) / n).otherwise(F.lit(0.0))
    return outputs.select(
        F.concat(F.lit("ocr_"), F.substring(S.stable_hash(F.col("artifact_sha256"), F.lit(engine), F.col("params_hash")), 1, 24)).alias("ocr_id"),
        "evidence_id", "artifact_sha256", "params_hash", F.lit(engine).alias("engine"), F.when(failed, "failed").otherwise("completed").alias("status"), F.coalesce("error", F.lit("")).alias("error_message"),
        F.when(failed, "").otherwise(text).alias("text"), F.when(failed, 0).otherwise(F.char_length(text)).cast("long").alias("text_chars"), F.when(failed, 0).otherwise(n).cast("long").alias("block_count"),
        F.when(failed, 0.0).otherwise(mean).alias("mean_confidence"), F.when(failed | (n == 0), 0.0).otherwise(F.array_min(conf)).alias("min_confidence"),
    )


def recapture_events(results: DataFrame, project: str = "media-enrichment") -> DataFrame:
    """Capture events of finished recognitions, so that their text enters as an observation of the medium."""
    media = F.array(F.struct(F.col("evidence_id").alias("media_id"), F.lit("image").alias("media_kind"), F.col("artifact_sha256").alias("sha256"), F.col("text").alias("ocr_text")))
    value = F.struct(F.lit("v1").alias("schema_version"), F.concat(F.lit("media_ocr_"), "ocr_id").alias("collector_run_id"), F.lit(0).alias("event_index"), F.lit(project).alias("source_project"), F.lit("media_ocr_worker").alias("capture_method"), media.alias("media"), F.struct(F.col("evidence_id").alias("derived_from_evidence_id"), "ocr_id").alias("context"))
    return results.where("status = 'completed'").select(F.coalesce(F.nullif("evidence_id", F.lit("")), F.col("ocr_id")).alias("key"), F.to_json(value).alias("value"))


def failure_events(failed: DataFrame, request: str, error: str, producer: str) -> DataFrame:
    """Failure events with the whole request and what went wrong."""
    value = F.struct(F.lit("v1").alias("schema_version"), F.lit(producer).alias("producer"), F.col(request).alias("request"), F.col(error).alias("error"))
    return failed.where(S.text(F.col(error)) != "").select(F.substring(S.stable_hash(F.col(request), F.col(error)), 1, 24).alias("key"), F.to_json(value).alias("value"))


def web_requests(raw: DataFrame, column: str = "raw_value") -> DataFrame:
    """Requests to extract pages: fields with their defaults; ``error`` for records without an address."""
    f = S.text_fields(F.col(column))
    rows = raw.withColumn("f", f)
    field = lambda *names, default="": F.coalesce(F.nullif(S.first_field(F.col("f"), *names), F.lit("")), F.lit(default))
    return rows.select(
        field("url", "canonical_url", "href").alias("url"), field("source_project", "project", default="web-extraction").alias("source_project"), field("collector_run_id", "run_id").alias("collector_run_id"),
        S.first_int(F.col("f")["event_index"]).alias("event_index"), F.when(field("url", "canonical_url", "href") == "", "url is required").alias("error"),
    )


#: Which fields make the key of a topic's messages, tried in order (fixed lists); others are keyed by their hash.
MESSAGE_KEYS = {
    "evidence.web.documents.observed.v1": ("evidence_id", "document_id", "canonical_url"),
    "evidence.user.inputs.observed.v1": ("evidence_id", "input_id", "note_id"),
}


def message_key(topic: Column, value: Column) -> Column:
    """The key that a message of a topic gets, from its JSON text."""
    whole = F.sha2(S.canonical_json(value), 256)
    own = lambda *paths: F.nullif(S.json_text(value, *[f"$.{p}" for p in paths]), F.lit(""))
    observation = F.coalesce(own("observation_id"), F.substring(whole, 1, 16))
    out = (
        F.when(topic == "evidence.capture.events.v1", F.concat_ws(":", F.coalesce(own("collector_run_id"), F.lit("unknown")), F.coalesce(own("event_index"), F.lit("0"))))
        .when(topic == "evidence.posts.observed.v1", F.concat_ws(":", F.coalesce(own("post_id"), F.lit("unknown")), observation))
        .when(topic == "evidence.accounts.observed.v1", F.concat_ws(":", F.lower(F.coalesce(own("normalized_handle", "handle"), F.lit("unknown"))), observation))
        .when(topic == "evidence.media.observed.v1", F.concat_ws(":", F.coalesce(own("media_id", "sha256"), whole), observation))
        .when(topic == "evidence.search.results.v1", F.sha2(F.concat_ws("\n", *[F.coalesce(own(n), F.lit("")) for n in ("query", "url", "searched_at")]), 256))
    )
    for name, fields in MESSAGE_KEYS.items():
        out = out.when(topic == name, F.coalesce(own(*fields), S.canonical_json(value)))
    state = F.coalesce(own("post_id", "normalized_handle", "media_id", "document_id", "input_id", "sha256"), F.lit("None"))
    return out.when(topic.endswith(".state.v1"), state).otherwise(whole)


#: Names shown for kinds of sources (fixed values).
KIND_LABELS = {"x_post": "X post", "x_account": "X account", "x_page": "X page", "web_page": "Web/blog", "search_result": "Search result", "google_search_page": "Google SERP", "media": "Media", "user_input": "Manual doc", "capture": "Capture"}


def kind_label(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in KIND_LABELS.items() for x in kv])
    k = F.coalesce(c, F.lit(""))
    return F.coalesce(F.try_element_at(table, k), F.nullif(k, F.lit("")), F.lit("unknown"))


def enveloped(rows: DataFrame, version: str, as_of: Column, stale: bool = False, permissions: tuple[str, ...] = ("navigate",)) -> DataFrame:
    """Rows stamped with version, time, staleness and what may be done with them."""
    return rows.withColumns({"version": F.lit(version), "generated_at": as_of, "stale": F.lit(stale), "permissions": F.array(*[F.lit(p) for p in permissions])})


def model_inventory(catalogue: DataFrame, health: DataFrame) -> DataFrame:
    """Models of a catalogue (model, installed) with what their health says (model, loaded): loaded, available or missing."""
    out = catalogue.join(health.groupBy("model").agg(F.max("loaded").alias("loaded")), "model", "left")
    status = F.when(F.coalesce("loaded", F.lit(False)), "loaded").when(F.col("installed"), "available").otherwise("missing")
    return out.select("model", status.alias("status"), (status != "missing").alias("usable"))


def run_steps(runs: DataFrame, steps: str = "details_json") -> DataFrame:
    """``run_id, step_no, step_name, ok, duration_ms, error_message`` of the steps that runs' details list."""
    kind = "struct<steps: array<struct<name: string, ok: boolean, duration_ms: long, error_message: string>>>"
    rows = runs.select("run_id", F.posexplode(F.from_json(F.col(steps), kind)["steps"]).alias("step_no", "s"))
    return rows.select("run_id", "step_no", F.col("s.name").alias("step_name"), F.coalesce(F.col("s.ok").cast("int"), F.lit(0)).alias("ok"), F.coalesce("s.duration_ms", F.lit(0).cast("long")).alias("duration_ms"), F.coalesce("s.error_message", F.lit("")).alias("error_message"))


def launch_events(requests: DataFrame) -> DataFrame:
    """The two events of each capture launch: asked for, and what came of it.

    ``requests`` has seed_url, source_id, project, actor, created_at and the helper's ``response`` (JSON text, null while
    open); sessions are named by any of its aliases.
    """
    subject = F.coalesce(F.nullif("source_id", F.lit("")), F.col("seed_url"))
    session = S.json_text(F.col("response"), "$.session.session_id", "$.session_id", "$.session.id", "$.id")
    failed = S.json_text(F.col("response"), "$.error", "$.message")
    ended = F.when(failed != "", "capture.launch_failed").when(session != "", "capture.committed").otherwise("capture.launch_result")
    pair = F.array(F.struct(F.lit("capture.launch_requested").alias("event_type"), F.lit("").alias("session_id"), F.lit("").alias("error")), F.when(F.col("response").isNotNull(), F.struct(ended.alias("event_type"), session.alias("session_id"), F.substring(failed, 1, 300).alias("error"))))
    rows = requests.select(subject.alias("subject_id"), "project", "actor", "created_at", F.inline(F.array_compact(pair)))
    return rows.withColumn("event_id", S.short_id("evt", F.col("event_type"), F.col("subject_id"), F.col("created_at").cast("string")))
