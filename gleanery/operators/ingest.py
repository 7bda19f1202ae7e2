"""Ingest: parse, validate, route and project capture events; failures become error envelopes.

Batch and streaming share these functions. A record is parsed once to VARIANT; the objects of all six arrays come out
of one ``inline`` with kind, index and JSON text, each is parsed once, and one projection picks the columns of its kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import scalars as S

#: Fields that an event must have, in the order in which errors name them (fixed list).
REQUIRED = ("schema_version", "collector_run_id", "event_index", "source_project", "capture_method", "captured_at")
#: Kind, and where its array is looked for: in the record first, then in its context (fixed lists).
ARRAYS = {
    "x_post": (("posts",), False),
    "x_account": (("accounts",), False),
    "media": (("media",), False),
    "search_result": (("search_results", "results"), True),
    "web_page": (("web_documents", "documents", "pages", "web_pages", "articles"), True),
    "user_input": (("user_inputs", "user_notes", "notes", "research_notes", "manual_inputs"), True),
}
#: Topics of observed events, of the shadow run, and of media requests (fixed values).
TOPICS = {
    "x_post": "evidence.posts.observed.v1",
    "x_account": "evidence.accounts.observed.v1",
    "media": "evidence.media.observed.v1",
    "search_result": "evidence.search.results.v1",
    "web_page": "evidence.web.documents.observed.v1",
    "user_input": "evidence.user.inputs.observed.v1",
}
SHADOW_TOPICS = {
    "validated": "evidence.capture.shadow.validated.v1",
    "observed": "evidence.capture.shadow.observed.v1",
    "media": "osint.media.enrichment.shadow.requested.v1",
    "errors": "evidence.capture.shadow.errors.v1",
}
MEDIA_TOPICS = ("osint.media.enrichment.requested.v1", "osint.media.ocr.requested.v1", "osint.media.vl_embedding.requested.v1")
#: Limits of media enrichment that enter the hash of its parameters (fixed values).
MEDIA_LIMITS = {"max_bytes": 25 * 1024 * 1024, "max_pixels": 40_000_000, "vl_max_side": 1600}
#: Flags of a capture's quality; all but the last challenge the capture (fixed list).
FLAGS = ("challenge", "captcha", "rate_limited", "login_prompt_visible", "partial")
LISTS = ("topics", "entities", "links", "urls", "website_urls")
COUNTED = ("posts", "accounts", "media", "search_results", "web_documents", "user_inputs")


def _objects(doc: Column, name: str) -> Column:
    """The objects of an array field as JSON texts; null where the field is no array."""
    return F.filter(F.try_variant_get(doc, f"$.{name}", "array<string>"), lambda x: x.startswith("{"))


def _first_list(doc: Column, names: tuple[str, ...], in_context: bool) -> Column:
    places = [_objects(doc, n) for n in names]
    if in_context:
        places += [_objects(doc, f"context.{n}") for n in names]
    return F.coalesce(*[F.when(F.size(p) > 0, p) for p in places])


def parse(records: DataFrame, raw: str = "raw_value") -> DataFrame:
    """The records with ``doc`` (VARIANT, null for damaged JSON) and the envelope's fields."""
    out = records.withColumn("doc", F.when(F.col(raw).rlike(r"^\s*\{"), F.try_parse_json(F.col(raw))))
    d = F.col("doc")
    index = F.col("fields")["event_index"]
    out = out.withColumn("fields", F.when(d.isNotNull(), S.text_fields(F.col(raw))))
    return out.select(
        "*",
        F.coalesce(F.col("fields")["schema_version"], F.lit("v1")).alias("schema_version"),
        *[S.first_field(F.col("fields"), n).alias(n) for n in ("collector_run_id", "source_project", "capture_method", "captured_at", "page_url", "page_title")],
        index.try_cast("bigint").alias("event_index"),
        F.get_json_object(F.col(raw), "$.quality").alias("quality"),
        S.text_fields(F.get_json_object(F.col(raw), "$.context")).alias("context"),
    )


def validate(parsed: DataFrame) -> DataFrame:
    """Adds ``error``: null for a valid event, else what is wrong with it.

    The version is looked for in the record itself, as its default is given only later. The last error is that of an
    event whose arrays hold something, but no object: it would project to nothing.
    """
    given = {n: F.col(n) for n in REQUIRED} | {"schema_version": S.first_field(F.col("fields"), "schema_version")}
    missing = F.filter(
        F.array(*[F.when(c.isNull() if n == "event_index" else c == "", F.lit(n)) for n, c in given.items()]),
        lambda x: x.isNotNull(),
    )
    n = reduce(lambda a, b: a + b, [F.coalesce(F.size(F.try_variant_get(F.col("doc"), f"$.{a}", "array<variant>")), F.lit(0)) for a in COUNTED])
    error = (
        F.when(F.col("doc").isNull(), "invalid json")
        .when(F.size(missing) > 0, F.concat(F.lit("missing required fields: "), F.array_join(missing, ", ")))
        .when(F.col("event_index") < 0, "event_index must be >= 0")
        .when(n == 0, "capture event contains no evidence arrays")
        .when(reduce(lambda a, b: a + b, [F.coalesce(F.size(_first_list(F.col("doc"), names, ctx)), F.lit(0)) for names, ctx in ARRAYS.values()]) == 0, "capture event produced no observed records")
    )
    return parsed.withColumn("error", error)


def source_kinds(parsed: DataFrame) -> DataFrame:
    """Adds ``kind_counts`` (map of kinds with records, else of the capture's own kind), ``kinds`` and ``primary_kind``."""
    d = F.col("doc")
    counts = F.create_map(*[x for k, (names, ctx) in ARRAYS.items() for x in (F.lit(k), F.coalesce(F.size(_first_list(d, names, ctx)), F.lit(0)))])
    present = F.map_filter(counts, lambda k, v: v > 0)
    out = parsed.withColumn("kind_counts", F.when(F.cardinality(present) > 0, present).otherwise(F.create_map(S.capture_kind(F.col("page_url")), F.lit(1))))
    order = F.array(*[F.lit(k) for k in (*ARRAYS, "capture", "x_page", "google_search_page")])
    kinds = F.filter(order, lambda k: F.map_contains_key(F.col("kind_counts"), k))
    return out.withColumn("kinds", kinds).withColumn("primary_kind", F.try_element_at("kinds", F.lit(1))).withColumn("n_records", F.aggregate(F.map_values("kind_counts"), F.lit(0), lambda s, x: s + x))


# ------------------------------------------------------------------ projections


def quality_flags(quality: Column) -> Column:
    """The set flags of a quality object's JSON text, in their fixed order."""
    return F.filter(F.array(*[F.when(S.boolish_or_number(F.get_json_object(quality, f"$.{n}")), F.lit(n)) for n in FLAGS]), lambda x: x.isNotNull())


def challenged(quality: Column) -> Column:
    """Whether a quality object tells a challenge, captcha, rate limit or login prompt."""
    return F.exists(quality_flags(quality), lambda x: x != FLAGS[-1])


def _t(*names: str) -> Column:
    return S.first_field(F.col("f"), *names)


def _ctx(*names: str) -> Column:
    return S.first_field(F.col("context"), *names)


def _raw(*names: str) -> Column:
    return F.coalesce(*[F.col("raw_fields")[n] for n in names])


def _tagged(kind: str):
    return lambda x, i: F.struct(F.lit(kind).alias("source_kind"), i.alias("idx"), x.alias("j"))


def _items(parsed: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The objects of the kinds' arrays, one row each: kind, index, JSON text, all fields as texts, scalars cleaned."""
    none = F.array().cast("array<string>")
    lists = [F.transform(F.coalesce(_first_list(F.col("doc"), *ARRAYS[k]), none), _tagged(k)) for k in kinds]
    items = parsed.where(F.col("doc").isNotNull()).select("*", F.inline(F.concat(*lists)))
    items = items.withColumn("raw_fields", F.from_json("j", "map<string,string>"))
    return items.withColumn("f", S.scalar_fields(F.col("raw_fields")))


def _links() -> Column:
    """Links of an object: its list fields, then its own addresses that are absolute."""
    lists = [S.list_field(F.col("raw_fields")[n]) for n in ("links", "urls", "website_urls")]
    own = S.http_only(F.array(*[_t(n) for n in ("url", "href", "link", "website_url")]))
    return S.clean_list(F.concat(*lists, own))


def _or_hash(ident: Column, n: int, *parts: Column) -> Column:
    return F.when(ident != "", ident).otherwise(F.substring(S.stable_hash(*parts), 1, n))


_RUN = ("collector_run_id", "event_index")


def _post_key() -> dict[str, Column]:
    url, given = _t("canonical_url", "url", "href"), _t("post_id", "id", "tweet_id", "status_id")
    author = S.handle(S.first_text(_t("author_handle", "handle", "screen_name", "username"), F.when(given == "", S.status_handle(url))))
    ident = S.first_text(given, S.status_id(url))
    link = F.when((url == "") & (ident != "") & (author != ""), F.concat(F.lit("https://x.com/"), author, F.lit("/status/"), ident)).otherwise(url)
    return {"__key": _or_hash(ident, 16, *map(F.col, _RUN), F.lit("post"), F.col("idx"), link, _t("text", "full_text", "content", "body")), "__url": link, "__author": author}


def _account_key() -> dict[str, Column]:
    ident = S.handle(_t("handle", "author_handle", "screen_name", "username"))
    return {"__key": _or_hash(ident, 16, *map(F.col, _RUN), F.lit("account"), F.col("idx"), S.canonical_json(F.col("j"))), "__url": _t("profile_url", "url"), "__author": F.col("__key")}


def _media_key() -> dict[str, Column]:
    ident = _t("media_id", "id", "sha256", "url", "local_path")
    return {"__key": _or_hash(ident, 32, *map(F.col, _RUN), F.lit("media"), F.col("idx"), S.canonical_json(F.col("j"))), "__url": _t("url", "src"), "__author": F.lit("")}


def _search_key() -> dict[str, Column]:
    url = _t("url", "href", "link")
    return {"__key": S.stable_hash(S.first_text(_t("query"), _ctx("query")), url, F.col("idx")), "__url": url, "__author": F.lit("")}


def _web_key() -> dict[str, Column]:
    url = _t("canonical_url", "url", "source_url", "page_url", "href", "link")
    key = _or_hash(_t("document_id", "id"), 24, url, _t("text_hash", "sha256"), _t("title"), _t("text", "content", "body", "markdown", "summary"), F.col("idx"))
    return {"__key": key, "__url": url, "__author": F.lit("")}


def _input_key() -> dict[str, Column]:
    key = _or_hash(_t("input_id", "note_id", "id"), 24, *map(F.col, _RUN), F.lit("user_input"), _t("text", "content", "note", "body", "markdown", "summary"), F.col("idx"))
    return {"__key": key, "__url": F.lit(""), "__author": _t("author", "user", "created_by")}


def _post() -> dict[str, Column]:
    return {"title": F.lit(""), "text": _t("text", "full_text", "content", "body"), "author_name": _t("author_name", "name", "display_name"), "posted_at": _t("posted_at", "created_at", "time", "timestamp"), "lang": _t("lang", "language"), "media_ids": S.list_field(_raw("media_ids", "media")), "quality": F.get_json_object("j", "$.quality")}


def _account() -> dict[str, Column]:
    return {"title": _t("display_name", "name", "author_name"), "text": _t("bio", "description", "text")}


def _media() -> dict[str, Column]:
    own = {"media_kind": _t("media_kind", "type", "kind"), "local_path": _t("local_path", "path"), "sha256": _t("sha256"), "ocr_text": _t("ocr_text"), "caption": _t("caption", "alt_text", "description")}
    return {"title": own["caption"], "text": own["ocr_text"], **own}


def _search() -> dict[str, Column]:
    rank = F.coalesce(*[F.col("f")[n].try_cast("double").cast("long") for n in ("rank", "position", "index")], F.col("idx").cast("long") + 1)
    engine = F.coalesce(F.nullif(S.first_text(_t("engine", "source"), _ctx("engine")), F.lit("")), F.lit("google"))
    return {"title": _t("title"), "text": _t("snippet", "description", "text"), "query": S.first_text(_t("query"), _ctx("query")), "engine": engine, "rank": rank, "canonical_post_id": S.status_id(F.col("__url")), "challenge": S.boolish_or_number(F.col("f")["challenge"]) | challenged(F.col("quality"))}


def _web() -> dict[str, Column]:
    return {
        "title": _t("title", "page_title", "headline"), "text": _t("text", "content", "body", "markdown", "summary", "extracted_text"), "posted_at": _t("published_at", "posted_at", "created_at", "date"),
        "document_kind": _t("document_kind", "kind", "content_form"), "content_type": _t("content_type", "mime_type"), "media_ids": S.list_field(_raw("media_ids", "media")), "artifact_paths": S.list_field(_raw("artifact_paths", "local_paths", "paths")), "tables": _raw("tables", "table_snapshots"), "quality": F.get_json_object("j", "$.quality"),
    }


def _input() -> dict[str, Column]:
    return {"title": _t("title", "subject", "heading"), "text": _t("text", "content", "note", "body", "markdown", "summary"), "input_kind": _t("input_kind", "kind", "type"), "attachments": _raw("attachments", "files"), "quality": F.get_json_object("j", "$.quality")}


#: Kind -> (identity columns, own columns, name in hashes, prefix of the evidence id, fields of an own capture time).
_KINDS = {
    "x_post": (_post_key, _post, "post", "", ()),
    "x_account": (_account_key, _account, "account", "", ()),
    "media": (_media_key, _media, "media", "", ()),
    "search_result": (_search_key, _search, None, "", ()),
    "web_page": (_web_key, _web, "web_document", "web_document/", ("captured_at", "retrieved_at", "extracted_at")),
    "user_input": (_input_key, _input, "user_input", "user_input/", ("captured_at", "created_at", "observed_at")),
}


def _by_kind(kinds: tuple[str, ...], columns: dict[str, Column | None]) -> Column:
    """The column of a row's own kind; null where the kind has none."""
    own = {k: c for k, c in columns.items() if c is not None}
    if len(kinds) == 1:
        return own[kinds[0]]
    return reduce(lambda w, k: w.when(F.col("source_kind") == k, own[k]), own, F)


def project(parsed: DataFrame, kinds: tuple[str, ...] = tuple(_KINDS)) -> DataFrame:
    """The observed events of the kinds, one row each; columns that no given kind has are left out.

    An array that lacks gives no rows. ``raw`` is the object's JSON text; captured and posted times in one layout.
    """
    rows = _items(parsed, kinds)
    keys = {k: _KINDS[k][0]() for k in kinds}
    rows = rows.withColumn("__key", _by_kind(kinds, {k: v["__key"] for k, v in keys.items()}))
    rows = rows.withColumns({n: _by_kind(kinds, {k: v[n] for k, v in keys.items()}) for n in ("__url", "__author")})
    key, kind = F.col("__key"), F.col("source_kind")
    evidence = _by_kind(kinds, {k: F.concat(F.lit(_KINDS[k][3]), key) for k in kinds})
    captured = _by_kind(kinds, {k: S.first_text(*([_t(*_KINDS[k][4])] if _KINDS[k][4] else []), F.col("captured_at")) for k in kinds})
    observation = _by_kind(kinds, {k: key if _KINDS[k][2] is None else S.stable_hash(*map(F.col, _RUN), F.lit(_KINDS[k][2]), key, F.col("idx")) for k in kinds})
    own = {k: _KINDS[k][1]() for k in kinds}
    names = list(dict.fromkeys(n for v in own.values() for n in v))
    made = {n: _by_kind(kinds, {k: own[k].get(n) for k in kinds}) for n in names}
    made["posted_at"] = S.time_text(F.coalesce(made.get("posted_at", F.lit("")), F.lit("")), F.lit(""))
    domain = F.when(kind == "web_page", S.first_text(_t("domain", "host"), S.host(F.col("__url")))).otherwise(S.host(F.col("__url")))
    base = {
        "source_kind": kind,
        "target_topic": F.element_at(F.create_map(*[F.lit(x) for kv in TOPICS.items() for x in kv]), kind),
        "target_key": evidence,
        "evidence_id": evidence,
        "event_id": F.concat_ws(":", "collector_run_id", F.col("event_index").cast("string")),
        "idx": F.col("idx"),
        "observation_id": observation,
        **{n: F.col(n) for n in ("collector_run_id", "event_index", "source_project", "capture_method")},
        "captured_at": S.time_text(captured, F.lit("")),
        "canonical_url": F.col("__url"),
        "author_handle": F.col("__author"),
        "domain": domain,
        **made,
        "topics": S.list_field(_raw("topics")),
        "entities": S.list_field(_raw("entities")),
        "links": _links(),
        "capture_quality": F.col("quality"),
        "raw": F.col("j"),
    }
    return rows.select(*[c.alias(n) for n, c in base.items()])


def project_posts(parsed: DataFrame) -> DataFrame:
    return project(parsed, ("x_post",))


def project_accounts(parsed: DataFrame) -> DataFrame:
    return project(parsed, ("x_account",))


def project_media(parsed: DataFrame) -> DataFrame:
    return project(parsed, ("media",))


def project_search_results(parsed: DataFrame) -> DataFrame:
    return project(parsed, ("search_result",))


def project_web_documents(parsed: DataFrame) -> DataFrame:
    return project(parsed, ("web_page",))


def project_user_inputs(parsed: DataFrame) -> DataFrame:
    return project(parsed, ("user_input",))


def project_all(parsed: DataFrame) -> DataFrame:
    """All observed events of all kinds, one row each, from one pass over the records."""
    return project(parsed)


def root_rows(parsed: DataFrame) -> DataFrame:
    """The capture's own evidence row, its text from context or page title."""
    ident = F.concat_ws(":", "collector_run_id", F.col("event_index").cast("string"))
    rows = parsed.where(F.col("doc").isNotNull()).withColumn("__fields", F.from_json(F.to_json("doc"), "map<string,string>"))
    raw = S.scalar_fields(F.col("__fields"))
    lists = {n: S.list_field(F.col("__fields")[n]) for n in ("topics", "entities", "links")}
    has_media = F.coalesce(F.size(_first_list(F.col("doc"), *ARRAYS["media"])), F.lit(0)) > 0
    media_text = F.exists(F.coalesce(_first_list(F.col("doc"), *ARRAYS["media"]), F.array().cast("array<string>")), lambda x: (S.json_text(x, "$.ocr_text") != "") | S.boolish_or_number(F.get_json_object(x, "$.has_ocr")))
    return rows.select(
        ident.alias("event_id"),
        F.concat(F.lit("capture/"), ident).alias("evidence_id"),
        S.capture_kind(F.col("page_url")).alias("source_kind"),
        F.col("page_url").alias("canonical_url"),
        F.lit("").alias("author_handle"),
        S.host(F.col("page_url")).alias("domain"),
        F.col("page_title").alias("title"),
        S.first_text(_ctx("query", "text", "summary"), F.col("page_title")).alias("text"),
        *[c.alias(n) for n, c in lists.items()],
        S.time_text(F.col("captured_at"), F.lit("")).alias("captured_at"),
        has_media.cast("int").alias("has_media"),
        (media_text | S.boolish_or_number(S.first_field(raw, "has_ocr"))).cast("int").alias("has_ocr"),
        F.col("quality").alias("capture_quality"),
    )


def collector_runs(parsed: DataFrame) -> DataFrame:
    """One row per event for its run; records emitted count five arrays, search results not."""
    d = F.col("doc")
    arrays = [_first_list(d, *ARRAYS[k]) for k in ARRAYS if k != "search_result"]
    emitted = reduce(lambda a, b: a + b, [F.coalesce(F.size(a), F.lit(0)) for a in arrays])
    return parsed.where(d.isNotNull()).select("collector_run_id", "source_project", "capture_method", "captured_at", emitted.alias("records_emitted"))


def media_params_hash(limits: dict[str, int] = MEDIA_LIMITS) -> Column:
    return F.substring(S.stable_hash(F.lit("media-v1"), *[F.lit(f"{k}={v}") for k, v in limits.items()]), 1, 16)


def media_requests(observed: DataFrame, topics: tuple[str, ...] = MEDIA_TOPICS, producer: str = "media_request_builder", version: str = "0.1.0") -> DataFrame:
    """Enrichment requests of observed media, one row for each target topic.

    Fields are looked for in the observed object, in its ``raw`` and in that one's; an unknown hash is made from evidence
    id and path, the media type from the path's ending, the role is ``image`` unless told.
    """
    m = observed.where(F.col("source_kind") == "media")
    deep = lambda *names: [f"$.{n}" for n in names] + [f"$.raw.{n}" for n in names]
    raw = F.col("raw")
    path = S.first_text(S.json_text(raw, *deep("local_path", "storage_path", "path", "artifact_path")), F.col("local_path"))
    m = m.withColumn("__path", path)
    sha = S.first_text(S.json_text(raw, *deep("sha256")), F.col("sha256"), F.substring(S.stable_hash(F.col("evidence_id"), F.col("__path")), 1, 32))
    m = m.withColumn("__sha", sha)
    role = S.first_text(F.col("media_kind"), S.json_text(raw, *deep("media_kind", "kind", "type")), F.lit("image"))
    number = lambda *names: F.coalesce(*[F.get_json_object(raw, p).try_cast("double").cast("bigint") for p in deep(*names)], F.lit(0).cast("bigint"))
    ident = S.short_id("media_req", F.col("evidence_id"), F.col("__sha"), F.col("__path"))
    return m.select(
        ident.alias("request_id"),
        ident.alias("trace_id"),
        "evidence_id",
        S.first_text(S.json_text(raw, *deep("media_id")), F.col("evidence_id")).alias("artifact_id"),
        F.col("__sha").alias("artifact_sha256"),
        "source_project",
        "capture_method",
        "collector_run_id",
        F.when(F.lower(role).contains("screenshot"), "screenshot_full_page").otherwise(role).alias("artifact_role"),
        S.first_text(S.json_text(raw, *deep("mime_type")), S.mime_of(F.col("__path"))).alias("media_type"),
        F.col("__path").alias("storage_path"),
        F.col("canonical_url").alias("source_uri"),
        "caption",
        "topics",
        number("width").alias("width"),
        number("height").alias("height"),
        number("byte_size", "bytes").alias("byte_size"),
        F.lit(producer).alias("producer_name"),
        F.lit(version).alias("producer_version"),
        media_params_hash().alias("params_hash"),
        F.explode(F.array(*[F.lit(t) for t in topics])).alias("target_topic"),
    )


#: Metadata that an error envelope names: envelope field -> columns tried in order (fixed lists).
ENVELOPE = {
    "original_topic": ("topic_name",),
    "original_partition": ("kafka_partition",),
    "original_offset": ("kafka_offset",),
    "original_key": ("kafka_key",),
    "trace_id": ("trace_id", "request_id", "correlation_id"),
    "source_kind_router": ("source_kind_router_kinds",),
    "source_kind_counts": ("source_kind_router_counts",),
    "failed_output_topic": ("shadow_output_topic",),
    "failed_output_key": ("shadow_output_key",),
    "failed_target_topic": ("target_topic",),
    "failed_target_key": ("target_key",),
    "failed_source_kind": ("source_kind",),
    "failed_evidence_id": ("evidence_id",),
}


def dead_letters(checked: DataFrame, raw: str = "raw_value", error_class: Column | str | None = None, pipeline: str = "capture", plugin: str = "dead_letters", version: str = "0.1.0", topic: str = SHADOW_TOPICS["errors"]) -> DataFrame:
    """Error envelopes of failed records with the whole payload, so that it can be replayed.

    Metadata that the table has no column for is empty. ``target_key`` is topic, partition and offset of the record. The
    class of an error is ``parse_error`` or ``validation_error`` unless one is given.
    """
    c = checked.where(F.col("error").isNotNull())
    cls = F.when(F.col("error") == "invalid json", "parse_error").otherwise("validation_error") if error_class is None else F.lit(error_class)
    known = {k: [F.col(n).cast("string") for n in names if n in checked.columns] for k, names in ENVELOPE.items()}
    meta = {k: S.first_text(*cols) if cols else F.lit("") for k, cols in known.items()}
    return c.select(
        F.lit("v1").alias("schema_version"),
        cls.alias("error_class"),
        F.col("error").alias("error_message"),
        F.lit(pipeline).alias("pipeline_name"),
        F.lit(plugin).alias("plugin_name"),
        F.lit(version).alias("plugin_version"),
        *[c.alias(k) for k, c in meta.items()],
        F.sha2(F.coalesce(F.col(raw), F.lit("")), 256).alias("payload_sha256"),
        F.col(raw).alias("raw"),
        F.lit(topic).alias("target_topic"),
        F.concat_ws("/", *[meta[k] for k in ("original_topic", "original_partition", "original_offset")]).alias("target_key"),
    )


def shadow_envelope(observed: DataFrame, name: str = "observed_event_projector", version: str = "0.1.0") -> DataFrame:
    """Observed events wrapped with routing metadata for the shadow topic."""
    keys = ("collector_run_id", "event_index", "target_topic", "target_key", "source_kind", "evidence_id")
    payload = F.to_json(F.struct(*[c for c in observed.columns if c not in ("target_topic", "target_key")])).alias("observed")
    return observed.select(F.lit("v1").alias("schema_version"), F.lit("observed_event_projection").alias("shadow_kind"), F.lit(name).alias("projector_name"), F.lit(version).alias("projector_version"), *keys, payload)


def media_shadow_envelope(requests: DataFrame, name: str = "media_request_builder", version: str = "0.1.0") -> DataFrame:
    """One envelope for each media request, whatever the number of its topics."""
    one = requests.drop("target_topic").distinct()
    payload = F.to_json(F.struct("*", F.lit(True).alias("shadow_only"), F.array(*[F.lit(t) for t in MEDIA_TOPICS]).alias("production_topics"))).alias("request")
    return one.select(F.lit("v1").alias("schema_version"), F.lit("media_enrichment_request").alias("shadow_kind"), F.lit(name).alias("builder_name"), F.lit(version).alias("builder_version"), F.array(*[F.lit(t) for t in MEDIA_TOPICS]).alias("target_topics"), F.col("artifact_id").alias("target_key"), F.lit(True).alias("shadow_only"), F.col("request_id").alias("request_event_id"), payload)
