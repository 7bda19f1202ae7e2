import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gleanery.functions.scalars import FRAMES  # noqa: F401
from gleanery.operators import ingest

BASE = {"schema_version": "v1", "collector_run_id": "run-1", "event_index": 2, "source_project": "p", "capture_method": "m", "captured_at": "2025-05-01T10:00:00Z"}


def stable(*parts):
    return hashlib.sha256(b"".join(p.encode() + b"\0" for p in parts)).hexdigest()


def frame(spark, *records):
    rows = [("t", 0, i, "k", json.dumps(r) if not isinstance(r, str) and r is not None else r) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "topic_name string, kafka_partition int, kafka_offset long, kafka_key string, raw_value string")


@pytest.mark.parametrize(
    ("record", "error"),
    [
        ({**BASE, "posts": [{"post_id": 1}]}, None),
        ({**BASE, "posts": []}, "capture event contains no evidence arrays"),
        ({**BASE, "event_index": -1, "posts": [{}]}, "event_index must be >= 0"),
        ({**BASE, "event_index": 12345678901, "posts": [{}]}, None),
        ({**BASE, "event_index": "7", "posts": [{}]}, None),
        ({**BASE, "event_index": 1.5, "posts": [{}]}, "missing required fields: event_index"),
        ({k: v for k, v in BASE.items() if k != "schema_version"} | {"posts": [{}]}, "missing required fields: schema_version"),
        ({**BASE, "posts": ["text", 3]}, "capture event produced no observed records"),
        ({"posts": [{}]}, "missing required fields: schema_version, collector_run_id, event_index, source_project, capture_method, captured_at"),
        ("{broken", "invalid json"),
        (None, "invalid json"),
        ("[1]", "invalid json"),
    ],
)
def test_validation(spark, record, error):
    assert ingest.validate(ingest.parse(frame(spark, record))).first()["error"] == error


def test_projections_with_aliases_and_fallback_ids(spark):
    record = {
        **BASE,
        "posts": [{"id": 77, "full_text": " hi ", "url": "https://x.com/Ann/status/77", "links": ["https://a.test", {"expanded_url": "https://b.test"}, "https://a.test"]}, {"text": "no id"}, None],
        "accounts": [{"handle": "@Bob", "bio": "b"}],
        "media": [{"media_id": "m1", "type": "photo", "alt_text": "c"}],
        "context": {"query": "q", "results": [{"link": "https://r.test/x", "position": 4}]},
        "articles": [{"id": "d1", "url": "https://www.site.test/p", "headline": "H", "content": "body"}],
        "notes": [{"note": "n"}],
    }
    rows = {(r.source_kind, r.idx): r for r in ingest.project_all(ingest.parse(frame(spark, record))).collect()}
    assert {k for k, _ in rows} == {"x_post", "x_account", "media", "search_result", "web_page", "user_input"}
    post = rows["x_post", 0]
    assert (post.evidence_id, post.text, post.links) == ("77", "hi", ["https://a.test", "https://b.test", "https://x.com/Ann/status/77"])
    assert len(rows["x_post", 1].evidence_id) == 16 and rows["x_account", 0].evidence_id == "bob"
    assert rows["search_result", 0].rank == 4 and rows["search_result", 0].query == "q" and rows["search_result", 0].engine == "google"
    web = rows["web_page", 0]
    assert (web.evidence_id, web.domain, web.title, web.text) == ("web_document/d1", "site.test", "H", "body")
    assert rows["user_input", 0].evidence_id.startswith("user_input/") and rows["user_input", 0].text == "n"


def test_kinds_requests_errors_and_roots(spark):
    parsed = ingest.source_kinds(ingest.validate(ingest.parse(frame(spark, {**BASE, "media": [{"media_id": "m", "media_kind": "Screenshot", "local_path": "a.webp"}], "posts": [{"post_id": 1}]}, {**BASE, "page_url": "https://twitter.com/x"}, "{"))))
    got = parsed.orderBy("kafka_offset").select("primary_kind", "n_records").collect()
    assert [tuple(r) for r in got[:2]] == [("x_post", 2), ("x_page", 1)]
    requests = ingest.media_requests(ingest.project_media(parsed)).collect()
    assert {r.target_topic for r in requests} == set(ingest.MEDIA_TOPICS) and requests[0].artifact_role == "screenshot_full_page" and requests[0].media_type == "image/webp"
    assert {(r.storage_path, r.artifact_id, r.params_hash) for r in requests} == {("a.webp", "m", stable("media-v1", "max_bytes=26214400", "max_pixels=40000000", "vl_max_side=1600")[:16])}
    sha = stable("m", "a.webp")[:32]
    assert {(r.artifact_sha256, r.request_id) for r in requests} == {(sha, "media_req_" + stable("m", sha, "a.webp")[:24])}
    dead = ingest.dead_letters(parsed).collect()
    assert {d.error_class for d in dead} == {"parse_error", "validation_error"}
    assert ingest.root_rows(parsed).count() == 2 and ingest.collector_runs(parsed).agg({"records_emitted": "sum"}).first()[0] == 2


def test_equal_input_gives_equal_ids(spark):
    f = frame(spark, {**BASE, "posts": [{"text": "x"}]}, {**BASE, "posts": [{"text": "x"}]})
    assert ingest.project_posts(ingest.parse(f)).select("observation_id").distinct().count() == 1


def test_error_envelopes_keep_the_whole_payload_and_its_origin(spark):
    long = json.dumps({**BASE, "collector_run_id": "", "x": "y" * 50_000})
    df = frame(spark, long, {**BASE, "posts": [{"a": 1}]}).withColumns({"trace_id": F.lit(""), "request_id": F.lit("req")})
    dead = ingest.dead_letters(ingest.validate(ingest.parse(df))).collect()
    assert len(dead) == 1 and dead[0].raw == long and dead[0].payload_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert (dead[0].original_topic, dead[0].original_partition, dead[0].original_offset, dead[0].trace_id, dead[0].target_key) == ("t", "0", "0", "req", "t/0/0")
    assert dead[0].target_topic == "evidence.capture.shadow.errors.v1" and dead[0].failed_evidence_id == ""


def test_topics_keys_and_shadow_envelopes(spark):
    record = {**BASE, "posts": [{"post_id": 5}], "web_documents": [{"id": "d"}], "quality": {"captcha": "yes", "partial": 1}, "search_results": [{"url": "https://x.com/a/status/9"}]}
    observed = ingest.project_all(ingest.parse(frame(spark, record)))
    got = {r.source_kind: r for r in observed.collect()}
    assert (got["x_post"].target_topic, got["x_post"].target_key) == ("evidence.posts.observed.v1", "5")
    assert (got["web_page"].target_topic, got["web_page"].target_key) == ("evidence.web.documents.observed.v1", "web_document/d")
    assert got["search_result"].challenge is True and got["search_result"].canonical_post_id == "9" and got["x_post"].challenge is None
    assert {r.source_kind for r in ingest.shadow_envelope(observed).collect()} == set(got)
    one = observed.where("source_kind = 'x_post'").select(ingest.quality_flags(F.col("capture_quality")).alias("f"), ingest.challenged(F.col("capture_quality")).alias("c")).first()
    assert one.f == ["captcha", "partial"] and one.c
    media = ingest.media_requests(ingest.project_media(ingest.parse(frame(spark, {**BASE, "media": [{"media_id": "m", "raw": {"storage_path": "p.mp4", "width": "12", "bytes": 3.0}}]}))))
    row = media.first()
    assert (row.storage_path, row.media_type, row.width, row.byte_size, row.height) == ("p.mp4", "video/mp4", 12, 3, 0) and ingest.media_shadow_envelope(media).count() == 1


def test_root_rows_tell_media_and_quality(spark):
    root = ingest.root_rows(ingest.parse(frame(spark, {**BASE, "media": [{"ocr_text": "x"}], "page_title": "T", "links": ["https://a.test"], "topics": "one"}))).first()
    assert (root.has_media, root.has_ocr, root.text, root.links, root.topics) == (1, 1, "T", ["https://a.test"], ["one"])
