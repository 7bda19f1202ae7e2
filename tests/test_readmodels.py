import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanery.functions import scalars as S
from gleanery.operators import enrichment as E
from gleanery.operators import ingest, processors
from gleanery.operators import readmodels as R

T = lambda n: dt.datetime(2025, 1, 1, n)
EVENTS = "event_id string, evidence_id string, collector_run_id string, source_project string, source_kind string, canonical_url string, author_handle string, domain string, title string, text string, topics array<string>, entities array<string>, links array<string>, has_media int, has_ocr int, posted_at timestamp_ntz, captured_at timestamp_ntz, ingested_at timestamp_ntz, raw_json string"


def event(i, evidence="e", run="r", kind="web_page", url=None, text="t", links=(), hour=1, raw=None, **more):
    row = dict(event_id=f"ev{i}", evidence_id=evidence, collector_run_id=run, source_project="p", source_kind=kind, canonical_url=url, author_handle=None, domain="d", title=f"title {i}", text=text, topics=[], entities=[], links=list(links), has_media=0, has_ocr=0, posted_at=None, captured_at=T(hour), ingested_at=T(hour), raw_json=raw)
    return {**row, **more}


def frame(spark, rows, schema=EVENTS):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)


def test_sources_take_the_last_row_and_hints_follow(spark):
    df = frame(spark, [event(1, "a", hour=1, has_media=1), event(2, "a", hour=3), event(3, "b", text=""), event(4, "m", kind="media"), event(5, "c", kind="search_result")])
    got = {r.evidence_id: r for r in R.sources(df).withColumn("hint", R.review_hint()).collect()}
    assert (got["a"].title, got["a"].observations, got["a"].has_media, got["a"].first_captured_at) == ("title 2", 2, 1, T(1))
    assert {k: v.hint for k, v in got.items()} == {"a": "Multiple captures", "b": "Extraction empty", "m": "Needs OCR/VL review", "c": "Triage"}
    assert R.sources(df.where("false")).count() == 0


def test_inspection_expands_seeds_by_run(spark):
    df = frame(spark, [event(1, "a", "r1", links=["https://q.test"]), event(2, "b", "r1"), event(3, "c", "r2"), event(4, "d", "r3", raw='{"x":"HTTPS://Q.test"}'), event(5, "987654321012", "r4"), event(6, "f", "r5", url="https://x.com/a/status/987654321012")])
    ids = lambda q: sorted(r.event_id for r in R.inspect(df, q).collect())
    assert ids("https://q.test") == ["ev1", "ev2", "ev4"] and ids("r2") == ["ev3"] and ids("nothing") == []
    assert ids("https://twitter.com/a/status/987654321012") == ["ev5", "ev6"]
    assert {r.source_kind for r in R.longest_by_kind(df).collect()} == {"web_page"}


def test_library_archives_and_counts(spark):
    rows = R.sources(frame(spark, [event(1, "a"), event(2, "b")]))
    actions = spark.createDataFrame([("a", "keep", 1), ("a", "archive", 2), ("b", "archive", 1), ("b", "restore", 3)], "evidence_id string, action string, at int")
    runs = spark.createDataFrame([("b",), ("b",)], "k string")
    assert [(r.evidence_id, r.runs) for r in R.library(rows, {"runs": (runs, "k")}, actions).collect()] == [("b", 2)]
    assert {r.evidence_id: r.archive_state for r in R.library(rows, {}, actions, archived=True).collect()} == {"a": "archived", "b": "active"}
    assert len({str(R.library_order(x)) for x in R.SORTS}) == 4 and str(R.library_order("odd")) == str(R.library_order("ingested_desc"))


def test_tasks_decisions_and_order(spark):
    rows = spark.createDataFrame([("a", 5, 1), ("b", 0, 2)], "id string, n int, at int")
    tasks = R.tasks_of(rows, "id", {"empty": (F.col("n") == 0, "blocking"), "any": (F.lit(True), "normal")}, "at")
    decided = spark.createDataFrame([("any:a", "open", 1), ("any:a", "Done", 2), ("empty:b", "open", 1)], "task_id string, decision string, decided_at int")
    left = R.overlay_decisions(tasks, decided, ["done"]).orderBy(*R.inbox_order()).collect()
    assert [t.task_id for t in left] == ["empty:b", "any:b"] and [t.decision for t in left] == ["open", None]


def test_links_by_any_key_count_once(spark):
    base = spark.createDataFrame([("x", "k1"), ("y", None)], "object_id string, other string")
    links = spark.createDataFrame([("x", "o1"), ("k1", "o1"), ("k1", "o2"), ("z", "o3")], "link_key string, object_id string")
    assert {r.object_id: r.links for r in R.linked_ids(base, links, ["object_id", "other"]).collect()} == {"x": 2, "y": 0}


def test_related_classes_stand_for_all_pairs(spark):
    rows = [(f"e{i}", f"u{i % 3}" if i < 9 else None, "same" if i != 5 else "") for i in range(10)]
    df = spark.createDataFrame(rows, "id string, url string, host string")
    got = R.related_classes(df, "id", ["url", "host"]).collect()
    pairs = {(a.member, b.member) for a in got for b in got if a.link == b.link and a.class_id == b.class_id and a.member != b.member}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and ((a[1] and a[1] == b[1]) or (a[2] and a[2] == b[2]))}
    assert pairs == want and all(r.members >= 2 for r in got)
    assert {r.id for r in R.related_to(df, "id", "e5", ["url", "host"]).collect()} == {b for a, b in want if a == "e5"}


CLAIMS = [(1, "s1", "Speed: 10", "k"), (2, "s2", "speed: 20", "k"), (3, "s2", "Speed: 10", "other"), (4, "s1", "The cat is here", "k"), (5, "s1", "free text", "k"), (6, "s3", "speed: 20", "k"), (7, "s1", None, "k"), (8, "s1", "IS it so", "k")]


def claims(spark):
    return R.claims(spark.createDataFrame(CLAIMS, "id int, src string, title string, kind string"), "id", "title", "src", "kind")


def test_claims_conflicts_duplicates_and_support(spark):
    rows = {r.claim_id: r for r in claims(spark).collect()}
    assert (rows[1].subject, rows[1].value, rows[4].subject, rows[4].value, rows[5].scoped, rows[8].scoped) == ("Speed", "10", "The cat", "here", False, False) and 7 not in rows
    assert {r.claim_id: r.cluster_size for r in R.proposition_sizes(claims(spark)).collect()} == {1: 3, 2: 3, 3: 1, 4: 1, 5: 1, 6: 3, 8: 1}
    (conflict,) = R.conflict_clusters(claims(spark)).collect()
    assert (conflict.proposition, conflict.assertions, conflict.values_n, conflict.sources, conflict.preferred) == ("speed|k", 3, 2, 3, "Speed: 10") and len(conflict.cluster_id) == 33
    assert {(r.cluster_id, r.assertions) for r in R.duplicate_clusters(claims(spark)).collect()} == {("duplicate_cluster:speed: 10", 2), ("duplicate_cluster:speed: 20", 2)}
    assert [(r.subject_key, r.values_n) for r in R.contradictions(claims(spark)).collect()] == [("speed", 2)]
    chosen = spark.createDataFrame([("s1", "Quote"), ("s1", "refutes"), ("s2", "related")], "source_id string, selection_kind string")
    got = {r.claim_id: (r.support, r.refute, r.context) for r in R.support_counts(claims(spark), chosen).collect()}
    assert got[1] == (1, 1, 0) and got[2] == (0, 0, 1) and got[6] == (0, 0, 0)
    facts = spark.createDataFrame([("s1", "10 ms"), ("s1", ""), ("s2", "2")], "source_id string, raw_value string")
    assert {r.claim_id: r.facts for r in R.fact_matches(claims(spark), facts).collect()} == {1: 1, 2: 1}
    own = spark.createDataFrame([("s3",)], "source_id string")
    assert {r.claim_id for r in R.entity_claims(claims(spark), "a cat", own).collect()} == {4, 6} and {r.claim_id for r in R.topic_claims(claims(spark), "FREE", own).collect()} == {5, 6}


@pytest.mark.parametrize(
    ("rows", "state"),
    [
        ([("1", "rejected", "", "", "web_page", "s")], "NA"), ([("1", "accepted", "", "N/A", "web_page", "s")], "NA"), ([("1", "", "", "different setup", "web_page", "s")], "Incomparable"), ([("1", "", "", "outdated", "web_page", "s")], "Stale"),
        ([("1", "", "", "", "web_page", "s"), ("2", "", "", "", "web_page", "s")], "Disputed"), ([("1", "", "refutes", "", "web_page", "s")], "Disputed"), ([("1", "", "replicated", "", "web_page", "s")], "Reproduced"), ([("1", "accepted", "", "", "media", "s")], "Independently-measured"),
        ([("1", "proposed", "", "", "media", "s")], "Vendor-reported"), ([("1", "", "", "", "web_page", "")], "Incomparable"),
    ],
)
def test_cells_of_a_comparison(spark, rows, state):
    made = [(i, "p", "a", v, True, st, rel, q, k, src) for i, (v, st, rel, q, k, src) in enumerate(rows)] + [(99, "other", "b", "x", True, "", "", "", "", "s")]
    df = spark.createDataFrame(made, "claim_id int, property string, subject string, value string, scoped boolean, review_state string, relation string, qualifier string, source_kind string, source_id string")
    cells = {(r.property, r.subject): r.state for r in R.compare_matrix(df).collect()}
    assert cells["p", "a"] == state and cells["other", "a"] == "Missing" and len(cells) == 4


def test_attempts_fold_by_time(spark):
    rows = [("a", "x.launch_requested", 1), ("a", "x.launch_result", 2), ("a", "x.committed", 3), ("a", "x.launch_result", 4), ("b", "x.launch_requested", 1), ("c", "x.launch_failed", 1), ("d", "x.launch_requested", 1), ("d", "x.launch_failed", 2), ("d", "x.committed", 3), ("e", "noise", 1), ("f", "x.committed", 1), ("f", "x.launch_failed", 2)]
    df = spark.createDataFrame([(*r, f"{r[0]}{r[2]}") for r in rows], "subject_id string, event_type string, created_at int, event_id string")
    got = {r.subject_id: (r.state, r.request_event_id, r.outcome_event_id) for r in R.fold_attempts(df).collect()}
    assert got == {"a": ("committed", "a1", "a3"), "b": ("requested", "b1", None), "c": ("failed", None, "c1"), "d": ("committed", "d1", "d3"), "f": ("failed", None, "f2")}


def test_cursors_dates_briefs_and_metrics(spark):
    token = R.encode_cursor(50, "2025-01-01|é")
    assert R.decode_cursor(token) == (50, "2025-01-01|é") and "=" not in token and R.decode_cursor("??") is None and R.next_cursor(50, 51, 50, "k") and R.next_cursor(50, 50, 50, "k") is None
    df = spark.createDataFrame([("a: b: c",), ("a - b",), ("a",), (": x",), (None,)], "t string")
    assert [tuple(r.p) for r in df.select(R.definition_parts(F.col("t")).alias("p")).collect()] == [("a", "b: c"), ("a", "b"), ("a", ""), ("Untitled term", "x"), ("Untitled term", "")]
    assert spark.createDataFrame([(" a \r\n\n b",)], "t string").select(R.brief_items(F.col("t")).alias("i")).first().i == ["a", "b"]
    days = spark.createDataFrame([("2025-01-05T00:00",), ("",), (None,), ("2024-01-01",)], "d string")
    assert R.in_dates(days, "d").count() == 4 and R.in_dates(days, "d", start="2025-01-01").count() == 1
    counters = spark.createDataFrame([({"model": "m", "status": "ok"}, 2.0), ({"model": "m", "status": "ok"}, 1.0)], "labels map<string,string>, sample double")
    seen = spark.createDataFrame([("duration", {"model": "m"}, 9.0, 3, 5.0), ("queue", {"model": "m"}, 0.0, 0, 0.0)], "name string, labels map<string,string>, total double, n int, most double")
    r = R.request_rows(counters, seen).first()
    assert (r.model, r.operation, r.requests, r.avg_duration, r.max_duration, r.avg_queue) == ("m", "", 3.0, 3.0, 5.0, None)


def test_scalars_of_objects(spark):
    df = spark.createDataFrame([("7.9", "[1, \"2.5\", \"x\", null]", {"a": "", "b": "[]", "c": "1"}, '2025-01-02', 3)], "n string, l string, f map<string,string>, t string, k int")
    r = df.select(S.first_int(F.lit("x"), F.col("n")).alias("i"), S.float_list(F.col("l")).alias("l"), S.has_any(F.col("f"), "a", "b").alias("no"), S.has_any(F.col("f"), "b", "c").alias("yes"), S.target_count(F.col("k")).alias("t"), S.spaced_json("t", "n").alias("j"), S.date_precision(F.col("t")).alias("p"), S.time_or_null(F.lit("")).alias("z"), S.taxonomy_id("kind", F.lit(" X Post!")).alias("id")).first()
    assert (r.i, r.l, r.no, r.yes, r.t, r.j, r.p, r.z, r.id) == (7, [1.0, 2.5], False, True, 4, '{"n": "7.9", "t": "2025-01-02"}', "day", None, "kind.x_post")


def test_recognition_rows_and_recapture(spark):
    rows = [("m", "sha", "ph", "", [("a", 0.5), ("b", 1.0)], None), ("n", "s2", "ph", "x", [], None), ("o", "s3", "ph", None, None, "boom")]
    df = spark.createDataFrame(rows, "evidence_id string, artifact_sha256 string, params_hash string, text string, blocks array<struct<text:string,confidence:double>>, error string")
    got = {r.evidence_id: r for r in E.recognition_rows(df).collect()}
    assert (got["m"].text, got["m"].mean_confidence, got["m"].min_confidence, got["m"].block_count) == ("a\nb", 0.75, 0.5, 2) and got["n"].text_chars == 1 and (got["o"].status, got["o"].text_chars) == ("failed", 0)
    events = E.recapture_events(E.recognition_rows(df))
    parsed = ingest.parse(events.withColumnRenamed("value", "raw_value").withColumn("captured_at", F.lit("2025-01-01")).drop("captured_at"))
    assert {r.evidence_id for r in ingest.project_media(parsed).collect()} == {"m", "n"}
    requests = spark.createDataFrame([("sha", "ph", 1, 1, 1), ("s9", "ph", 10**9, 1, 1), ("s8", "ph", 1, 10**5, 10**5)], "artifact_sha256 string, params_hash string, byte_size long, width long, height long")
    done = spark.createDataFrame([("sha", "ph", "ok"), ("s8", "other", "ok")], "source_sha256 string, params_hash string, status string")
    assert {r.artifact_sha256: r.skip for r in E.with_limits(E.open_requests(requests, done)).collect()} == {"s9": "too many bytes", "s8": "too many pixels"}
    assert E.failure_events(df, "evidence_id", "error", "worker").count() == 1


def test_keys_launches_steps_and_requests(spark):
    rows = [("evidence.capture.events.v1", '{"collector_run_id":"r","event_index":2}'), ("evidence.accounts.observed.v1", '{"handle":"Ann","observation_id":"o"}'), ("x.state.v1", '{"media_id":"m"}'), ("evidence.web.documents.observed.v1", '{"document_id":"d"}'), ("other", '{"b":1,"a":2}')]
    df = spark.createDataFrame(rows, "topic string, value string")
    keys = [r.k for r in df.select(E.message_key(F.col("topic"), F.col("value")).alias("k")).collect()]
    assert keys[:4] == ["r:2", "ann:o", "m", "d"] and len(keys[4]) == 64
    launches = spark.createDataFrame([("u", "", "p", "me", 1, None), ("u", "s", "p", "me", 2, '{"session":{"session_id":"z"}}'), ("u", "t", "p", "me", 3, '{"error":"no"}')], "seed_url string, source_id string, project string, actor string, created_at int, response string")
    states = {r.subject_id: r.state for r in R.fold_attempts(E.launch_events(launches)).collect()}
    assert states == {"u": "requested", "s": "committed", "t": "failed"}
    runs = spark.createDataFrame([("r", '{"steps":[{"name":"a","ok":true,"duration_ms":5},{"name":"b"}]}'), ("s", "{"), ("t", None)], "run_id string, details_json string")
    assert [(x.step_name, x.ok, x.duration_ms) for x in E.run_steps(runs).orderBy("step_no").collect()] == [("a", 1, 5), ("b", 0, 0)]
    asked = spark.createDataFrame([('{"href":"https://a.test","event_index":"3"}',), ("{}",), ("{",)], "raw_value string")
    assert [(r.url, r.event_index, r.error) for r in E.web_requests(asked).collect()] == [("https://a.test", 3, None), ("", 0, "url is required"), ("", 0, "url is required")]


def test_processors_by_name(spark, sf):
    from gleanery.sources import table

    rows = table(spark, sf, "capture_events")
    chain = ["capture_parse", "capture_validate", "valid_only"]
    out, counters = processors.run(rows, chain, counted=True)
    n = out.count()
    assert n == ingest.validate(ingest.parse(rows)).where("error IS NULL").count() and counters["capture_parse"].get["rows"] == rows.count()
    with pytest.raises(ValueError):
        processors.run(rows, ["unknown"])
    with pytest.raises(ValueError):
        processors.register("capture_parse", lambda df: df)
    assert processors.with_meta(rows, key="kafka_key", stage=F.lit("x")).first().stage == "x"
    ordered = processors.keyed_order(rows, "kafka_key", ["kafka_offset"], 3).withColumn("part", F.spark_partition_id())
    assert ordered.groupBy("kafka_key").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
