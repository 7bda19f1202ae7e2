import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanery.operators import analytics as A
from gleanery.operators import documents, labels, retrieval
from gleanery.sources import readers, sinks

ROW = "event_id string, evidence_id string, source_kind string, canonical_url string, domain string, title string, text string, topics array<string>, entities array<string>, links array<string>, has_media int, has_ocr int"


def labelled(spark, *rows):
    out = labels.annotate(spark.createDataFrame(list(rows), ROW)).collect()
    got = {}
    for r in out:
        got.setdefault(r.event_id, {})[r.label_id] = r
    return got


def test_label_rules(spark):
    got = labelled(
        spark,
        ("a", "1", "web_page", "https://site.test/board", "site.test", "Leaderboard", "scores of models", ["Code Agents"], [" X "], ["u"], 0, 0),
        ("b", "2", "x_post", "", None, None, "hello", None, None, None, 1, 0),
        ("c", "3", "user_input", None, None, None, None, [], [], [], 0, 1),
        ("d", "4", "web_page", "https://github.com/a/b/blob/x.py", "github.com", None, "code", None, None, None, 0, 0),
    )
    assert {"form.leaderboard", "modality.table", "action.compare", "action.collect_more", "topic.code_agents", "entity.mentioned", "quality.direct_web_capture"} <= got["a"].keys()
    assert {"source.x.post", "form.social_post", "modality.image", "modality.text"} == got["b"].keys() and got["b"]["form.social_post"].status == "accepted"
    assert {"source.user.input", "form.user_note", "quality.has_ocr", "quality.user_supplied", "action.review"} == got["c"].keys()
    assert "form.github_file" in got["d"] and "modality.code" in got["d"]


def test_latest_facets_queues_parity(spark):
    df = spark.createDataFrame([("k", 1, 1, "a"), ("k", 2, 1, "b"), ("k", 2, 2, None), ("j", 1, 1, "c")], "key string, at int, id int, v string")
    assert {r["key"]: r["v"] for r in A.latest_by(df, ["key"], ["at", "id"]).collect()} == {"k": None, "j": "c"}
    f = {(r.facet, r.value): r.n for r in A.facets(df, ["key", "v"], top=1).collect()}
    assert f == {("key", "k"): 3, ("v", "a"): 1}
    q = {r.queue: r.n for r in A.queue_counts(df, {"one": F.col("at") == 1, "null": F.col("v").isNull()}).collect()}
    assert q == {"one": 2, "null": 1}
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, v string"), spark.createDataFrame([(1, "x"), (2, "Y"), (4, "w")], "id int, v string")
    assert {r.id: r.state for r in A.parity(a, b, "id").collect()} == {2: "differs", 3: "missing", 4: "extra"}
    assert A.merge_first([b, a], ["id"], ["v"]).where("id = 2").first().v == "Y"


def test_fusion_does_not_depend_on_branch_order(spark):
    a = spark.createDataFrame([("x", "exact", 1, 9.0), ("y", "exact", 2, 8.0)], "evidence_id string, branch string, rank int, score double")
    b = spark.createDataFrame([("y", "keyword", 1, 3.0)], a.schema)
    one = {r.evidence_id: round(r.score, 9) for r in retrieval.fuse([a, b]).collect()}
    two = {r.evidence_id: round(r.score, 9) for r in retrieval.fuse([b, a, a]).collect()}
    assert one == two and one["y"] == round(4 / 62 + 1.2 / 61, 9)


def test_keyword_exact_vector(spark):
    docs = spark.createDataFrame([("a", "red fox", "x"), ("b", "red red", "y"), ("c", None, None), ("d", "blue", "fox")], "evidence_id string, text string, title string")
    hits = retrieval.keyword(docs, "fox", {"title": 2.0, "text": 1.0}, 10).collect()
    assert [h.evidence_id for h in hits] == ["d", "a"] and retrieval.keyword(docs, " ", {"text": 1.0}, 10).count() == 0
    rows = spark.createDataFrame([("a", "u", "@Ann", dt.datetime(2025, 1, 1)), ("b", "v", "ann", dt.datetime(2025, 1, 2))], "evidence_id string, canonical_url string, author_handle string, ingested_at timestamp_ntz")
    assert [r.evidence_id for r in retrieval.exact(rows, "v", 5).collect()] == ["b"]
    points = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 2.0]), ("z", [0.0, 0.0])], "evidence_id string, embedding array<float>")
    assert [r.evidence_id for r in retrieval.vector(points, [0.0, 1.0], "text_dense", 2).collect()] == ["q", "p"]


def test_page_extraction():
    page = """<html><head><title> A  b </title><meta name="Author" content="x"><link rel="canonical" href="/c#f">
    <script type="application/ld+json">{"@graph":[{"datePublished":"2025-02-03"}]}</script><style>p{}</style></head>
    <body><nav><a href="/n">n</a></nav><article><h1>Head &amp; tail</h1><p>%s</p><table><tr><th>k</th><td>v</td></tr></table><img src="i.png" alt="pic"><a href="mailto:x">m</a></article></body>""" % ("word " * 60)
    got = documents.extract_page(page, "https://S.test/d/")
    assert got["title"] == "A b" and got["canonical_url"] == "https://s.test/c" and got["published_at"] == "2025-02-03"
    assert got["text"].startswith("Head & tail") and "p{}" not in got["text"] and got["links"] == ["https://s.test/n"]
    assert got["tables"] == [[["k", "v"]]] and got["headings"] == [{"level": 1, "text": "Head & tail"}] and got["images"][0]["alt"] == "pic"
    assert documents.extract_page(None)["text"] == "" and documents.extract_page("<p>a<b<")["links"] == []


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "https://a.test/", "<p>x</p>"), (2, None, None)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in documents.extract_pages(df).collect()}
    assert rows[1].text == "x" and rows[2].text == "" and len(rows[1].document_id) == 24


@pytest.mark.parametrize("n", [0, 1, 50, 4000, 20_000])
def test_chunks(n):
    text = "\n\n".join(" ".join(["word"] * 40) for _ in range(n // 200)) or "x" * n
    chunks = documents.chunk_text(text)
    assert all(0 < len(c) <= documents.CHUNK for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(text.split())
    assert documents.chunk_text(None) == []


def test_readers_and_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("# HELP x",), ('req_total{model="a",op="x,y"} 3',), ('req_total{model="a"} 4.5',), ("up 1",), ("bad",)], "value string")
    got = readers.metric_samples(lines, "req_").collect()
    assert len(got) == 2 and got[0].labels["op"] == "x,y"
    assert readers.sum_by_label(readers.metric_samples(lines), "req_total", "model").first().total == 7.5
    spark.range(500).createOrReplaceTempView("numbers")
    assert readers.guarded_sql(spark, "SELECT * FROM numbers;").count() == 200 and readers.guarded_sql(spark, "select id from numbers limit 300").count() == 300
    for bad in ("drop table numbers", "select 1; select 2", "with x as (select 1) insert into t select * from x", ""):
        with pytest.raises(ValueError):
            readers.guarded_sql(spark, bad)
    state = sinks.Snapshots(spark, str(tmp_path / "state"))
    first = spark.createDataFrame([("post/1", 1, "a"), ("post/2", 1, "b")], "key string, at int, v string")
    state.put(0, first, ["key"], ["at"])
    state.put(1, spark.createDataFrame([("post/1", 2, "c")], first.schema), ["key"], ["at"])
    state.put(1, spark.createDataFrame([("post/1", 3, "z")], first.schema), ["key"], ["at"])
    # a number that is there already is another run's batch: nothing of it is lost
    assert sinks.get(state.read(), "post/1").first().v == "z" and sinks.scan_prefix(state.read(), "post/").count() == 2
    state.put(0, spark.createDataFrame([("post/3", 1, "n")], first.schema), ["key"], ["at"])
    assert state.read().count() == 3 and state.versions() == [2, 3]
    assert state.delete(4, F.col("key") == "post/2", ["key"]) == 1 and {r.key for r in state.read().collect()} == {"post/1", "post/3"}
    assert state.read([]).count() == 0
    assert sinks.metric_lines(first, "m", ["key"], "at").first().value == 'm{key="post/1"} 1'
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# T")
    (tmp_path / "docs" / "b.bin").write_text("x")
    assert readers.text_documents(spark, str(tmp_path / "docs")).count() == 1 and readers.folder_stats(spark, str(tmp_path / "docs")).count() == 2


def test_tasks(spark):
    from gleanery.operators import tasks

    assert retrieval.lookup_keys("https://x.com/Ann/status/12345") == ["post/12345"] and retrieval.lookup_keys("123456789012") == ["post/123456789012", "account/123456789012"]
    assert retrieval.lookup_keys("@Ann_B") == ["account/ann_b"] and retrieval.lookup_keys("post/9") == ["post/9"] and retrieval.lookup_keys(" ") == [] == retrieval.lookup_keys("other/9")
    ev = spark.createDataFrame([("m", "media", "seen text", "a caption"), ("w", "web_page", " \n", None), ("p", "x_post", "hello", None)], "evidence_id string, source_kind string, text string, title string")
    got = {(r.evidence_id, r.vector_name): r.text for r in tasks.embedding_tasks(ev).collect()}
    assert got == {("m", "ocr_dense"): "seen text", ("m", "caption_dense"): "a caption", ("p", "text_dense"): "hello"}
    media = spark.createDataFrame([("a", "s1", "image", dt.datetime(2025, 1, 1), "o1"), ("a", "s2", "image", dt.datetime(2025, 1, 2), "o2"), ("b", "s3", "image", dt.datetime(2025, 1, 3), "o3")], "media_id string, sha256 string, media_kind string, captured_at timestamp_ntz, observation_id string")
    done = spark.createDataFrame([("s3", "ok"), ("s2", "failed")], "source_sha256 string, status string")
    assert {(r.media_id, r.sha256, r.lane) for r in tasks.route_media(media, done).collect()} == {("a", "s2", x) for x in ("ocr", "vl", "embed")}


def test_first_ranks_have_no_bound_and_keep_runs_without_hits(spark):
    rows = [(f"e{i:04d}",) for i in range(1500) for _ in range(1 + (i % 7 == 0) + (i % 100 == 0))]
    evidence = spark.createDataFrame(rows, "evidence_id string")
    runs = [("r1", ["e1499", "e1493"]), ("r2", ["e0700"]), ("r3", ["nowhere"]), ("r4", None), ("r5", ["e0007", "e1493", "e1491"]), ("r6", ["e1498"])]
    count = {}
    for (e,) in rows:
        count[e] = count.get(e, 0) + 1
    rank = {e: i for i, e in enumerate(sorted(count, key=lambda e: (-count[e], e)), 1)}
    want = {r: min((rank[e] for e in ids or [] if e in rank), default=None) for r, ids in runs}
    got = A.first_ranks(evidence, spark.createDataFrame(runs, "run_id string, evidence_ids array<string>")).collect()
    assert {r.run_id: r.best_rank for r in got} == want and len(got) == len(want) and want["r1"] > 1000


def test_embedding_tasks_of_media_are_registered(spark, sf):
    import __spark_entry__ as entry

    made, without = (entry.queries()[n](spark, sf) for n in ("embedding_tasks_all", "embedding_tasks"))
    assert "ocr_dense" in {r.vector_name for r in made.select("vector_name").distinct().collect()}
    assert without.exceptAll(made).count() == 0 and made.count() > without.count()


def test_chunks_as_worked_out_by_hand():
    a, b, c = "a" * 30, "b" * 250, "c" * 45
    size = 100
    # the long paragraph fills up what `a` began, is cut at 100 and 200 of its own characters, the rest stands alone
    assert documents.chunk_text(f"{a}\n\n{b}\n\n{c}", size, tiny=0) == [a + "\n\n" + "b" * 68, "b" * 32, "b" * 100, "b" * 50, c]
    # tiny chunks are carried over to the next one, a last one goes back
    assert documents.chunk_text(f"{a}\n\n{b}\n\n{c}", size, tiny=40) == [a + "\n\n" + "b" * 68, "b" * 32 + "\n\n" + "b" * 100 if False else "b" * 32, "b" * 100, "b" * 50, c]
    assert documents.chunk_text("x" * 60 + "\n\n" + "y" * 39 + "\n\n" + "z" * 20, size, tiny=30) == ["x" * 60, "y" * 39 + "\n\n" + "z" * 20]
    assert documents.chunk_text("q" * 99 + "\n\n" + "p" * 10, size, tiny=20) == ["q" * 99, "p" * 10]
    # a paragraph as long as the size has no room for its blank line, so it is cut by width: into itself
    assert documents.chunk_text("m" * 100 + "\n\n" + "n" * 100, size, tiny=0) == ["m" * 100, "n" * 100]
    assert documents.chunk_text(" short ") == ["short"] and documents.chunk_text("\n" * 5000) == []


def test_blocks_of_few_paragraphs_and_long_ones(spark):
    rows = [(1, "T", "a\nb\r\nc"), (2, " ", "p1\n\np2\n\np3\n\np4\nstill p4"), (3, None, "w" * 3000), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, title string, text string")
    got = {r.doc_id: [b.block for b in r.blocks] for r in documents.evidence_blocks(df, "doc_id", "title", "text").collect()}
    assert got[1] == ["T", "a", "b", "c"] and got[2] == ["p1", "p2", "p3", "p4\nstill p4"] and [len(x) for x in got[3]] == [1400, 1400, 200] and got[4] == []
    cut = documents.evidence_blocks(df, "doc_id", "title", "text", most=2).where("doc_id = 1").first()
    assert len(cut.blocks) == 2 and cut.omitted == 2


def test_evidence_documents_of_pages(spark):
    page = "<html><head><title>T</title></head><body><article><h1>H</h1><p>%s</p><table><tr><td>a</td><td>b</td></tr></table><img src='/i.png' alt='x'></article></body></html>" % ("word " * 60)
    df = spark.createDataFrame([(1, "https://a.test/p", page), (2, "https://a.test/p", page), (3, None, None)], "page_id long, url string, html string")
    docs = {r.page_id: r for r in documents.evidence_documents(documents.extract_pages(df)).collect()}
    assert [b.kind for b in docs[1].blocks][:2] == ["title", "heading"] and docs[1].blocks[-1].text == "a | b" and docs[1].quality.has_main_text and docs[1].assets[0].url == "https://a.test/i.png"
    assert docs[1].revision_id == docs[2].revision_id != docs[3].revision_id and docs[3].blocks == []


def test_requests_are_made_definite():
    asked = retrieval.plan_search({"query": " q ", "mode": "PRECISION", "limit": 500, "filters": {"project": "a, b", "source_projects": ["b"], "handle": "@X", "has_media": "yes", "date_to": "2025-02-01"}})
    assert asked["mode"] == "precision" and asked["rerank"] and asked["limit"] == 100 and asked["branch_limit"] == 80 and asked["reranked"] == 3
    assert asked["filters"] == {"source_projects": ["b", "a"], "author_handles": ["@X"], "has_media": True, "date_to": "2025-02-01"}
    assert retrieval.plan_search({"query": "q", "mode": "odd"})["branches"] == retrieval.MODES["hybrid"] and not retrieval.plan_search({"query": "q"})["rerank"]
    with pytest.raises(ValueError):
        retrieval.plan_search({"query": " "})


def test_filters_and_degraded_answers(spark):
    rows = [("a", "p", "@Ann", ["t"], 1, dt.datetime(2025, 2, 1, 12)), ("b", "p", "bob", ["u"], 0, dt.datetime(2025, 2, 2)), ("c", "q", None, None, None, None)]
    df = spark.createDataFrame(rows, "evidence_id string, source_project string, author_handle string, topics array<string>, has_media int, captured_at timestamp_ntz")
    ids = lambda f: [r.evidence_id for r in df.where(f).collect()]
    assert ids(retrieval.row_filter({"author_handles": ["ANN"]})) == ["a"] and ids(retrieval.row_filter({"topics": ["t", "u"], "has_media": False})) == ["b"]
    assert ids(retrieval.row_filter({"date_to": "2025-02-01"})) == [] and ids(retrieval.row_filter({"date_to": "2025-02-01"}, day_bounds=True)) == ["a"]
    assert ids(retrieval.payload_filter({"date_from": "2025-02-01", "date_to": "2025-02-01"})) == ["a"] and ids(retrieval.payload_filter({"date_from": "2025-02-02"})) == ["a", "b", "c"]
    latest = spark.createDataFrame([("a", "A"), ("b", "B")], "evidence_id string, title string")
    branch = lambda r: retrieval.ranked(latest.withColumn("s", F.lit(1.0)), "keyword", "s", "evidence_id", r["branch_limit"])
    hits, info = retrieval.search({"query": "q", "mode": "keyword"}, {"keyword": branch}, latest)
    assert [h.title for h in hits.collect()] == ["A", "B"] and info["degraded"] and [e["branch"] for e in info["errors"]] == ["exact"]
    none, info = retrieval.search({"query": "q", "mode": "keyword"}, {}, latest)
    assert none.count() == 0 and info["warnings"]
    state = spark.createDataFrame([("post/123456789012", "z")], "key string, evidence_id string")
    seen = latest.selectExpr("evidence_id", "'123456789012' AS canonical_url", "null AS author_handle", "timestamp_ntz'2025-01-01' AS ingested_at")
    assert [r.evidence_id for r in retrieval.exact(seen, "123456789012", 5, state=state).collect()] == ["z", "a", "b"]
    payload = spark.createDataFrame([("a", "P", "u")], "evidence_id string, title string, url string")
    assert {r.evidence_id: (r.title, r.url) for r in retrieval.hydrate(spark.createDataFrame([("a",), ("x",)], "evidence_id string"), latest, payload).collect()} == {"a": ("A", "u"), "x": (None, None)}
    doc = spark.createDataFrame([("T", "", "u", ["a", "b"], None)], "title string, snippet string, canonical_url string, topics array<string>, entities array<string>").select(retrieval.rerank_document().alias("d")).first().d
    assert doc == "T\nu\na b"


def test_plans_follow_the_first_rule_that_holds(spark):
    from gleanery.operators import labels

    rows = [
        ("e1", "s", "user_input", None, None, "Benchmark of it", "t", [], ["Open AI"], [], dt.datetime(2025, 1, 1)),
        ("e2", "t", "search_result", None, None, "plain", "x", ["Topic One"], [], [], dt.datetime(2025, 1, 1)),
        ("e3", "u", "x_post", None, None, "quiet", "x", [], [], [], dt.datetime(2025, 1, 1)),
    ]
    df = spark.createDataFrame(rows, "event_id string, evidence_id string, source_kind string, canonical_url string, domain string, title string, text string, topics array<string>, entities array<string>, links array<string>, ingested_at timestamp_ntz").withColumns({"has_media": F.lit(0), "has_ocr": F.lit(0)})
    made = labels.plan(df, labels.annotation_ids(labels.annotate(df)), ("ingested_at", "event_id"))
    got = {r.evidence_id: r for r in made.collect()}
    assert set(got) == {"s", "t"} and got["s"].signal_type == "user_seed" and got["s"].priority == 0.82 and got["s"].topic_label_id == "topic.uncategorized" and got["s"].entity_id == "entity.open_ai"
    assert got["t"].signal_type == "source_expansion" and got["t"].suggested_actions[0] == "open_search_result" and got["t"].source_strength == 0.45 and got["t"].topic_label_id == "topic.topic_one"
    assert got["s"].question_text == "What research direction should be opened from this user-supplied seed: Benchmark of it?"
    key = "deterministic_research_planner:0.1.0:user_seed:s"
    import hashlib

    digest = hashlib.sha256(key.encode() + b"\0").hexdigest()[:24]
    signal, question, task = (f(made).where(F.lit(True)).collect() for f in (labels.signals, labels.questions, labels.tasks))
    assert f"sig_{digest}" in {r.signal_id for r in signal} and f"q_{digest}" in {r.question_id for r in question} and f"task_{digest}" in {r.task_id for r in task}
    assert labels.plan(df, labels.annotation_ids(labels.annotate(df.where("false"))), ("ingested_at", "event_id")).count() == 0


def test_flags_and_media_kinds_become_labels(spark):
    from gleanery.operators import labels

    df = spark.createDataFrame([("e", "m", "media", None, None, None, None, [], [], [], 0, 0, '{"captcha": true, "partial": "yes"}', "Photo")], "event_id string, evidence_id string, source_kind string, canonical_url string, domain string, title string, text string, topics array<string>, entities array<string>, links array<string>, has_media int, has_ocr int, quality string, media_kind string")
    got = {r.label_id for r in labels.annotate(df, flags="quality", media_kind="media_kind").collect()}
    assert {"quality.captcha", "quality.partial", "action.review_capture", "modality.image"} <= got
    again = {r.label_id for r in labels.annotate(df.withColumn("text", F.lit("a video as pdf")), flags="quality", again=True).collect()}
    assert {"modality.video", "modality.pdf"} <= again and "quality.captcha" not in again
    states = labels.label_states(labels.annotation_ids(labels.annotate(df, flags="quality"))).first()
    assert [x.annotation_family for x in states.labels][0] == "source" and states.labels[-1].label_id == "action.review_capture"
