"""Queries over the evidence tables and the generic ones, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import scalars as S
from gleanery.operators import analytics as A
from gleanery.operators import documents, labels, retrieval
from gleanery.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: "Now" of the data: queries take it as a parameter, never the clock.
AS_OF = "2025-12-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def ev(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence_events")


def _now():
    return F.lit(AS_OF).cast("timestamp_ntz")


# ------------------------------------------------------------------ activity, totals, facets


@query("""SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS bucket, count(*) AS n, count(DISTINCT user_id) AS n_distinct
          FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def activity_histogram(spark, d):
    return A.histogram(table(spark, d, "events"), "ts", 30, distinct="user_id")


@query("""SELECT time_bucket(INTERVAL 240 MINUTE, ingested_at) AS bucket, source_kind, count(*) AS n
          FROM evidence_events WHERE ingested_at IS NOT NULL GROUP BY 1, 2""")
def activity_by_kind(spark, d):
    return A.histogram(ev(spark, d), "ingested_at", 240, by=["source_kind"])


@query(f"""SELECT time_bucket(INTERVAL 1440 MINUTE, ingested_at) AS bucket, count(*) AS n FROM evidence_events
           WHERE ingested_at >= TIMESTAMP '{AS_OF}' - INTERVAL 43200 MINUTE GROUP BY 1""")
def activity_frame_30d(spark, d):
    return A.activity(ev(spark, d), "ingested_at", "30d", _now())


@query("""SELECT count(*) AS n, count(DISTINCT evidence_id) AS n_evidence, count(DISTINCT collector_run_id) AS n_runs,
          min(captured_at) AS first_at, max(captured_at) AS last_at, sum(has_media)::BIGINT AS media, sum(has_ocr)::BIGINT AS ocr FROM evidence_events""")
def overview_totals(spark, d):
    return ev(spark, d).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("evidence_id").alias("n_evidence"), F.countDistinct("collector_run_id").alias("n_runs"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"), F.sum("has_media").alias("media"), F.sum("has_ocr").alias("ocr"))


@query(f"""SELECT count(*) AS n, max(ingested_at) AS last_at, date_diff('second', max(ingested_at), TIMESTAMP '{AS_OF}') AS lag_seconds FROM evidence_events""")
def live_totals(spark, d):
    last = F.max("ingested_at")
    return ev(spark, d).agg(F.count(F.lit(1)).alias("n"), last.alias("last_at"), F.timestamp_diff("SECOND", F.date_trunc("second", last), _now()).alias("lag_seconds"))


@query("""SELECT source_project, source_kind, count(*) AS n, count(DISTINCT evidence_id) AS n_evidence FROM evidence_events GROUP BY ALL""")
def project_kind(spark, d):
    return ev(spark, d).groupBy("source_project", "source_kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("evidence_id").alias("n_evidence"))


@query("""SELECT collector_run_id, arg_max(source_project, (captured_at, event_id, evidence_id)) AS source_project, min(captured_at) AS started_at, max(captured_at) AS ended_at,
          count(*) AS records, sum(has_media)::BIGINT AS media, max(has_ocr) AS any_ocr FROM evidence_events GROUP BY 1""")
def runs(spark, d):
    return ev(spark, d).groupBy("collector_run_id").agg(F.max_by("source_project", F.struct("captured_at", "event_id", "evidence_id")).alias("source_project"), F.min("captured_at").alias("started_at"), F.max("captured_at").alias("ended_at"), F.count(F.lit(1)).alias("records"), F.sum("has_media").alias("media"), F.max("has_ocr").alias("any_ocr"))


@query("""SELECT source_project, capture_method, count(DISTINCT collector_run_id) AS runs, count(*) AS records FROM evidence_events GROUP BY ALL""")
def runs_by_method(spark, d):
    return ev(spark, d).groupBy("source_project", "capture_method").agg(F.countDistinct("collector_run_id").alias("runs"), F.count(F.lit(1)).alias("records"))


@query("""SELECT strftime(captured_at, '%Y-%m-%d') AS day, source_project, source_kind, count(*) AS n FROM evidence_events GROUP BY ALL""")
def daily(spark, d):
    return ev(spark, d).groupBy(F.date_format("captured_at", "yyyy-MM-dd").alias("day"), "source_project", "source_kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT source_kind, count(*) AS n, max(ingested_at) AS last_at FROM evidence_events GROUP BY 1""")
def by_kind(spark, d):
    return ev(spark, d).groupBy("source_kind").agg(F.count(F.lit(1)).alias("n"), F.max("ingested_at").alias("last_at"))


@query("""SELECT facet, value, n FROM (SELECT facet, value, count(*) AS n, row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, value) AS rn FROM (
          SELECT unnest(['source_project','source_kind','capture_method','domain','author_handle']) AS facet, unnest([source_project, source_kind, capture_method, domain, author_handle]) AS value FROM evidence_events)
          WHERE coalesce(value, '') <> '' GROUP BY 1, 2) WHERE rn <= 200""")
def facets_topn(spark, d):
    return A.facets(ev(spark, d), ["source_project", "source_kind", "capture_method", "domain", "author_handle"])


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE has_media = 1) AS with_media, count(*) FILTER (WHERE has_ocr = 1) AS with_ocr, count(*) FILTER (WHERE coalesce(text, '') = '') AS no_text, count(*) FILTER (WHERE coalesce(domain, '') = '') AS no_domain, count(*) FILTER (WHERE len(links) > 0) AS with_links FROM evidence_events""")
def conditional_counts(spark, d):
    e = ev(spark, d)
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("has_media") == 1).alias("with_media"), F.count_if(F.col("has_ocr") == 1).alias("with_ocr"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("no_text"), F.count_if(F.coalesce("domain", F.lit("")) == "").alias("no_domain"), F.count_if(F.size("links") > 0).alias("with_links"))


@query("""SELECT count(*) AS multi FROM (SELECT evidence_id FROM evidence_events GROUP BY 1 HAVING count(*) > 1)""")
def multi_capture_groups(spark, d):
    return ev(spark, d).groupBy("evidence_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("multi"))


@query("""SELECT source_project, count(DISTINCT evidence_id) AS sources, count(*) AS captures, count(*) FILTER (WHERE source_kind = 'web_page') AS web, count(*) FILTER (WHERE source_kind = 'x_post') AS posts, count(*) FILTER (WHERE source_kind = 'media') AS media,
          min(captured_at) AS first_at, max(captured_at) AS last_at FROM evidence_events GROUP BY 1""")
def projects(spark, d):
    k = F.col("source_kind")
    return ev(spark, d).groupBy("source_project").agg(F.countDistinct("evidence_id").alias("sources"), F.count(F.lit(1)).alias("captures"), F.count_if(k == "web_page").alias("web"), F.count_if(k == "x_post").alias("posts"), F.count_if(k == "media").alias("media"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"))


@query("""SELECT strftime(captured_at, '%Y-%m-%d') AS day, source_project, source_kind, t AS topic, count(*) AS n, sum(has_media)::BIGINT AS media
          FROM (SELECT captured_at, source_project, source_kind, has_media, unnest(topics) AS t FROM evidence_events) GROUP BY ALL""")
def source_activity_daily(spark, d):
    e = ev(spark, d).select(F.date_format("captured_at", "yyyy-MM-dd").alias("day"), "source_project", "source_kind", F.explode("topics").alias("topic"), F.lit(1).cast("long").alias("n"), F.col("has_media").cast("long").alias("media"))
    return A.summing_view(e, ["day", "source_project", "source_kind", "topic"], ["n", "media"])


@query("""SELECT 'topics' AS facet, t AS value, count(*) AS n, count(DISTINCT evidence_id) AS sources FROM (SELECT evidence_id, unnest(topics) AS t FROM evidence_events) GROUP BY ALL
          UNION ALL SELECT 'entities', t, count(*), count(DISTINCT evidence_id) FROM (SELECT evidence_id, unnest(entities) AS t FROM evidence_events) GROUP BY ALL""")
def entity_extracted(spark, d):
    e = ev(spark, d)
    one = lambda c: e.select(F.lit(c).alias("facet"), F.explode(c).alias("value"), "evidence_id")
    return one("topics").union(one("entities")).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("evidence_id").alias("sources"))


@query("""SELECT value, array_to_string(list_slice(list_sort(list_distinct(list(evidence_id))), 1, 12), '|') AS samples FROM (SELECT evidence_id, unnest(entities) AS value FROM evidence_events) GROUP BY 1""")
def entity_samples(spark, d):
    e = ev(spark, d).select(F.explode("entities").alias("value"), "evidence_id").distinct()
    first = e.withColumn("rn", F.row_number().over(Window.partitionBy("value").orderBy("evidence_id"))).where("rn <= 12")  # keeps 12 a group before the shuffle
    return first.groupBy("value").agg(F.array_join(F.sort_array(F.collect_list("evidence_id")), "|").alias("samples"))


@query("""SELECT queue, n FROM (SELECT count(*) FILTER (WHERE coalesce(text,'')='') AS no_text, count(*) FILTER (WHERE coalesce(title,'')='') AS no_title, count(*) FILTER (WHERE has_ocr=1) AS ocr, count(*) FILTER (WHERE length(text)>3600) AS oversized FROM evidence_events)
          UNPIVOT (n FOR queue IN (no_text, no_title, ocr, oversized))""")
def queue_counts(spark, d):
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return A.queue_counts(ev(spark, d), {"no_text": blank("text"), "no_title": blank("title"), "ocr": F.col("has_ocr") == 1, "oversized": F.char_length("text") > 3600})


@query("""SELECT status, engine, count(*) AS n, round(avg(CASE WHEN mean_confidence > 1 THEN mean_confidence / 100 ELSE mean_confidence END), 3) AS confidence FROM media_ocr_results GROUP BY ALL""")
def output_status(spark, d):
    c = F.col("mean_confidence").cast("double")
    return table(spark, d, "media_ocr_results").groupBy("status", "engine").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(c > 1, c / 100).otherwise(c)), 3).alias("confidence"))


@query("""SELECT 'ocr' AS output, status, count(*) AS n FROM media_ocr_results GROUP BY ALL UNION ALL SELECT 'canary', status, count(*) FROM ops_canary_runs GROUP BY ALL""")
def output_status_union(spark, d):
    a = table(spark, d, "media_ocr_results").groupBy("status").count().select(F.lit("ocr").alias("output"), "status", F.col("count").alias("n"))
    return a.union(table(spark, d, "ops_canary_runs").groupBy("status").count().select(F.lit("canary"), "status", "count"))


@query("""SELECT split_part(evidence_id, '/', 1) AS prefix, count(*) AS keys, sum(length(coalesce(text_best, '')))::BIGINT AS size FROM evidence_latest GROUP BY 1""")
def kv_prefix_stats(spark, d):
    return table(spark, d, "evidence_latest").groupBy(F.split_part("evidence_id", F.lit("/"), F.lit(1)).alias("prefix")).agg(F.count(F.lit(1)).alias("keys"), F.sum(F.char_length(F.coalesce("text_best", F.lit("")))).alias("size"))


@query("""SELECT topic_name, count(DISTINCT kafka_partition) AS partitions, count(*) AS messages, max(kafka_offset) AS last_offset FROM capture_events GROUP BY 1""")
def topic_partitions(spark, d):
    return table(spark, d, "capture_events").groupBy("topic_name").agg(F.countDistinct("kafka_partition").alias("partitions"), F.count(F.lit(1)).alias("messages"), F.max("kafka_offset").alias("last_offset"))


@query("""SELECT source_kind, source_project, count(*) AS n FROM evidence_events GROUP BY CUBE (source_kind, source_project)""")
def coverage_cube(spark, d):
    return ev(spark, d).cube("source_kind", "source_project").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT source_project, count(*) FILTER (WHERE source_kind='web_page') AS web_page, count(*) FILTER (WHERE source_kind='x_post') AS x_post, count(*) FILTER (WHERE source_kind='media') AS media, count(*) FILTER (WHERE source_kind='search_result') AS search_result FROM evidence_events GROUP BY 1""")
def coverage_pivot(spark, d):
    kinds = ["web_page", "x_post", "media", "search_result"]
    out = ev(spark, d).groupBy("source_project").pivot("source_kind", kinds).count()
    return out.select("source_project", *[F.coalesce(F.col(k), F.lit(0)).alias(k) for k in kinds])


@query("""SELECT source_project, CAST(CASE WHEN n <= 0 THEN 0 ELSE greatest(0, least(100, round_even(100.0 * part / n, 0))) END AS INTEGER) AS percent FROM (SELECT source_project, count(*) AS n, count(*) FILTER (WHERE coalesce(text,'')<>'') AS part FROM evidence_events GROUP BY 1)""")
def percent_completion(spark, d):
    g = ev(spark, d).groupBy("source_project").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("text", F.lit("")) != "").alias("part"))
    return g.select("source_project", S.percent(F.col("part"), F.col("n")).cast("int").alias("percent"))


# ------------------------------------------------------------------ latest state, windows


@query("""SELECT evidence_id, arg_max(coalesce(title, ''), (ingested_at, event_id)) AS title, max(ingested_at) AS last_at, count(*) AS n FROM (SELECT DISTINCT evidence_id, title, ingested_at, event_id FROM evidence_events) GROUP BY 1""")
def latest_source(spark, d):
    e = ev(spark, d).select("evidence_id", "title", "ingested_at", "event_id").distinct()
    return e.groupBy("evidence_id").agg(F.max_by(F.coalesce("title", F.lit("")), F.struct("ingested_at", "event_id")).alias("title"), F.max("ingested_at").alias("last_at"), F.count(F.lit(1)).alias("n"))


@query("""SELECT * EXCLUDE (rn) FROM (SELECT record_id, evidence_id, title, updated_at, row_number() OVER (PARTITION BY evidence_id ORDER BY updated_at DESC, record_id DESC) AS rn FROM evidence_latest) WHERE rn = 1""")
def final_dedup(spark, d):
    t = table(spark, d, "evidence_latest").select("record_id", "evidence_id", "title", "updated_at")
    return A.final_view(t, ["evidence_id"], "updated_at", "record_id").select("record_id", "evidence_id", "title", "updated_at")


@query("""SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1""")
def first_last_per_key(spark, d):
    o = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("event_type", o).alias("first_type"), F.max_by("event_type", o).alias("last_type"))


@query("""SELECT run_id, status, created_at, rn FROM (SELECT run_id, status, created_at, row_number() OVER (PARTITION BY source_project ORDER BY created_at DESC, run_id) AS rn FROM ops_canary_runs) WHERE rn <= 3""")
def topk_per_group(spark, d):
    w = Window.partitionBy("source_project").orderBy(F.desc("created_at"), "run_id")
    return table(spark, d, "ops_canary_runs").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("run_id", "status", "created_at", F.col("rn").cast("long").alias("rn"))


@query("""SELECT event_id, user_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 0 AS positive, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quarter FROM events""")
def running_windows(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", (F.sum("value").over(w.rowsBetween(-2, 0)) > 0).alias("positive"), F.ntile(4).over(w).cast("long").alias("quarter"))


# ------------------------------------------------------------------ filters and projections


@query("""SELECT event_id, evidence_id FROM evidence_events WHERE source_project = 'bench-desk' AND source_kind = 'web_page' AND has_media = 0""")
def exact_filter(spark, d):
    return ev(spark, d).where((F.col("source_project") == "bench-desk") & (F.col("source_kind") == "web_page") & (F.col("has_media") == 0)).select("event_id", "evidence_id")


@query("""SELECT event_id, evidence_id FROM evidence_events WHERE contains(lower(concat_ws(' ', text, title, canonical_url, author_handle, domain, array_to_string(topics, ' '), array_to_string(entities, ' '))), 'benchmark')""")
def substring_filter(spark, d):
    hay = F.lower(F.concat_ws(" ", "text", "title", "canonical_url", "author_handle", "domain", F.array_join("topics", " "), F.array_join("entities", " ")))
    return ev(spark, d).where(hay.contains("benchmark")).select("event_id", "evidence_id")


@query("""SELECT event_id, evidence_id FROM evidence_events WHERE contains(lower(title), 'tool') OR contains(lower(text), 'tool use') OR contains(lower(domain), 'docs')""")
def any_field_filter(spark, d):
    e = ev(spark, d)
    return e.where(F.lower("title").contains("tool") | F.lower("text").contains("tool use") | F.lower("domain").contains("docs")).select("event_id", "evidence_id")


@query("""SELECT event_id, evidence_id, captured_at FROM evidence_events WHERE captured_at >= TIMESTAMP '2025-03-01' AND captured_at <= TIMESTAMP '2025-06-30 23:59:59'""")
def date_range_filter(spark, d):
    c = F.col("captured_at")
    return ev(spark, d).where(c.between(F.lit("2025-03-01").cast("timestamp_ntz"), F.lit("2025-06-30 23:59:59").cast("timestamp_ntz"))).select("event_id", "evidence_id", "captured_at")


@query("""SELECT strftime(coalesce(captured_at, ingested_at), '%Y-%m-%d') AS day, count(*) AS n FROM evidence_events WHERE CAST(coalesce(captured_at, ingested_at) AS DATE) BETWEEN DATE '2025-02-01' AND DATE '2025-05-01' GROUP BY 1""")
def day_range_filter(spark, d):
    day = F.to_date(F.coalesce("captured_at", "ingested_at"))
    return ev(spark, d).where(day.between("2025-02-01", "2025-05-01")).groupBy(F.date_format(day, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, evidence_id, source_kind FROM evidence_events WHERE source_kind IN ('x_post', 'media') AND list_has_any(topics, ['benchmark', 'retrieval']) AND list_contains(topics, 'benchmark')""")
def list_filters(spark, d):
    t = F.col("topics")
    return ev(spark, d).where(F.col("source_kind").isin("x_post", "media") & F.arrays_overlap(t, F.array(F.lit("benchmark"), F.lit("retrieval"))) & F.array_contains(t, "benchmark")).select("event_id", "evidence_id", "source_kind")


@query("""SELECT lower(regexp_replace(author_handle, '^@+', '')) AS handle, count(*) AS n FROM evidence_events WHERE coalesce(author_handle, '') <> '' GROUP BY 1""")
def handle_counts(spark, d):
    h = F.lower(F.regexp_replace("author_handle", "^@+", ""))
    return ev(spark, d).where(F.coalesce("author_handle", F.lit("")) != "").groupBy(h.alias("handle")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT event_id, evidence_id FROM evidence_events WHERE ingested_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""")
def recent_filter(spark, d):
    return ev(spark, d).where(F.col("ingested_at") >= _now() - F.expr("INTERVAL 30 DAY")).select("event_id", "evidence_id")


@query("""SELECT event_id, evidence_id, substring(text, 1, 600) AS preview, length(text) AS n_chars, strlen(text) AS n_bytes FROM evidence_events""")
def preview_lengths(spark, d):
    return ev(spark, d).select("event_id", "evidence_id", F.substring("text", 1, 600).alias("preview"), F.char_length("text").cast("long").alias("n_chars"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("""SELECT event_id, evidence_id, coalesce(json_extract_string(raw_json, '$.document_kind'), '') AS kind, coalesce(nullif(json_extract_string(raw_json, '$.http.status'), ''), '') AS status FROM evidence_events WHERE json_valid(raw_json)""")
def raw_json_fields(spark, d):
    e = ev(spark, d).where(F.try_parse_json("raw_json").isNotNull())
    return e.select("event_id", "evidence_id", S.json_text(F.col("raw_json"), "$.document_kind").alias("kind"), S.json_text(F.col("raw_json"), "$.http.status").alias("status"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_extract_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


# ------------------------------------------------------------------ joins


@query("""SELECT l.evidence_id, l.source_project, count(*) AS records FROM evidence_latest r JOIN (SELECT evidence_id, arg_max(source_project, (ingested_at, event_id)) AS source_project FROM evidence_events GROUP BY 1) l USING (evidence_id) GROUP BY ALL""")
def inner_latest_agg(spark, d):
    latest = ev(spark, d).groupBy("evidence_id").agg(F.max_by("source_project", F.struct("ingested_at", "event_id")).alias("source_project"))
    return table(spark, d, "evidence_latest").select("evidence_id").join(latest, "evidence_id").groupBy("evidence_id", "source_project").agg(F.count(F.lit(1)).alias("records"))


@query("""SELECT record_id FROM evidence_latest r WHERE EXISTS (SELECT 1 FROM evidence_events e WHERE e.evidence_id = r.evidence_id AND e.source_project = 'bench-desk')""")
def semi_scope(spark, d):
    scope = ev(spark, d).where("source_project = 'bench-desk'").select("evidence_id")
    return table(spark, d, "evidence_latest").join(scope, "evidence_id", "left_semi").select("record_id")


@query("""SELECT DISTINCT evidence_id FROM evidence_events e WHERE NOT EXISTS (SELECT 1 FROM evidence_latest r WHERE r.evidence_id = e.evidence_id)""")
def anti_existing(spark, d):
    return labels.only_new(ev(spark, d).select("evidence_id").distinct(), table(spark, d, "evidence_latest"), "evidence_id")


@query("""SELECT media_id FROM (SELECT DISTINCT media_id, sha256 FROM media_observed) m WHERE NOT EXISTS (SELECT 1 FROM media_ocr_results o WHERE o.source_sha256 = m.sha256 AND o.status = 'ok')""")
def anti_done_sha(spark, d):
    done = table(spark, d, "media_ocr_results").where("status = 'ok'").select(F.col("source_sha256").alias("sha256")).distinct()
    return table(spark, d, "media_observed").select("media_id", "sha256").distinct().join(done, "sha256", "left_anti").select("media_id")


@query("""SELECT DISTINCT evidence_id, source_sha256 FROM media_ocr_results o WHERE NOT EXISTS (SELECT 1 FROM media_ocr_results d WHERE d.status = 'ok' AND d.source_sha256 = o.source_sha256 AND d.params_hash = o.params_hash)""")
def exists_done(spark, d):
    t = table(spark, d, "media_ocr_results")
    done = t.where("status = 'ok'").select("source_sha256", "params_hash").distinct()
    return t.join(done, ["source_sha256", "params_hash"], "left_anti").select("evidence_id", "source_sha256").distinct()


@query("""SELECT r.record_id, s.n, s.last_at FROM evidence_latest r LEFT JOIN (SELECT evidence_id, count(*) AS n, max(ingested_at) AS last_at FROM evidence_events GROUP BY 1) s USING (evidence_id)""")
def left_hydrate(spark, d):
    s = ev(spark, d).groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n"), F.max("ingested_at").alias("last_at"))
    return table(spark, d, "evidence_latest").select("record_id", "evidence_id").join(s, "evidence_id", "left").select("record_id", "n", "last_at")


@query("""SELECT m.media_id, coalesce(o.n, 0) AS ocr, coalesce(e.n, 0) AS captures FROM (SELECT DISTINCT media_id FROM media_observed) m
          LEFT JOIN (SELECT evidence_id, count(*) AS n FROM media_ocr_results GROUP BY 1) o ON o.evidence_id = m.media_id LEFT JOIN (SELECT evidence_id, count(*) AS n FROM evidence_events GROUP BY 1) e ON e.evidence_id = m.media_id""")
def left_counts(spark, d):
    base = table(spark, d, "media_observed").select("media_id").distinct()
    return A.left_counts(base, "media_id", {"ocr": (table(spark, d, "media_ocr_results"), "evidence_id"), "captures": (ev(spark, d), "evidence_id")})


@query("""SELECT m.media_id, o.status, o.engine FROM (SELECT DISTINCT media_id FROM media_observed) m LEFT JOIN (SELECT evidence_id, arg_max(status, (created_at, ocr_id)) AS status, arg_max(engine, (created_at, ocr_id)) AS engine FROM media_ocr_results GROUP BY 1) o ON o.evidence_id = m.media_id""")
def left_latest_action(spark, d):
    last = A.latest_by(table(spark, d, "media_ocr_results").withColumnRenamed("evidence_id", "media_id"), ["media_id"], ["created_at", "ocr_id"], ["status", "engine"])
    return table(spark, d, "media_observed").select("media_id").distinct().join(last, "media_id", "left").select("media_id", "status", "engine")


@query("""WITH seed AS (SELECT DISTINCT collector_run_id FROM evidence_events WHERE source_kind = 'user_input') SELECT DISTINCT e.event_id, e.evidence_id FROM evidence_events e JOIN seed USING (collector_run_id)""")
def inspect_runs(spark, d):
    e = ev(spark, d)
    seed = e.where("source_kind = 'user_input'").select("collector_run_id").distinct()
    return e.join(seed, "collector_run_id", "left_semi").select("event_id", "evidence_id").distinct()


@query("""SELECT c.doc_id, count(*) AS mentions FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS w FROM documents) c JOIN (SELECT DISTINCT lower(e) AS w FROM (SELECT unnest(entities) AS e FROM evidence_events)) n ON c.w = n.w GROUP BY 1""")
def theta_entity(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("w"))
    names = ev(spark, d).select(F.explode("entities").alias("e")).select(F.lower("e").alias("w")).distinct()
    return words.join(names, "w").groupBy("doc_id").agg(F.count(F.lit(1)).alias("mentions"))


@query("""SELECT evidence_id, state FROM (SELECT coalesce(a.evidence_id, b.evidence_id) AS evidence_id, CASE WHEN b.evidence_id IS NULL THEN 'missing' WHEN a.evidence_id IS NULL THEN 'extra' WHEN a.n <> b.n THEN 'differs' END AS state
          FROM (SELECT evidence_id, count(*) AS n FROM evidence_events WHERE source_kind='web_page' GROUP BY 1) a FULL OUTER JOIN (SELECT evidence_id, count(*) AS n FROM evidence_latest GROUP BY 1) b ON a.evidence_id = b.evidence_id) WHERE state IS NOT NULL""")
def parity_report(spark, d):
    a = ev(spark, d).where("source_kind = 'web_page'").groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, d, "evidence_latest").groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n"))
    return A.parity(a, b, "evidence_id")


@query("""SELECT c_mktsegment, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def star_join(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 2).alias("avg_price"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ sorts and pages


@query("""SELECT event_id, evidence_id, captured_at FROM evidence_events ORDER BY captured_at DESC, event_id, evidence_id, ingested_at LIMIT 100 OFFSET 50""")
def events_page(spark, d):
    return A.page(ev(spark, d), [F.desc("captured_at"), F.asc("event_id"), F.asc("evidence_id"), F.asc("ingested_at")], 100, 50).select("event_id", "evidence_id", "captured_at")


@query("""SELECT record_id, updated_at FROM evidence_latest WHERE (updated_at, record_id) < (TIMESTAMP '2025-06-01', 0) ORDER BY updated_at DESC, record_id DESC LIMIT 51""")
def cursor_keyset(spark, d):
    t = table(spark, d, "evidence_latest").select("record_id", "updated_at")
    return A.after_key(t, ["updated_at", "record_id"], [F.lit("2025-06-01").cast("timestamp_ntz"), F.lit(0).cast("long")], 50)


@query("""SELECT evidence_id, score FROM (SELECT evidence_id, max(has_media) + max(has_ocr) + least(count(*), 3) AS score, max(ingested_at) AS last_at FROM evidence_events GROUP BY 1) ORDER BY score DESC, last_at DESC, evidence_id LIMIT 12""")
def home_recent(spark, d):
    g = ev(spark, d).groupBy("evidence_id").agg((F.max("has_media") + F.max("has_ocr") + F.least(F.count(F.lit(1)), F.lit(3))).alias("score"), F.max("ingested_at").alias("last_at"))
    return g.orderBy(F.desc("score"), F.desc("last_at"), F.asc("evidence_id")).limit(12).select("evidence_id", F.col("score").cast("long"))


# ------------------------------------------------------------------ sets


@query("""SELECT 'web' AS origin, canonical_url AS url FROM evidence_latest WHERE canonical_url <> '' UNION SELECT 'post', canonical_url FROM evidence_events WHERE source_kind = 'x_post' AND canonical_url <> ''""")
def distinct_union(spark, d):
    a = table(spark, d, "evidence_latest").where("canonical_url <> ''").select(F.lit("web").alias("origin"), F.col("canonical_url").alias("url"))
    return a.union(ev(spark, d).where("source_kind = 'x_post' AND canonical_url <> ''").select(F.lit("post"), "canonical_url")).distinct()


@query("""SELECT evidence_id FROM evidence_events WHERE source_kind = 'web_page' EXCEPT SELECT evidence_id FROM evidence_latest""")
def except_sets(spark, d):
    return ev(spark, d).where("source_kind = 'web_page'").select("evidence_id").subtract(table(spark, d, "evidence_latest").select("evidence_id"))


@query("""SELECT domain FROM evidence_events WHERE domain IS NOT NULL INTERSECT SELECT domain FROM evidence_latest""")
def intersect_sets(spark, d):
    return ev(spark, d).where("domain IS NOT NULL").select("domain").intersect(table(spark, d, "evidence_latest").select("domain"))


@query("""SELECT event_id, list_distinct(list_filter(list_transform(coalesce(topics, []), lambda x: trim(x)), lambda x: x <> '')) ::VARCHAR[] IS NOT NULL AS ok, len(list_distinct(list_filter(list_transform(coalesce(topics, []), lambda x: trim(x)), lambda x: x <> ''))) AS n_topics FROM evidence_events""")
def distinct_list(spark, d):
    c = S.clean_list(F.col("topics"))
    return ev(spark, d).select("event_id", c.isNotNull().alias("ok"), F.size(c).cast("long").alias("n_topics"))


@query("""SELECT 'capture' AS kind, evidence_id, captured_at AS at FROM evidence_events WHERE captured_at IS NOT NULL UNION ALL SELECT 'record', evidence_id, last_seen_at FROM evidence_latest WHERE last_seen_at IS NOT NULL""")
def timeline_union(spark, d):
    a = ev(spark, d).where("captured_at IS NOT NULL").select(F.lit("capture").alias("kind"), "evidence_id", F.col("captured_at").alias("at"))
    return a.union(table(spark, d, "evidence_latest").where("last_seen_at IS NOT NULL").select(F.lit("record"), "evidence_id", "last_seen_at"))


@query("""SELECT evidence_id, title FROM (SELECT evidence_id, title, row_number() OVER (PARTITION BY evidence_id ORDER BY prio, seen_at, tie) AS rn FROM (SELECT evidence_id, title, 0 AS prio, updated_at AS seen_at, record_id::VARCHAR AS tie FROM evidence_latest UNION ALL SELECT evidence_id, title, 1, ingested_at, event_id FROM evidence_events)) WHERE rn = 1""")
def merge_first(spark, d):
    a = table(spark, d, "evidence_latest").select("evidence_id", "title", F.col("updated_at").alias("at"), F.col("record_id").cast("string").alias("tie"))
    b = ev(spark, d).select("evidence_id", "title", F.col("ingested_at").alias("at"), F.col("event_id").alias("tie"))
    return A.merge_first([a, b], ["evidence_id"], ["at", "tie"]).select("evidence_id", "title")


# ------------------------------------------------------------------ scalars


@query("""SELECT event_id, evidence_id, sha256(coalesce(collector_run_id,'') || chr(0) || coalesce(evidence_id,'') || chr(0)) AS hash, 'ann_' || substring(sha256(coalesce(evidence_id,'') || chr(0) || coalesce(source_kind,'') || chr(0)), 1, 24) AS short FROM evidence_events""")
def stable_hash_ids(spark, d):
    return ev(spark, d).select("event_id", "evidence_id", S.stable_hash(F.col("collector_run_id"), F.col("evidence_id")).alias("hash"), S.short_id("ann", F.col("evidence_id"), F.col("source_kind")).alias("short"))


@query("""SELECT DISTINCT t AS topic, trim(regexp_replace(lower(trim(t)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM (SELECT unnest(topics) AS t FROM evidence_events)""")
def slug_labels(spark, d):
    t = ev(spark, d).select(F.explode("topics").alias("topic")).distinct()
    return t.select("topic", S.slug(F.col("topic")).alias("slug"))


@query("""SELECT event_id, evidence_id, coalesce(regexp_replace(lower(regexp_extract(canonical_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', ''), '') AS host FROM evidence_events""")
def host_domain(spark, d):
    return ev(spark, d).select("event_id", "evidence_id", S.host(F.col("canonical_url")).alias("host"))


@query("""SELECT event_id, evidence_id, lower(coalesce(regexp_extract(canonical_url, '(?i)(?:x|twitter)\\.com/([^/\\s?#]+)/status/(\\d+)', 1), '')) AS handle, coalesce(regexp_extract(canonical_url, '(?i)(?:x|twitter)\\.com/([^/\\s?#]+)/status/(\\d+)', 2), '') AS status_id FROM evidence_events WHERE source_kind IN ('x_post', 'search_result')""")
def status_regex(spark, d):
    e = ev(spark, d).where(F.col("source_kind").isin("x_post", "search_result"))
    return e.select("event_id", "evidence_id", S.status_handle(F.col("canonical_url")).alias("handle"), S.status_id(F.col("canonical_url")).alias("status_id"))


@query("""SELECT doc_id, len(list_distinct(regexp_extract_all(text, 'https?://[^\\s<>"'')\\]]+'))) AS n_urls FROM documents WHERE text IS NOT NULL""")
def url_counts(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(S.urls_in(F.col("text"))).cast("long").alias("n_urls"))


@query("""SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1 ORDER BY n DESC, w LIMIT 200""")
def explode_tokens_topn(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("w")).limit(200)


@query("""SELECT record_id, strftime(first_seen_at, '%Y%m') AS month, strftime(first_seen_at, '%Y-%m-%d') AS day, epoch(date_trunc('second', first_seen_at))::BIGINT AS unix FROM evidence_latest""")
def time_parts(spark, d):
    t = F.col("first_seen_at")
    return table(spark, d, "evidence_latest").select("record_id", F.date_format(t, "yyyyMM").alias("month"), F.date_format(t, "yyyy-MM-dd").alias("day"), F.unix_timestamp(t.cast("timestamp")).alias("unix"))


@query("""SELECT media_id, CASE lower(regexp_extract(coalesce(nullif(trim(local_path), ''), url, ''), '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'webp' THEN 'image/webp' WHEN 'gif' THEN 'image/gif' WHEN 'pdf' THEN 'application/pdf' WHEN 'mp4' THEN 'video/mp4' WHEN 'mov' THEN 'video/quicktime' WHEN 'webm' THEN 'video/webm' ELSE 'image/png' END AS mime FROM media_observed""")
def mime_types(spark, d):
    return table(spark, d, "media_observed").select("media_id", S.mime_of(F.coalesce(F.nullif(F.trim("local_path"), F.lit("")), F.col("url"))).alias("mime"))


@query("""SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20""")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.groupBy().agg(F.min_by("embedding", "vec_id").alias("q"))
    hit = retrieval.vector_of(e, q, "text_dense", 20, ident="vec_id")
    return hit.select(F.col("evidence_id").alias("vec_id"), F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ labels and plans


@query("""SELECT event_id, evidence_id, CASE source_kind WHEN 'x_post' THEN 'source.x.post' WHEN 'x_account' THEN 'source.x.profile' WHEN 'search_result' THEN 'source.search.result' WHEN 'web_page' THEN 'source.web.page' WHEN 'user_input' THEN 'source.user.input' WHEN 'media' THEN 'source.media' WHEN 'capture' THEN 'source.capture' END AS label FROM evidence_events""")
def source_labels(spark, d):
    return ev(spark, d).select("event_id", "evidence_id", labels.source_label(F.col("source_kind")).alias("label"))


@query("""WITH h AS (SELECT event_id, evidence_id, source_kind, coalesce(domain,'') AS domain, lower(concat_ws(' ', coalesce(trim(source_kind),''), coalesce(trim(domain),''), coalesce(trim(canonical_url),''), coalesce(trim(title),''), coalesce(text,''))) AS hay FROM evidence_events WHERE source_kind = 'web_page')
          SELECT event_id, evidence_id, CASE WHEN contains(hay, '.pdf') THEN 'form.pdf' WHEN contains(domain, 'github.com') AND (contains(hay, '/blob/') OR contains(hay, '/tree/')) THEN 'form.github_file' WHEN contains(domain, 'github.com') THEN 'form.github_repo'
          WHEN contains(hay,'leaderboard') OR contains(hay,'rank') OR contains(hay,'score') OR contains(hay,'benchmark') THEN 'form.leaderboard' WHEN contains(hay,'docs') OR contains(hay,'documentation') OR contains(hay,'reference') THEN 'form.docs_page'
          WHEN contains(hay,'pricing') OR contains(hay,'price') OR contains(hay,'$/mo') OR contains(hay,'free plan') OR contains(hay,'enterprise plan') THEN 'form.pricing_page' WHEN contains(hay,'model card') OR contains(hay,'model-card') THEN 'form.model_card'
          WHEN contains(hay,'blog') OR contains(hay,'release notes') OR contains(hay,'announcing') OR contains(hay,'launching') THEN 'form.blog_post' ELSE 'form.web_page' END AS label FROM h""")
def content_form_labels(spark, d):
    e = labels.with_haystacks(ev(spark, d).where("source_kind = 'web_page'"))
    return e.select("event_id", "evidence_id", labels.form_label()["label"].alias("label"))


@query("""SELECT event_id, evidence_id, has_ocr = 1 AS has_ocr, coalesce(canonical_url,'') <> '' AND source_kind = 'web_page' AS direct, source_kind = 'user_input' AS user_supplied FROM evidence_events""")
def quality_action_labels(spark, d):
    e = ev(spark, d).select("event_id", "evidence_id", labels.quality_labels().alias("q"))
    has = lambda x: F.array_contains("q", x)
    return e.select("event_id", "evidence_id", has("quality.has_ocr").alias("has_ocr"), has("quality.direct_web_capture").alias("direct"), has("quality.user_supplied").alias("user_supplied"))


# ------------------------------------------------------------------ retrieval, documents


@query("""WITH q AS (SELECT lower(min(author_handle)) AS h FROM evidence_events WHERE author_handle <> ''), n AS (SELECT evidence_id, max(epoch(date_trunc('second', ingested_at)))::DOUBLE AS score FROM evidence_events, q WHERE lower(regexp_replace(author_handle, '^@+', '')) = ltrim(h, '@') GROUP BY 1)
          SELECT evidence_id, row_number() OVER (ORDER BY score DESC, evidence_id) AS rank FROM n ORDER BY score DESC, evidence_id LIMIT 20""")
def exact_candidates(spark, d):
    """Rows of one handle; the handle itself is looked up, as a request would bring it."""
    e = ev(spark, d)
    handle = e.where("author_handle <> ''").agg(F.min("author_handle")).first()[0] or ""
    return retrieval.exact(e, f"@{handle}", 20).select("evidence_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH h AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(title,'') || ' ' || coalesce(text,'')), '[^\\p{L}\\p{N}]+') AS w FROM documents) SELECT doc_id FROM h WHERE list_has_any(w, ['leaderboard', 'checksum'])""")
def keyword_match_set(spark, d):
    return retrieval.keyword_scores(table(spark, d, "documents"), "leaderboard checksum", {"title": 1.0, "text": 1.0}, "doc_id").select("doc_id")


_BM25 = """WITH h AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(title,'') || ' ' || coalesce(title,'') || ' ' || coalesce(text,'')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
    t AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'normalizer')) AS a, len(list_filter(w, lambda x: x = 'retrieval')) AS b FROM h),
    s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM t),
    r AS (SELECT doc_id, ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) AS score FROM t, s WHERE a > 0 OR b > 0)"""


@query(_BM25 + " SELECT doc_id, round(score, 6) AS score FROM r")
def keyword_scores(spark, d):
    hits = retrieval.keyword_scores(table(spark, d, "documents"), "retrieval normalizer", {"title": 2.0, "text": 1.0}, "doc_id")
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query(_BM25 + " SELECT doc_id AS evidence_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r ORDER BY score DESC, doc_id LIMIT 50")
def keyword_candidates(spark, d):
    hits = retrieval.keyword(table(spark, d, "documents"), "retrieval normalizer", {"title": 2.0, "text": 1.0}, 50, ident="doc_id")
    return hits.select("evidence_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings WHERE label < 5 ORDER BY vec_id LIMIT 40), b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) AS r FROM embeddings ORDER BY vec_id DESC LIMIT 40)
          SELECT vec_id, round(sum(s), 9) AS score FROM (SELECT vec_id, 4.0 / (60 + r) AS s FROM a UNION ALL SELECT vec_id, 1.2 / (60 + r) FROM b) GROUP BY 1""")
def rrf_fusion(spark, d):
    e = table(spark, d, "embeddings")
    a = retrieval.ranked(e.where("label < 5").withColumn("s", -F.col("vec_id")), "exact", "s", "vec_id", 40)
    b = retrieval.ranked(e.withColumn("s", F.col("vec_id")), "keyword", "s", "vec_id", 40)
    return retrieval.fuse([a, b]).select(F.col("evidence_id").alias("vec_id"), F.round("score", 9).alias("score"))


@query()
def hybrid_search(spark, d):
    """A request through all its branches; vectors are the labelled stand-in, branches without points are told as such."""
    e = A.latest_by(ev(spark, d).select("evidence_id", "title", "text", "canonical_url", "author_handle", "source_kind", "ingested_at", "event_id"), ["evidence_id"], ["ingested_at", "event_id"])
    q = spark.range(1).select(retrieval.stand_in_embedding(F.lit("leaderboard retrieval")).alias("q"))
    points = e.select("evidence_id", retrieval.stand_in_embedding(F.concat_ws(" ", "title", "text")).alias("embedding"))
    branches = {
        "exact": lambda r: retrieval.exact(e, r["query"], r["branch_limit"]),
        "keyword": lambda r: retrieval.keyword(e, r["query"], {"title": 2.0, "text": 1.0}, r["branch_limit"]),
        "text_dense": lambda r: retrieval.vector_of(points, q, "text_dense", r["branch_limit"]),
    }
    hits, _ = retrieval.search({"query": "leaderboard retrieval", "mode": "precision"}, branches, e.select("evidence_id", "title"), lambda c: -F.char_length(F.coalesce(c, F.lit(""))))
    return hits.select("evidence_id", "title", F.round("score", 9).alias("score"))


@query()
def document_chunks(spark, d):
    return documents.chunk_documents(table(spark, d, "documents"), "doc_id", "text")


_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[ \\t\\x0B\\x0C\\x{{A0}}]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160))"


@query(
    "WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\n\\s*\\n'), lambda x: " + _CLEAN.format(x="x") + "), lambda x: x <> '') AS p, "
    "list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]'), lambda x: " + _CLEAN.format(x="x") + "), lambda x: x <> '') AS l FROM documents), "
    "b AS (SELECT doc_id, CASE WHEN len(p) > 3 THEN p ELSE l END AS parts FROM p), "
    "c AS (SELECT doc_id, flatten(list_transform(parts, lambda x: CASE WHEN length(x) <= 1800 THEN [x] ELSE list_transform(range(0, length(x), 1400), lambda i: substring(x, i + 1, 1400)) END)) AS blocks FROM b) "
    "SELECT doc_id, len(blocks) AS n_blocks FROM c"
)
def document_blocks(spark, d):
    b = documents.evidence_blocks(table(spark, d, "documents").withColumn("title", F.lit("")), "doc_id", "title", "text")
    return b.select("doc_id", (F.size("blocks") + F.col("omitted")).cast("long").alias("n_blocks"))
