"""Further read-model queries: groups, conflicts, comparisons, tasks, state look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import scalars as S
from gleanery.operators import analytics as A
from gleanery.operators import tasks
from gleanery.plans.reference import ORACLES, QUERIES, ev, query  # noqa: F401
from gleanery.sources import sinks, table


@query("""SELECT lower(trim(e)) AS identity, min(e) AS canonical, len(list_distinct(list(e))) AS names, count(DISTINCT evidence_id) AS sources, CASE WHEN len(list_distinct(list(e))) > 1 OR count(*) > 1 THEN 'merge_cluster' ELSE 'single' END AS kind FROM (SELECT evidence_id, unnest(entities) AS e FROM evidence_latest) WHERE trim(e) <> '' GROUP BY 1""")
def canonical_groups(spark, d):
    e = table(spark, d, "evidence_latest").select("evidence_id", F.explode("entities").alias("e")).where(F.trim("e") != "")
    g = e.groupBy(F.lower(F.trim("e")).alias("identity")).agg(F.min("e").alias("canonical"), F.countDistinct("e").alias("names"), F.countDistinct("evidence_id").alias("sources"), F.count(F.lit(1)).alias("n"))
    return g.select("identity", "canonical", "names", "sources", F.when((F.col("names") > 1) | (F.col("n") > 1), "merge_cluster").otherwise("single").alias("kind"))


@query("""SELECT evidence_id, array_to_string(list_sort(list_filter(list_distinct(list(title)), lambda x: x <> m)), '|') AS aliases FROM (SELECT evidence_id, title, min(title) OVER (PARTITION BY evidence_id) AS m FROM evidence_latest WHERE title IS NOT NULL) GROUP BY evidence_id, m""")
def alias_minus(spark, d):
    g = table(spark, d, "evidence_latest").where("title IS NOT NULL").groupBy("evidence_id").agg(F.sort_array(F.collect_set("title")).alias("t"), F.min("title").alias("m"))
    return g.select("evidence_id", F.array_join(F.array_except("t", F.array("m")), "|").alias("aliases"))


@query("""SELECT doc_id, CASE WHEN contains(t, ':') THEN trim(split_part(t, ':', 1)) WHEN contains(t, ' is ') THEN trim(split_part(t, ' is ', 1)) ELSE '' END AS subject, contains(t, ':') OR contains(t, ' is ') AS has_sign FROM (SELECT doc_id, trim(title) AS t FROM documents WHERE title IS NOT NULL)""")
def claim_subjects(spark, d):
    t = table(spark, d, "documents").where("title IS NOT NULL").select("doc_id", F.trim("title").alias("t"))
    p = S.claim_parts(F.col("t"))
    return t.select("doc_id", p["subject"].alias("subject"), (F.col("t").contains(":") | F.col("t").contains(" is ")).alias("has_sign"))


@query("""SELECT 'source_kind' AS term_type, source_kind AS term, count(*) AS usage FROM evidence_events GROUP BY ALL UNION ALL SELECT 'capture_method', capture_method, count(*) FROM evidence_events GROUP BY ALL
          UNION ALL SELECT 'media_kind', media_kind, count(*) FROM media_observed GROUP BY ALL UNION ALL SELECT 'artifact_role', artifact_role, count(*) FROM media_ocr_results GROUP BY ALL""")
def taxonomy_usage(spark, d):
    parts = [(ev(spark, d), "source_kind"), (ev(spark, d), "capture_method"), (table(spark, d, "media_observed"), "media_kind"), (table(spark, d, "media_ocr_results"), "artifact_role")]
    out = None
    for df, c in parts:
        one = df.groupBy(F.col(c).alias("term")).agg(F.count(F.lit(1)).alias("usage")).select(F.lit(c).alias("term_type"), "term", "usage")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT evidence_id, arg_max(coalesce(title, ''), (captured_at, event_id)) AS title, max(captured_at) AS captured_at FROM (SELECT DISTINCT evidence_id, title, captured_at, event_id FROM evidence_events WHERE captured_at IS NOT NULL) GROUP BY 1""")
def backfill_latest(spark, d):
    e = ev(spark, d).where("captured_at IS NOT NULL").select("evidence_id", F.coalesce("title", F.lit("")).alias("title"), "captured_at", "event_id").distinct()
    return A.latest_by(e, ["evidence_id"], ["captured_at", "event_id"], ["title", "captured_at"])


@query("""SELECT record_id, evidence_id FROM evidence_latest WHERE starts_with(evidence_id, 'web_document/0')""")
def state_prefix(spark, d):
    return sinks.scan_prefix(table(spark, d, "evidence_latest"), "web_document/0", "evidence_id").select("record_id", "evidence_id")


@query("""SELECT vec_id, label FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 16""")
def vector_scroll(spark, d):
    return table(spark, d, "embeddings").where("label = 3").orderBy("vec_id").limit(16).select("vec_id", "label")


@query("""SELECT evidence_id, vector_name, length(text) AS n FROM (SELECT DISTINCT evidence_id, CASE source_kind WHEN 'x_account' THEN 'account_dense' WHEN 'media' THEN 'ocr_dense' ELSE 'text_dense' END AS vector_name, rtrim(substring(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)), 1, 4000), ' ') AS text FROM evidence_events WHERE source_kind <> 'media' AND coalesce(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)), '') <> '')""")
def embedding_tasks(spark, d):
    t = tasks.embedding_tasks(ev(spark, d).where("source_kind <> 'media'"))
    return t.select("evidence_id", "vector_name", F.char_length("text").cast("long").alias("n"))


@query()
def embedding_tasks_all(spark, d):
    """The tasks of all rows; ``embedding_tasks`` and its SQL leave media out."""
    t = tasks.embedding_tasks(ev(spark, d))
    return t.select("evidence_id", "vector_name", F.char_length("text").cast("long").alias("n"))


@query("""WITH m AS (SELECT media_id, arg_max(sha256, (captured_at, observation_id)) AS sha256, max(captured_at) AS captured_at FROM media_observed GROUP BY 1), o AS (SELECT * FROM m WHERE coalesce(sha256 NOT IN (SELECT source_sha256 FROM media_ocr_results WHERE status = 'ok' AND source_sha256 IS NOT NULL), true) ORDER BY captured_at DESC, media_id LIMIT 100)
          SELECT media_id, sha256, unnest(['ocr', 'vl', 'embed']) AS lane FROM o""")
def media_router(spark, d):
    return tasks.route_media(table(spark, d, "media_observed"), table(spark, d, "media_ocr_results"))


@query()
def research_chunks(spark, d):
    return tasks.research_chunks(table(spark, d, "documents"), "doc_id", "text", "tool-atlas")


@query("""WITH r AS (SELECT evidence_id, row_number() OVER (ORDER BY n DESC, evidence_id) AS rank FROM (SELECT evidence_id, count(*) AS n FROM evidence_events GROUP BY 1)) SELECT run_id, min(rank) AS best_rank FROM (SELECT run_id, unnest(evidence_ids) AS evidence_id FROM ops_canary_runs) c JOIN r USING (evidence_id) WHERE rank <= 1000 GROUP BY 1""")
def canary_rank(spark, d):
    from pyspark.sql import Window

    top = ev(spark, d).groupBy("evidence_id").count().orderBy(F.desc("count"), F.asc("evidence_id")).limit(1000)
    r = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), F.asc("evidence_id"))))
    ids = table(spark, d, "ops_canary_runs").select("run_id", F.explode("evidence_ids").alias("evidence_id"))
    return ids.join(r, "evidence_id").groupBy("run_id").agg(F.min("rank").cast("long").alias("best_rank"))


@query()
def canary_rank_all(spark, d):
    """Ranks without the bound of ``canary_rank`` and its SQL; runs without a hit have null."""
    return A.first_ranks(ev(spark, d), table(spark, d, "ops_canary_runs"))


@query("""SELECT evidence_id, count(DISTINCT event_id) AS events, count(*) FILTER (via = 'link') AS by_link FROM (SELECT evidence_id, event_id, 'own' AS via FROM evidence_events UNION ALL SELECT l.evidence_id, e.event_id, 'link' FROM evidence_latest l JOIN (SELECT DISTINCT event_id, unnest(links) AS link FROM evidence_events) e ON e.link = l.canonical_url) GROUP BY 1""")
def event_subject(spark, d):
    e = ev(spark, d)
    own = e.select("evidence_id", "event_id", F.lit("own").alias("via"))
    links = e.select("event_id", F.explode("links").alias("canonical_url")).distinct()
    linked = table(spark, d, "evidence_latest").select("evidence_id", "canonical_url").join(links, "canonical_url").select("evidence_id", "event_id", F.lit("link").alias("via"))
    return own.union(linked).groupBy("evidence_id").agg(F.countDistinct("event_id").alias("events"), F.count_if(F.col("via") == "link").alias("by_link"))


@query("""SELECT m.media_id, array_to_string(list_sort(list_distinct(list(o.ocr_id) FILTER (o.ocr_id IS NOT NULL))), '|') AS runs FROM (SELECT DISTINCT media_id FROM media_observed) m LEFT JOIN media_ocr_results o ON o.evidence_id = m.media_id GROUP BY 1 HAVING count(o.ocr_id) > 0""")
def group_links(spark, d):
    runs = table(spark, d, "media_ocr_results").groupBy(F.col("evidence_id").alias("media_id")).agg(F.array_join(F.sort_array(F.collect_set("ocr_id")), "|").alias("runs"))
    return table(spark, d, "media_observed").select("media_id").distinct().join(runs, "media_id")


@query("""SELECT source_kind, strftime(captured_at, '%Y%m') AS month, count(*) AS n, count(DISTINCT domain) AS domains FROM evidence_events WHERE captured_at IS NOT NULL GROUP BY ALL""")
def monthly_partitions(spark, d):
    return ev(spark, d).where("captured_at IS NOT NULL").groupBy("source_kind", F.date_format("captured_at", "yyyyMM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("domain").alias("domains"))
