"""Queries of the read models, each beside its SQL. Claims are made of the documents, sources the captured evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import scalars as S
from gleanery.operators import analytics as A
from gleanery.operators import documents, retrieval
from gleanery.operators import readmodels as R
from gleanery.plans.ingest_plans import _WS
from gleanery.plans.reference import ev, query
from gleanery.sources import table

# ------------------------------------------------------------------ sources and library

_SOURCES = """s AS (SELECT evidence_id, arg_max({'p': source_project, 'k': source_kind, 'u': canonical_url, 'h': author_handle, 'd': domain, 't': title, 'n': length(text), 'c': captured_at, 'o': posted_at}, (ingested_at, event_id)) AS r,
    max(has_media) AS has_media, max(has_ocr) AS has_ocr, max(ingested_at) AS last_ingested_at, min(captured_at) AS first_captured_at, count(*) AS observations FROM evidence_events GROUP BY 1)"""


def _sources(spark, d):
    return R.sources(ev(spark, d))


@query(f"WITH {_SOURCES} SELECT evidence_id, r.p AS source_project, r.k AS source_kind, r.d AS domain, r.t AS title, r.n::BIGINT AS text_chars, has_media, has_ocr, last_ingested_at, first_captured_at, observations FROM s")
def source_rows(spark, d):
    return _sources(spark, d).select("evidence_id", "source_project", "source_kind", "domain", "title", F.col("text_chars").cast("long").alias("text_chars"), "has_media", "has_ocr", "last_ingested_at", "first_captured_at", "observations")


_HINT = "CASE WHEN r.k = 'media' AND coalesce(has_ocr, 0) = 0 THEN 'Needs OCR/VL review' WHEN coalesce(r.n, 0) = 0 THEN 'Extraction empty' WHEN observations > 1 THEN 'Multiple captures' WHEN r.k IN ('x_post', 'web_page', 'user_input') THEN 'Ready for evidence selection' ELSE 'Triage' END"


@query(f"WITH {_SOURCES} SELECT evidence_id, {_HINT} AS hint FROM s")
def review_hints(spark, d):
    return _sources(spark, d).select("evidence_id", R.review_hint().alias("hint"))


_ACTIONS = "a AS (SELECT evidence_id, arg_max(CASE status WHEN 'ok' THEN 'keep' ELSE 'archive' END, (created_at, CASE status WHEN 'ok' THEN 'keep' ELSE 'archive' END)) AS action FROM media_ocr_results GROUP BY 1)"


def _library(spark, d, archived=False):
    """Latest actions stand in by recognition runs: what failed last is archived."""
    runs = table(spark, d, "media_ocr_results")
    actions = runs.select("evidence_id", F.when(F.col("status") == "ok", "keep").otherwise("archive").alias("action"), F.col("created_at").alias("at"))
    counts = {"ocr_runs": (runs, "evidence_id"), "media_rows": (table(spark, d, "media_observed"), "media_id"), "records": (table(spark, d, "evidence_latest"), "evidence_id")}
    return R.library(_sources(spark, d), counts, actions, archived)


@query(
    f"WITH {_SOURCES}, {_ACTIONS} SELECT s.evidence_id, coalesce(o.n, 0) AS ocr_runs, coalesce(m.n, 0) AS media_rows, coalesce(l.n, 0) AS records FROM s LEFT JOIN a ON a.evidence_id = s.evidence_id LEFT JOIN (SELECT evidence_id, count(*) AS n FROM media_ocr_results GROUP BY 1) o ON o.evidence_id = s.evidence_id "
    "LEFT JOIN (SELECT media_id, count(*) AS n FROM media_observed GROUP BY 1) m ON m.media_id = s.evidence_id LEFT JOIN (SELECT evidence_id, count(*) AS n FROM evidence_latest GROUP BY 1) l ON l.evidence_id = s.evidence_id WHERE coalesce(a.action, '') <> 'archive'"
)
def library_rows(spark, d):
    return _library(spark, d).select("evidence_id", "ocr_runs", "media_rows", "records")


@query(f"WITH {_SOURCES}, {_ACTIONS} SELECT CASE WHEN a.action = 'archive' THEN 'archived' ELSE 'active' END AS archive_state, count(*) AS n, sum(observations)::BIGINT AS observations, count(*) FILTER (has_media = 1) AS with_media, count(*) FILTER (has_ocr = 1) AS with_ocr, count(*) FILTER (coalesce(r.n, 0) = 0) AS empty FROM s LEFT JOIN a USING (evidence_id) GROUP BY 1")
def library_summary(spark, d):
    g = _library(spark, d, archived=True).groupBy("archive_state")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("observations").alias("observations"), F.count_if(F.col("has_media") == 1).alias("with_media"), F.count_if(F.col("has_ocr") == 1).alias("with_ocr"), F.count_if(F.coalesce("text_chars", F.lit(0)) == 0).alias("empty"))


@query(f"WITH {_SOURCES} SELECT publisher, count(*) AS n, count(*) FILTER (has_ocr = 1) AS recognised, count(*) FILTER (coalesce(n, 0) > 0) AS extracted FROM (SELECT coalesce(nullif(r.d, ''), nullif(r.h, ''), 'unknown') AS publisher, has_ocr, r.n AS n FROM s) GROUP BY 1")
def library_facets(spark, d):
    key = F.coalesce(F.nullif("domain", F.lit("")), F.nullif("author_handle", F.lit("")), F.lit("unknown"))
    return _sources(spark, d).groupBy(key.alias("publisher")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("has_ocr") == 1).alias("recognised"), F.count_if(F.coalesce("text_chars", F.lit(0)) > 0).alias("extracted"))


def _page(sort: str):
    def run(spark, d):
        return _sources(spark, d).orderBy(*R.library_order(sort)).limit(50).select("evidence_id", "observations")

    return run


for _name, _columns in R.SORTS.items():
    _f = _page(_name)
    _f.__name__ = f"library_{_name}"
    _by = {"last_ingested_at": "last_ingested_at", "captured_at": "r.c", "posted_at": "r.o", "has_media": "has_media", "has_ocr": "has_ocr", "observations": "observations"}
    query(f"WITH {_SOURCES} SELECT evidence_id, observations FROM s ORDER BY " + ", ".join(f"{_by[c]} DESC NULLS LAST" for c in _columns) + ", evidence_id LIMIT 50")(_f)


@query("SELECT coalesce(nullif(trim(lang), ''), 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1")
def facet_with_unknown(spark, d):
    return R.facet_counts(table(spark, d, "documents"), "lang")


@query("SELECT trim(lang) AS value, count(*) AS n FROM documents WHERE trim(coalesce(lang, '')) <> '' GROUP BY 1")
def facet_of_known(spark, d):
    return R.facet_counts(table(spark, d, "documents"), "lang", None)


_KEYED = "k AS (SELECT DISTINCT evidence_id AS member, link, trim(key) AS key FROM (SELECT evidence_id, unnest(['canonical_url', 'author_handle', 'domain']) AS link, unnest([canonical_url, author_handle, domain]) AS key FROM evidence_events) WHERE trim(coalesce(key, '')) <> '')"


@query(f"WITH {_KEYED}, c AS (SELECT link, key, count(*) AS members, min(member) AS representative FROM k GROUP BY 1, 2 HAVING count(*) > 1) SELECT member, link, members, representative FROM k JOIN c USING (link, key)")
def related_sources(spark, d):
    """Sources that share an address, an author or a site: classes with their members, never pairs."""
    return R.related_classes(ev(spark, d), "evidence_id", ["canonical_url", "author_handle", "domain"]).drop("class_id")


@query("WITH o AS (SELECT min(evidence_id) AS id FROM evidence_latest), w AS (SELECT * FROM evidence_latest, o WHERE evidence_id = id) SELECT DISTINCT e.evidence_id FROM evidence_latest e, o WHERE e.evidence_id <> id AND ((trim(coalesce(e.canonical_url, '')) <> '' AND trim(e.canonical_url) IN (SELECT trim(canonical_url) FROM w)) OR (trim(coalesce(e.domain, '')) <> '' AND trim(e.domain) IN (SELECT trim(domain) FROM w)))")
def related_to_one(spark, d):
    """The sources related to one; which one is looked up, as a request would bring it."""
    rows = table(spark, d, "evidence_latest")
    one = rows.agg(F.min("evidence_id")).first()[0] or ""
    return R.related_to(rows, "evidence_id", one, ["canonical_url", "domain"])


@query("WITH o AS (SELECT min(collector_run_id) AS q FROM evidence_events), s AS (SELECT DISTINCT collector_run_id FROM evidence_events, o WHERE evidence_id = q OR collector_run_id = q OR canonical_url = q OR coalesce(list_contains(links, q), false) OR contains(lower(coalesce(raw_json, '')), lower(q))) SELECT DISTINCT event_id FROM evidence_events JOIN s USING (collector_run_id)")
def inspect_run(spark, d):
    """What was captured with one run's records; which run is looked up, as a request would bring it."""
    e = ev(spark, d)
    return R.inspect(e, e.agg(F.min("collector_run_id")).first()[0] or "").select("event_id")


@query("WITH l AS (SELECT source_kind, arg_max({'e': event_id, 'i': evidence_id, 'n': length(text)}, (coalesce(length(text), 0), event_id, evidence_id)) AS r FROM evidence_events GROUP BY 1) SELECT source_kind, r.e AS event_id, r.i AS evidence_id, r.n::BIGINT AS text_chars FROM l")
def longest_texts(spark, d):
    return R.longest_by_kind(ev(spark, d)).select("source_kind", "event_id", "evidence_id", F.col("text_chars").cast("long").alias("text_chars"))


@query("WITH r AS (SELECT min(collector_run_id) AS run FROM evidence_events) SELECT event_id, evidence_id, captured_at FROM evidence_events, r WHERE collector_run_id = run ORDER BY captured_at, event_id, evidence_id LIMIT 1000")
def run_trace(spark, d):
    e = ev(spark, d)
    run = e.agg(F.min("collector_run_id").alias("run"))
    return e.join(F.broadcast(run), F.col("collector_run_id") == F.col("run")).orderBy("captured_at", "event_id", "evidence_id").limit(1000).select("event_id", "evidence_id", "captured_at")


# ------------------------------------------------------------------ tasks and ledgers

_RULES = {
    "media_text": ("r.k = 'media' AND coalesce(has_ocr, 0) = 0", "high"),
    "empty_extraction": ("coalesce(r.n, 0) = 0", "blocking"),
    "version_review": ("observations > 1", "normal"),
    "select_evidence": ("r.k IN ('x_post', 'web_page', 'user_input') AND coalesce(r.n, 0) > 0", "normal"),
}


def _tasks(spark, d):
    empty = F.coalesce("text_chars", F.lit(0)) == 0
    rules = {
        "media_text": ((F.col("source_kind") == "media") & (F.coalesce("has_ocr", F.lit(0)) == 0), "high"),
        "empty_extraction": (empty, "blocking"),
        "version_review": (F.col("observations") > 1, "normal"),
        "select_evidence": (F.col("source_kind").isin("x_post", "web_page", "user_input") & ~empty, "normal"),
    }
    own = R.tasks_of(_sources(spark, d), "evidence_id", rules, "last_ingested_at")
    failed = R.tasks_of(table(spark, d, "media_ocr_results"), "ocr_id", {"failed_recognition": (F.col("status") != "ok", "high")}, "created_at")
    return R.union_all([own, failed])


_TASKS = f"WITH {_SOURCES}, t AS (" + " UNION ALL ".join(f"SELECT '{k}:' || evidence_id AS task_id, '{k}' AS task_type, '{p}' AS priority, last_ingested_at AS updated_at FROM s WHERE {c}" for k, (c, p) in _RULES.items()) + " UNION ALL SELECT 'failed_recognition:' || ocr_id, 'failed_recognition', 'high', created_at FROM media_ocr_results WHERE status <> 'ok')"


@query(_TASKS + " SELECT task_id, task_type, priority FROM t")
def inbox_tasks(spark, d):
    return _tasks(spark, d).select("task_id", "task_type", "priority")


_DECIDED = ", d AS (SELECT 'media_text:' || evidence_id AS task_id, arg_max(status, (created_at, status)) AS decision FROM media_ocr_results GROUP BY 1)"


def _open_tasks(spark, d):
    """Decisions stand in by recognition runs: a task on a medium whose last run is ok is done."""
    decisions = table(spark, d, "media_ocr_results").select(F.concat(F.lit("media_text:"), "evidence_id").alias("task_id"), F.col("status").alias("decision"), F.col("created_at").alias("decided_at"))
    return R.overlay_decisions(_tasks(spark, d), decisions, ["ok"])


@query(_TASKS + _DECIDED + " SELECT t.task_id, d.decision FROM t LEFT JOIN d USING (task_id) WHERE d.decision IS NULL OR lower(d.decision) <> 'ok'")
def inbox_open(spark, d):
    return _open_tasks(spark, d).select("task_id", "decision")


@query(_TASKS + _DECIDED + " SELECT task_id FROM (SELECT t.* FROM t LEFT JOIN d USING (task_id) WHERE d.decision IS NULL OR lower(d.decision) <> 'ok') ORDER BY CASE priority WHEN 'blocking' THEN 3 WHEN 'high' THEN 2 WHEN 'normal' THEN 1 ELSE 0 END DESC, updated_at DESC NULLS LAST, task_id LIMIT 200")
def inbox_page(spark, d):
    return _open_tasks(spark, d).orderBy(*R.inbox_order()).limit(200).select("task_id")


@query(_TASKS + " SELECT task_type AS queue, count(*) AS n FROM t GROUP BY 1 UNION ALL SELECT 'urgent', count(*) FROM t WHERE priority IN ('blocking', 'high')")
def inbox_queues(spark, d):
    t = _tasks(spark, d)
    by = t.groupBy(F.col("task_type").alias("queue")).agg(F.count(F.lit(1)).alias("n"))
    return by.unionByName(A.queue_counts(t, {"urgent": F.col("priority").isin("blocking", "high")}))


def _ledger(spark, d):
    def part(name: str, kind: str, ident: str, source: str, label: str, at: str):
        return table(spark, d, name).select(F.lit(kind).alias("object_type"), F.col(ident).cast("string").alias("object_id"), F.col(source).cast("string").alias("source_id"), F.col(label).alias("label"), F.col(at).alias("updated_at"))

    return R.union_all([
        part("evidence_events", "event", "event_id", "evidence_id", "title", "ingested_at"), part("evidence_latest", "record", "record_id", "evidence_id", "title", "updated_at"), part("media_observed", "media", "observation_id", "media_id", "caption", "captured_at"),
        part("media_ocr_results", "recognition", "ocr_id", "evidence_id", "status", "created_at"), part("ops_canary_runs", "run", "run_id", "collector_run_id", "status", "created_at"), part("documents", "document", "doc_id", "source", "title", "captured_at"),
    ])


_LEDGER = """l AS (SELECT 'event' AS object_type, event_id AS object_id, evidence_id AS source_id, title AS label, ingested_at AS updated_at FROM evidence_events UNION ALL SELECT 'record', record_id::VARCHAR, evidence_id, title, updated_at FROM evidence_latest UNION ALL SELECT 'media', observation_id, media_id, caption, captured_at FROM media_observed
    UNION ALL SELECT 'recognition', ocr_id, evidence_id, status, created_at FROM media_ocr_results UNION ALL SELECT 'run', run_id, collector_run_id, status, created_at FROM ops_canary_runs UNION ALL SELECT 'document', doc_id::VARCHAR, source, title, captured_at FROM documents)"""


@query(f"WITH {_LEDGER} SELECT object_type, object_id, source_id, label, updated_at FROM l")
def evidence_ledger(spark, d):
    return _ledger(spark, d)


@query(f"WITH {_LEDGER} SELECT object_type, count(*) AS n, count(DISTINCT source_id) AS sources, count(*) FILTER (trim(coalesce(label, '')) = '') AS unlabelled FROM l GROUP BY 1")
def ledger_facets(spark, d):
    return _ledger(spark, d).groupBy("object_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("sources"), F.count_if(F.trim(F.coalesce("label", F.lit(""))) == "").alias("unlabelled"))


@query(f"WITH {_LEDGER} SELECT object_type, object_id FROM l WHERE contains(lower(concat_ws(' ', object_type, object_id, source_id, label)), 'retrie')")
def ledger_search(spark, d):
    return _ledger(spark, d).where(F.lower(F.concat_ws(" ", "object_type", "object_id", "source_id", "label")).contains("retrie")).select("object_type", "object_id")


@query(
    "WITH b AS (SELECT DISTINCT media_id AS object_id, sha256 FROM media_observed), k AS (SELECT DISTINCT object_id AS id, unnest([object_id, sha256]) AS key FROM b), n AS (SELECT id, count(DISTINCT ocr_id) AS links FROM (SELECT k.id, o.ocr_id FROM k JOIN media_ocr_results o ON o.evidence_id = k.key UNION ALL SELECT k.id, o.ocr_id FROM k JOIN media_ocr_results o ON o.source_sha256 = k.key) GROUP BY 1) SELECT b.object_id, coalesce(n.links, 0) AS links FROM b LEFT JOIN n ON n.id = b.object_id"
)
def linked_runs(spark, d):
    """Recognition runs of a medium by its id or its content, each once."""
    runs = table(spark, d, "media_ocr_results")
    links = runs.select(F.col("evidence_id").alias("link_key"), F.col("ocr_id").alias("object_id")).unionByName(runs.select(F.col("source_sha256").alias("link_key"), F.col("ocr_id").alias("object_id")))
    base = table(spark, d, "media_observed").select(F.col("media_id").alias("object_id"), "sha256").distinct()
    return R.linked_ids(base, links, ["object_id", "sha256"]).select("object_id", "links")


@query("SELECT 'x' AS kind, evidence_id AS ident, ingested_at AS \"at\" FROM (SELECT evidence_id, ingested_at FROM evidence_events WHERE source_kind = 'x_post' ORDER BY ingested_at DESC, evidence_id LIMIT 50) UNION ALL SELECT 'ocr', ocr_id, created_at FROM (SELECT ocr_id, created_at FROM media_ocr_results ORDER BY created_at DESC, ocr_id LIMIT 50) ORDER BY \"at\" DESC, ident LIMIT 80")
def merged_recent(spark, d):
    a = ev(spark, d).where("source_kind = 'x_post'").select(F.lit("x").alias("kind"), F.col("evidence_id").alias("ident"), F.col("ingested_at").alias("at"))
    b = table(spark, d, "media_ocr_results").select(F.lit("ocr").alias("kind"), F.col("ocr_id").alias("ident"), F.col("created_at").alias("at"))
    return R.merge_recent([a, b], "at", "ident")


# ------------------------------------------------------------------ claims and comparisons


def _claims(spark, d):
    """Statements ``source: language`` of documents, else their titles."""
    docs = table(spark, d, "documents")
    statement = F.when(F.col("source").isNotNull() & F.col("lang").isNotNull(), F.concat_ws(": ", "source", "lang")).otherwise(F.col("title"))
    return R.claims(docs.withColumn("statement", statement), "doc_id", "statement", "source", "source_kind")


_TRIM = f"trim(CASE WHEN source IS NOT NULL AND lang IS NOT NULL THEN source || ': ' || lang ELSE title END, {_WS})"
_CLAIMS = f"""c0 AS (SELECT doc_id AS claim_id, source AS source_id, {_TRIM} AS claim_text, coalesce(nullif(trim(source_kind, {_WS}), ''), 'general') AS property FROM documents WHERE coalesce({_TRIM}, '') <> ''),
    c1 AS (SELECT *, CASE WHEN contains(claim_text, ':') THEN trim(split_part(claim_text, ':', 1), {_WS}) WHEN contains(claim_text, ' is ') THEN trim(split_part(claim_text, ' is ', 1), {_WS}) ELSE '' END AS subject,
    CASE WHEN contains(claim_text, ':') THEN trim(claim_text[strpos(claim_text, ':') + 1:], {_WS}) WHEN contains(claim_text, ' is ') THEN trim(claim_text[strpos(claim_text, ' is ') + 4:], {_WS}) ELSE claim_text END AS v FROM c0),
    c AS (SELECT claim_id, source_id, claim_text, property, subject, coalesce(nullif(v, ''), claim_text) AS value, subject <> '' AS scoped FROM c1)"""


@query(f"WITH {_CLAIMS} SELECT claim_id, source_id, claim_text, subject, property, value, scoped FROM c")
def claim_rows(spark, d):
    return _claims(spark, d)


@query(f"WITH {_CLAIMS}, p AS (SELECT lower(subject) AS s, lower(property) AS p, CASE WHEN count(DISTINCT lower(value)) > 1 THEN count(*) ELSE 1 END AS n FROM c WHERE scoped GROUP BY 1, 2) SELECT claim_id, coalesce(p.n, 1) AS cluster_size FROM c LEFT JOIN p ON c.scoped AND p.s = lower(c.subject) AND p.p = lower(c.property)")
def claim_propositions(spark, d):
    return R.proposition_sizes(_claims(spark, d))


@query(f"WITH {_CLAIMS} SELECT 'conflict_cluster:' || substring(sha1(lower(subject) || '|' || lower(property)), 1, 16) AS cluster_id, count(*) AS assertions, count(DISTINCT lower(value)) AS values_n, count(DISTINCT source_id) AS sources, arg_min(claim_text, claim_id) AS preferred FROM c WHERE scoped GROUP BY lower(subject), lower(property) HAVING count(*) > 1 AND count(DISTINCT lower(value)) > 1")
def claim_conflicts(spark, d):
    return R.conflict_clusters(_claims(spark, d)).drop("proposition")


@query(f"WITH {_CLAIMS} SELECT 'duplicate_cluster:' || substring(lower(claim_text), 1, 120) AS cluster_id, count(*) AS assertions, count(DISTINCT source_id) AS sources FROM c WHERE scoped GROUP BY lower(claim_text) HAVING count(*) > 1")
def claim_duplicates(spark, d):
    return R.duplicate_clusters(_claims(spark, d))


@query(f"WITH {_CLAIMS} SELECT lower(subject) AS subject_key, count(DISTINCT lower(value)) AS values_n, count(*) AS assertions FROM c WHERE scoped GROUP BY 1 HAVING count(DISTINCT lower(value)) > 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 5")
def claim_contradictions(spark, d):
    return R.contradictions(_claims(spark, d))


_SELECTIONS = "x AS (SELECT source AS source_id, CASE source_kind WHEN 'x_post' THEN 'refutes' WHEN 'web_page' THEN 'quote' ELSE 'context' END AS selection_kind FROM documents)"


def _selections(spark, d):
    k = F.col("source_kind")
    return table(spark, d, "documents").select(F.col("source").alias("source_id"), F.when(k == "x_post", "refutes").when(k == "web_page", "quote").otherwise("context").alias("selection_kind"))


@query(f"WITH {_CLAIMS}, {_SELECTIONS}, n AS (SELECT source_id, count(*) FILTER (selection_kind = 'quote') AS support, count(*) FILTER (selection_kind = 'refutes') AS refute, count(*) FILTER (selection_kind = 'context') AS context FROM x GROUP BY 1) SELECT claim_id, coalesce(support, 0) AS support, coalesce(refute, 0) AS refute, coalesce(context, 0) AS context FROM c LEFT JOIN n USING (source_id)")
def claim_support(spark, d):
    return R.support_counts(_claims(spark, d), _selections(spark, d))


@query(f"WITH {_CLAIMS}, f AS (SELECT DISTINCT source AS source_id, lower(trim(lang)) AS raw_value FROM documents WHERE lang IS NOT NULL) SELECT claim_id, count(*) AS facts FROM c JOIN f USING (source_id) WHERE raw_value <> '' AND (contains(lower(trim(value)), raw_value) OR contains(raw_value, lower(trim(value)))) GROUP BY 1")
def claim_facts(spark, d):
    facts = table(spark, d, "documents").where("lang IS NOT NULL").select(F.col("source").alias("source_id"), F.lower(F.trim("lang")).alias("raw_value")).distinct()
    return R.fact_matches(_claims(spark, d), facts)


@query(f"WITH {_CLAIMS}, s AS (SELECT min(source) AS source_id FROM documents) SELECT claim_id FROM c WHERE source_id IN (SELECT source_id FROM s) OR contains(lower(claim_text), 'web') OR contains(lower(claim_text), 'pages')")
def claims_of_entity(spark, d):
    return R.entity_claims(_claims(spark, d), "Web pages de", table(spark, d, "documents").agg(F.min("source").alias("source_id"))).select("claim_id")


@query(f"WITH {_CLAIMS}, s AS (SELECT min(source) AS source_id FROM documents) SELECT claim_id FROM c WHERE source_id IN (SELECT source_id FROM s) OR contains(lower(claim_text), ': de')")
def claims_of_topic(spark, d):
    return R.topic_claims(_claims(spark, d), ": DE", table(spark, d, "documents").agg(F.min("source").alias("source_id"))).select("claim_id")


@query(
    f"""WITH {_CLAIMS}, q AS (SELECT c.*, d.source_kind, CASE d.lang WHEN 'de' THEN 'disputed' WHEN 'es' THEN 'rejected' WHEN 'fr' THEN 'accepted' ELSE 'proposed' END AS status, CASE WHEN coalesce(d.text, '') = '' THEN 'no_result' WHEN length(d.text) > 3000 THEN 'rerun' ELSE '' END AS qualifier FROM c JOIN documents d ON d.doc_id = c.claim_id WHERE scoped),
    ss AS (SELECT subject, min(claim_id) AS f FROM q GROUP BY 1 ORDER BY f, subject LIMIT 10), pp AS (SELECT property, min(claim_id) AS f FROM q GROUP BY 1 ORDER BY f, property LIMIT 40),
    g AS (SELECT property, subject, count(*) AS assertions, count(DISTINCT lower(value)) AS values_n, arg_min({{'c': claim_id, 'k': source_kind, 's': source_id}}, (CASE status WHEN 'accepted' THEN 0 WHEN 'proposed' THEN 1 WHEN 'disputed' THEN 2 ELSE 3 END, claim_id)) AS s, bool_and(status = 'rejected') AS gone, bool_or(status = 'disputed') AS refuted, bool_or(status = 'accepted') AS accepted, bool_or(qualifier = 'no_result') AS na, bool_or(qualifier = 'rerun') AS again FROM q GROUP BY 1, 2)
    SELECT pp.property, ss.subject, CASE WHEN g.assertions IS NULL THEN 'Missing' WHEN gone OR na THEN 'NA' WHEN refuted OR values_n > 1 THEN 'Disputed' WHEN again THEN 'Reproduced' WHEN accepted AND lower(s.k) IN ('media', 'search_result', 'google_search_page') THEN 'Independently-measured' WHEN coalesce(s.s, '') <> '' THEN 'Vendor-reported' ELSE 'Incomparable' END AS state, coalesce(g.assertions, 0) AS assertions, coalesce(values_n, 0) AS values_n, s.c AS claim_id
    FROM pp CROSS JOIN ss LEFT JOIN g ON g.property = pp.property AND g.subject = ss.subject"""
)
def compare_matrix(spark, d):
    """Review states stand in by language, qualifiers by what the documents hold."""
    doc = table(spark, d, "documents").select(
        F.col("doc_id").alias("claim_id"), "source_kind", F.when(F.col("lang") == "de", "disputed").when(F.col("lang") == "es", "rejected").when(F.col("lang") == "fr", "accepted").otherwise("proposed").alias("review_state"),
        F.when(F.coalesce("text", F.lit("")) == "", "no_result").when(F.char_length("text") > 3000, "rerun").otherwise("").alias("qualifier"), F.lit("").alias("relation"),
    )
    return R.compare_matrix(_claims(spark, d).join(doc, "claim_id"))


_GROUPS = "g AS (SELECT substring(sha1(concat_ws('|', coalesce(engine, ''), coalesce(engine_version, ''), coalesce(params_hash, ''))), 1, 12) AS config_key, count(*) AS n, count(*) FILTER (status = 'ok') AS done FROM media_ocr_results GROUP BY 1)"


@query(f"WITH {_GROUPS}, p AS (SELECT config_key, 'stored' AS label FROM g WHERE done > 20) SELECT config_key, n, coalesce(label, 'derived') AS label FROM g LEFT JOIN p USING (config_key)")
def config_groups(spark, d):
    """Derived groups of one configuration, with what is stored of them."""
    key = S.short_sha1(12, *[F.coalesce(c, F.lit("")) for c in ("engine", "engine_version", "params_hash")])
    g = table(spark, d, "media_ocr_results").groupBy(key.alias("config_key")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("done"))
    stored = g.where("done > 20").select("config_key", F.lit("stored").alias("label"))
    return g.select("config_key", "n").join(stored, "config_key", "left").withColumn("label", F.coalesce("label", F.lit("derived")))


# ------------------------------------------------------------------ time, attempts, revisions


@query("WITH e AS (SELECT 'capture' AS kind, event_id AS item_id, strftime(captured_at, '%Y-%m-%d') AS day FROM evidence_events UNION ALL SELECT 'document', doc_id::VARCHAR, strftime(captured_at, '%Y-%m-%d') FROM documents) SELECT kind, item_id, day FROM e WHERE coalesce(day, '') <> '' AND day >= '2025-02-01' AND day <= '2025-04-30'")
def timeline_range(spark, d):
    day = F.date_format("captured_at", "yyyy-MM-dd").alias("day")
    a = ev(spark, d).select(F.lit("capture").alias("kind"), F.col("event_id").alias("item_id"), day)
    b = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("item_id"), day)
    return R.in_dates(R.union_all([a, b]), "day", "2025-02-01", "2025-04-30")


@query("SELECT record_id, coalesce(strftime(first_seen_at, '%Y-%m-%d'), strftime(updated_at, '%Y-%m-%d'), '9999') AS shown FROM evidence_latest ORDER BY shown, record_id LIMIT 100")
def timeline_page(spark, d):
    t = table(spark, d, "evidence_latest").select("record_id", F.date_format("first_seen_at", "yyyy-MM-dd").alias("a"), F.date_format("updated_at", "yyyy-MM-dd").alias("b"))
    return t.orderBy(*R.timeline_order("a", "b", "record_id")).limit(100).select("record_id", F.coalesce("a", "b", F.lit("9999")).alias("shown"))


_LAUNCHES = "v AS (SELECT evidence_id AS subject_id, ocr_id AS event_id, created_at, CASE status WHEN 'ok' THEN 'capture.committed' WHEN 'failed' THEN 'capture.launch_failed' ELSE 'capture.launch_result' END AS event_type FROM media_ocr_results UNION ALL SELECT media_id, observation_id, captured_at, 'capture.launch_requested' FROM media_observed)"


@query(
    f"""WITH {_LAUNCHES}, g AS (SELECT subject_id, min({{'a': created_at, 'e': event_id}}) FILTER (event_type LIKE '%.launch_requested') AS q, max({{'a': created_at, 'e': event_id}}) FILTER (event_type LIKE '%.committed') AS c, max({{'a': created_at, 'e': event_id}}) FILTER (event_type LIKE '%.launch_failed') AS f, max({{'a': created_at, 'e': event_id}}) FILTER (event_type LIKE '%.launch_result') AS l FROM v GROUP BY 1)
    SELECT subject_id, q.e AS request_event_id, CASE WHEN c IS NULL AND f IS NULL AND l IS NULL THEN 'requested' WHEN c IS NOT NULL AND (f IS NULL OR c >= f) THEN 'committed' WHEN f IS NOT NULL AND (c IS NOT NULL OR l IS NULL OR f >= l) THEN 'failed' ELSE 'launched' END AS state FROM g"""
)
def capture_attempts(spark, d):
    """Recognition runs as attempts: observations ask for them, runs are their outcomes."""
    runs = table(spark, d, "media_ocr_results")
    kind = F.when(F.col("status") == "ok", "capture.committed").when(F.col("status") == "failed", "capture.launch_failed").otherwise("capture.launch_result")
    a = runs.select(F.col("evidence_id").alias("subject_id"), F.col("ocr_id").alias("event_id"), "created_at", kind.alias("event_type"))
    b = table(spark, d, "media_observed").select(F.col("media_id").alias("subject_id"), F.col("observation_id").alias("event_id"), F.col("captured_at").alias("created_at"), F.lit("capture.launch_requested").alias("event_type"))
    return R.fold_attempts(R.union_all([a, b])).select("subject_id", "request_event_id", "state")


@query("SELECT evidence_id, arg_max(record_id, (length(coalesce(text_best, '')), updated_at, record_id)) AS record_id FROM evidence_latest GROUP BY 1")
def latest_revisions(spark, d):
    t = table(spark, d, "evidence_latest").select("evidence_id", "record_id", "updated_at", F.char_length(F.coalesce("text_best", F.lit(""))).alias("revision"))
    return R.latest_revision(t, "evidence_id", "revision", "updated_at", "record_id").select("evidence_id", "record_id")


@query("WITH i AS (SELECT DISTINCT evidence_id, unnest(links) AS ref, 0 AS prio FROM evidence_events), s AS (SELECT DISTINCT evidence_id, canonical_url AS ref, 1 AS prio FROM evidence_latest WHERE coalesce(canonical_url, '') <> '') SELECT evidence_id, ref, min(prio)::INTEGER AS prio FROM (SELECT * FROM i UNION ALL SELECT * FROM s) GROUP BY 1, 2")
def citation_merge(spark, d):
    """References found in the text before stored ones, each once."""
    inline = ev(spark, d).select("evidence_id", F.explode("links").alias("ref")).withColumn("prio", F.lit(0))
    stored = table(spark, d, "evidence_latest").where(F.coalesce("canonical_url", F.lit("")) != "").select("evidence_id", F.col("canonical_url").alias("ref")).withColumn("prio", F.lit(1))
    return inline.unionByName(stored).groupBy("evidence_id", "ref").agg(F.min("prio").alias("prio"))


@query("WITH d AS (SELECT evidence_id, arg_max(status, (created_at, ocr_id)) AS decision FROM media_ocr_results GROUP BY 1) SELECT decision, count(*) AS n FROM d GROUP BY 1")
def latest_decisions(spark, d):
    last = A.latest_by(table(spark, d, "media_ocr_results"), ["evidence_id"], ["created_at", "ocr_id"], ["status"])
    return last.groupBy(F.col("status").alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT e.source_project, count(*) FILTER (o.status = 'ok') AS done, count(*) FILTER (o.status <> 'ok') AS undone FROM media_ocr_results o JOIN (SELECT evidence_id, arg_max(source_project, (ingested_at, event_id)) AS source_project FROM evidence_events GROUP BY 1) e USING (evidence_id) GROUP BY 1")
def status_by_project(spark, d):
    latest = A.latest_by(ev(spark, d), ["evidence_id"], ["ingested_at", "event_id"], ["source_project"])
    return table(spark, d, "media_ocr_results").join(latest, "evidence_id").groupBy("source_project").agg(F.count_if(F.col("status") == "ok").alias("done"), F.count_if(F.col("status") != "ok").alias("undone"))


@query("SELECT 'events' AS name, count(*) AS n FROM evidence_events UNION ALL SELECT 'records', count(*) FROM (SELECT DISTINCT evidence_id FROM evidence_latest) UNION ALL SELECT 'media', count(DISTINCT media_id) FROM media_observed UNION ALL SELECT 'runs', count(*) FROM ops_canary_runs")
def object_counts(spark, d):
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return R.union_all([one("events", ev(spark, d)), one("records", table(spark, d, "evidence_latest").select("evidence_id").distinct()), one("media", table(spark, d, "media_observed").select("media_id").distinct()), one("runs", table(spark, d, "ops_canary_runs"))])


@query("WITH c AS (SELECT engine AS model, artifact_role AS operation, status, count(*)::DOUBLE AS requests FROM media_ocr_results GROUP BY ALL), o AS (SELECT engine AS model, artifact_role AS operation, sum(text_chars)::DOUBLE / count(*) AS avg_duration, max(text_chars)::DOUBLE AS max_duration FROM media_ocr_results GROUP BY ALL) SELECT coalesce(model, '') AS model, coalesce(operation, '') AS operation, coalesce(status, '') AS status, requests, round(avg_duration, 6) AS avg_duration, max_duration FROM c JOIN o USING (model, operation)")
def request_metrics(spark, d):
    """Recognition runs as requests, their text lengths as observed durations."""
    runs = table(spark, d, "media_ocr_results")
    labels = F.create_map(F.lit("model"), "engine", F.lit("operation"), "artifact_role", F.lit("status"), "status")
    counters = runs.select(labels.alias("labels"), F.lit(1.0).alias("sample"))
    seen = runs.select(F.lit("duration").alias("name"), labels.alias("labels"), F.col("text_chars").cast("double").alias("total"), F.lit(1).alias("n"), F.col("text_chars").cast("double").alias("most"))
    return R.request_rows(counters, seen).select("model", "operation", "status", "requests", F.round("avg_duration", 6).alias("avg_duration"), "max_duration")


@query("WITH m AS (SELECT source_project, source_kind, count(*) AS n FROM evidence_events GROUP BY ALL), g AS (SELECT p.source_project, k.source_kind, coalesce(m.n, 0) AS n FROM (SELECT DISTINCT source_project FROM m) p CROSS JOIN (SELECT DISTINCT source_kind FROM m) k LEFT JOIN m ON m.source_project IS NOT DISTINCT FROM p.source_project AND m.source_kind IS NOT DISTINCT FROM k.source_kind) SELECT source_project, count(*) AS kinds, count(*) FILTER (n = 0) AS gaps, sum(n)::BIGINT AS n, CAST(round_even(100.0 * count(*) FILTER (n > 0) / count(*), 0) AS INTEGER) AS percent FROM g GROUP BY 1")
def coverage_gaps(spark, d):
    """How many kinds each project lacks; the grid of projects and kinds comes from one aggregation."""
    m = ev(spark, d).groupBy("source_project", "source_kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = m.agg(F.countDistinct(F.coalesce("source_kind", F.lit("\x00"))).alias("kinds"))
    g = m.groupBy("source_project").agg(F.count(F.lit(1)).alias("have"), F.sum("n").alias("n")).crossJoin(F.broadcast(kinds))
    return g.select("source_project", "kinds", (F.col("kinds") - F.col("have")).alias("gaps"), "n", S.percent(F.col("have"), F.col("kinds")).cast("int").alias("percent"))


# ------------------------------------------------------------------ scalars, filters, pages


@query("SELECT event_id, evidence_id FROM evidence_events WHERE source_project IN ('bench-desk', 'tool-atlas') AND list_has_any(topics, ['benchmark']) AND captured_at >= TIMESTAMP '2025-02-01' AND captured_at <= TIMESTAMP '2025-05-31 23:59:59'")
def index_filter(spark, d):
    f = retrieval.normal_filters({"project": "bench-desk,tool-atlas", "topic": "benchmark", "date_from": "2025-02-01", "date_to": "2025-05-31"})
    return ev(spark, d).where(retrieval.row_filter(f, day_bounds=True)).select("event_id", "evidence_id")


@query("SELECT event_id, evidence_id FROM evidence_events WHERE source_kind IN ('media', 'x_post') AND has_media = 1 AND strftime(captured_at, '%Y-%m-%d') = '2025-11-22'")
def payload_filter(spark, d):
    f = retrieval.normal_filters({"kinds": ["media", "x_post"], "has_media": "1", "date_from": "2025-11-22", "date_to": "2025-11-22"})
    return ev(spark, d).where(retrieval.payload_filter(f)).select("event_id", "evidence_id")


@query("SELECT run_id FROM ops_canary_runs WHERE coalesce(lower(status) NOT IN ('passed', 'closed'), true)")
def status_not_in(spark, d):
    return table(spark, d, "ops_canary_runs").where(F.coalesce(~F.lower("status").isin("passed", "closed"), F.lit(True))).select("run_id")


@query("SELECT media_id, substring(concat_ws(chr(10), nullif(caption, ''), nullif(ocr_text, ''), nullif(url, ''), nullif(array_to_string(topics, ' '), ''), nullif(array_to_string(entities, ' '), '')), 1, 2200) AS doc FROM media_observed")
def rerank_documents(spark, d):
    return table(spark, d, "media_observed").select("media_id", retrieval.rerank_document("caption", "ocr_text", "url").alias("doc"))


@query("SELECT ocr_id, coalesce(text_chars, 0)::VARCHAR || ' chars / ' || coalesce(block_count, 0)::VARCHAR || ' blocks' AS size, coalesce(mean_confidence, 0)::DOUBLE AS confidence, greatest(2, least(8, coalesce(page_no, 0) + 1)) AS target FROM media_ocr_results")
def recognition_labels(spark, d):
    return table(spark, d, "media_ocr_results").select("ocr_id", S.size_label(F.col("text_chars"), F.col("block_count")).alias("size"), S.confidence(F.col("mean_confidence")).alias("confidence"), S.target_count(F.coalesce("page_no", F.lit(0))).cast("long").alias("target"))


@query("SELECT DISTINCT source_kind, 'source.' || trim(regexp_replace(lower(source_kind), '[^a-z0-9]+', '_', 'g'), '_') AS term_id FROM evidence_events WHERE source_kind IS NOT NULL")
def taxonomy_ids(spark, d):
    return ev(spark, d).where("source_kind IS NOT NULL").select("source_kind").distinct().select("source_kind", S.taxonomy_id("source", F.col("source_kind")).alias("term_id"))


@query("WITH t AS (SELECT source_kind AS term, count(*) AS usage, CASE WHEN count(DISTINCT source_project) > 3 THEN 'proposed' ELSE 'stable' END AS state FROM evidence_events GROUP BY 1) SELECT term, usage FROM t ORDER BY CASE state WHEN 'proposed' THEN 0 ELSE 2 END, usage DESC, term LIMIT 50")
def taxonomy_page(spark, d):
    t = ev(spark, d).groupBy(F.col("source_kind").alias("term")).agg(F.count(F.lit(1)).alias("usage"), F.countDistinct("source_project").alias("p"))
    return t.orderBy(F.when(F.col("p") > 3, 0).otherwise(2), F.desc("usage"), F.asc("term")).limit(50).select("term", "usage")


@query("WITH t AS (SELECT doc_id, trim(title) AS t FROM documents WHERE trim(coalesce(title, '')) <> '') SELECT doc_id, coalesce(nullif(substring(trim(CASE WHEN contains(t, ':') THEN split_part(t, ':', 1) WHEN contains(t, ' - ') THEN split_part(t, ' - ', 1) ELSE t END), 1, 240), ''), 'Untitled term') AS term, trim(CASE WHEN contains(t, ':') THEN t[strpos(t, ':') + 1:] WHEN contains(t, ' - ') THEN t[strpos(t, ' - ') + 3:] ELSE '' END) AS definition FROM t")
def brief_definitions(spark, d):
    t = table(spark, d, "documents").where(F.trim(F.coalesce("title", F.lit(""))) != "")
    p = R.definition_parts(F.col("title"))
    return t.select("doc_id", p["term"].alias("term"), p["definition"].alias("definition"))


@query("SELECT event_id, evidence_id, coalesce(len(links) > 0, false) AS has_links, {'topics': coalesce(len(topics), 0), 'links': coalesce(len(links), 0)}.topics::BIGINT AS topics_n FROM evidence_events")
def list_sizes(spark, d):
    sizes = S.sizes_of(F.create_map(F.lit("topics"), F.coalesce("topics", F.array().cast("array<string>")), F.lit("links"), F.coalesce("links", F.array().cast("array<string>"))))
    return ev(spark, d).select("event_id", "evidence_id", (sizes["links"] > 0).alias("has_links"), sizes["topics"].cast("long").alias("topics_n"))


@query("SELECT run_id, substring(sha1('{\"run_id\": \"' || run_id || '\", \"status\": \"' || coalesce(status, '') || '\"}'), 1, 24) AS key FROM ops_canary_runs")
def sha1_keys(spark, d):
    return table(spark, d, "ops_canary_runs").select("run_id", F.substring(F.sha1(S.spaced_json("run_id", "status")), 1, 24).alias("key"))


@query()
def page_documents(spark, d):
    """Texts of web pages as evidence documents; the tables hold no markup, so text stands for the page's own."""
    p = ev(spark, d).where("source_kind = 'web_page' AND text IS NOT NULL").select(F.concat_ws("|", "event_id", "evidence_id").alias("page_id"), F.col("canonical_url").alias("url"), F.concat(F.lit("<title>"), F.coalesce("title", F.lit("")), F.lit("</title><pre>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</pre>")).alias("html"))
    return documents.evidence_documents(documents.extract_pages(p))
