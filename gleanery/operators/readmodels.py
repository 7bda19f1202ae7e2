"""Read models: sources, inboxes, ledgers, claims, comparisons, timelines, attempts and inspection as relational operators."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import scalars as S

# ------------------------------------------------------------------ sources


def sources(events: DataFrame) -> DataFrame:
    """One row per evidence id: fields of its last row by ingestion, and what all its rows tell. One aggregation."""
    last = F.struct("source_project", "source_kind", "canonical_url", "author_handle", "domain", "title", F.char_length("text").alias("text_chars"), "captured_at", "posted_at")
    got = events.groupBy("evidence_id").agg(
        F.max_by(last, F.struct("ingested_at", "event_id", F.xxhash64("title", "text"))).alias("r"),
        F.max("has_media").alias("has_media"),
        F.max("has_ocr").alias("has_ocr"),
        F.max("ingested_at").alias("last_ingested_at"),
        F.min("captured_at").alias("first_captured_at"),
        F.count(F.lit(1)).alias("observations"),
    )
    return got.select("evidence_id", "r.*", "has_media", "has_ocr", "last_ingested_at", "first_captured_at", "observations")


def review_hint() -> Column:
    """What a source row asks for, the first rule that holds."""
    return (
        F.when((F.col("source_kind") == "media") & (F.coalesce("has_ocr", F.lit(0)) == 0), "Needs OCR/VL review")
        .when(F.coalesce("text_chars", F.lit(0)) == 0, "Extraction empty")
        .when(F.col("observations") > 1, "Multiple captures")
        .when(F.col("source_kind").isin("x_post", "web_page", "user_input"), "Ready for evidence selection")
        .otherwise("Triage")
    )


#: Sort orders of the library (fixed values); ids settle ties.
SORTS = {
    "ingested_desc": ("last_ingested_at",),
    "captured_desc": ("captured_at", "last_ingested_at"),
    "published_desc": ("posted_at", "captured_at"),
    "freshness": ("has_media", "has_ocr", "observations", "last_ingested_at"),
}


def library_order(sort: str, ident: str = "evidence_id") -> list[Column]:
    return [*[F.desc(c) for c in SORTS.get(sort, SORTS["ingested_desc"])], F.asc(ident)]


def library(rows: DataFrame, counts: dict[str, tuple[DataFrame, str]], actions: DataFrame, archived: bool = False) -> DataFrame:
    """Sources with the number of rows that other tables have of them and their latest action; archived ones on request.

    ``actions`` has evidence_id, action, at. Every side is aggregated by its key before the join.
    """
    from gleanery.operators.analytics import left_counts

    last = actions.groupBy("evidence_id").agg(F.max_by("action", F.struct("at", "action")).alias("last_action"))
    out = left_counts(rows, "evidence_id", counts).join(last, "evidence_id", "left")
    state = F.when(F.col("last_action") == "archive", "archived").otherwise("active")
    out = out.withColumn("archive_state", state)
    return out if archived else out.where(F.col("archive_state") == "active")


#: Ranks of priorities (fixed values).
PRIORITY = {"blocking": 3, "high": 2, "normal": 1}


def priority_rank(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.coalesce(c, F.lit("normal"))), F.lit(0))


def tasks_of(rows: DataFrame, ident: str, rules: dict[str, tuple[Column, str]], updated: str) -> DataFrame:
    """``task_id, task_type, subject_id, priority, updated_at``: a task for each rule that holds for a row."""
    made = F.array(*[F.when(cond, F.struct(F.lit(name).alias("task_type"), F.lit(priority).alias("priority"))) for name, (cond, priority) in rules.items()])
    out = rows.select(F.col(ident).cast("string").alias("subject_id"), F.col(updated).alias("updated_at"), F.inline(F.array_compact(made)))
    return out.select(F.concat_ws(":", "task_type", "subject_id").alias("task_id"), "task_type", "subject_id", "priority", "updated_at")


def overlay_decisions(tasks: DataFrame, decisions: DataFrame, terminal: Sequence[str]) -> DataFrame:
    """Tasks with the latest decision on them, without those whose decision is terminal.

    ``decisions`` has task_id, decision, decided_at; it is folded to one row per task before the join.
    """
    last = decisions.groupBy("task_id").agg(F.max_by("decision", F.struct("decided_at", "decision")).alias("decision"))
    out = tasks.join(last, "task_id", "left")
    return out.where(F.col("decision").isNull() | ~F.lower("decision").isin(*terminal))


def inbox_order() -> list[Column]:
    return [F.desc(priority_rank(F.col("priority"))), F.desc("updated_at"), F.asc("task_id")]


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of several kinds as one table, columns by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def linked_ids(base: DataFrame, links: DataFrame, keys: Sequence[str], ident: str = "object_id") -> DataFrame:
    """``base`` with the number of distinct linked objects by any of its keys: links are ``link_key, object_id``.

    A row's keys are spread to rows, so each is an equi-join; an object linked by two keys counts once.
    """
    wanted = base.select(F.col(ident).alias("__id"), F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(k).cast("string") for k in keys])))).alias("link_key")).distinct()
    n = wanted.join(links.select("link_key", F.col("object_id").alias("__o")), "link_key").groupBy("__id").agg(F.countDistinct("__o").alias("links"))
    return base.join(n, F.col(ident) == F.col("__id"), "left").drop("__id").withColumn("links", F.coalesce("links", F.lit(0)))


def facet_counts(rows: DataFrame, column: str, unknown: str | None = "unknown") -> DataFrame:
    """``value, n`` by falling count; missing values count as ``unknown``, or not at all."""
    v = S.text(F.col(column).cast("string"))
    shown = F.when(v == "", F.lit(unknown)).otherwise(v)
    return rows.select(shown.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def related_classes(rows: DataFrame, ident: str, keys: Sequence[str], least: int = 2) -> DataFrame:
    """``link, key, members, representative`` of every class of rows that share a key, and ``is_related`` members.

    One row per member (``ident``) and link: its class is the key's hash, its size and least member stand for all
    pairs, so a key that many share costs one row a member.
    """
    made = F.array(*[F.struct(F.lit(k).alias("link"), S.text(F.col(k)).alias("key")) for k in keys])
    member = rows.select(F.col(ident).alias("member"), F.inline(made)).where(F.col("key") != "").distinct()
    size = member.groupBy("link", "key").agg(F.count(F.lit(1)).alias("members"), F.min("member").alias("representative")).where(F.col("members") >= least)
    return member.join(size, ["link", "key"]).select("member", "link", F.xxhash64("key").alias("class_id"), "members", "representative")


def related_to(rows: DataFrame, ident: str, one: str, keys: Sequence[str]) -> DataFrame:
    """The rows that share any key with one row: its keys are one row, crossed in, rows are only filtered."""
    of = rows.where(F.col(ident) == one).agg(*[F.collect_set(S.text(F.col(k))).alias(f"__{k}") for k in keys])
    hit = reduce(lambda a, b: a | b, [(S.text(F.col(k)) != "") & F.array_contains(F.col(f"__{k}"), S.text(F.col(k))) for k in keys])
    return rows.where(F.col(ident) != one).crossJoin(F.broadcast(of)).where(hit).select(ident).distinct()


# ------------------------------------------------------------------ inspection


def seed_condition(query: str) -> Column:
    """Rows that a query is about: their id, run or address, one of their links, their raw record, a post's number."""
    q = query.strip()[:500]
    raw = F.coalesce("raw_json", F.lit(""))
    cond = (F.col("evidence_id") == q) | (F.col("collector_run_id") == q) | (F.col("canonical_url") == q) | F.coalesce(F.array_contains("links", q), F.lit(False)) | F.lower(raw).contains(q.lower())
    if m := re.search(r"(?:x|twitter)\.com/[^/\s]+/status/(\d+)", q):
        cond |= (F.col("evidence_id") == m[1]) | F.col("canonical_url").contains(f"/status/{m[1]}") | raw.contains(m[1])
    return F.coalesce(cond, F.lit(False))


def inspect(events: DataFrame, query: str, seeds: int = 80, runs: int = 20, related: int = 300) -> DataFrame:
    """What a query is about and what was captured with it: seed rows, then rows of their first runs, first per event.

    The limits are the view's: newest seeds, runs in their order, rows of the runs by time.
    """
    found = events.where(seed_condition(query)).withColumn("__tie", F.xxhash64(*[c for c in events.columns if c not in ("topics", "entities", "links")]))
    top = found.orderBy(F.desc("ingested_at"), F.asc("event_id"), F.asc("evidence_id"), F.asc("__tie")).limit(seeds)
    of = top.where(F.coalesce("collector_run_id", F.lit("")) != "").groupBy("collector_run_id").agg(F.max(F.struct("ingested_at", "event_id")).alias("at"))
    of = of.orderBy(F.desc("at"), F.asc("collector_run_id")).limit(runs).select("collector_run_id")
    with_them = events.join(F.broadcast(of), "collector_run_id", "left_semi").orderBy(F.asc("captured_at"), F.asc("source_kind"), F.asc("event_id"), F.asc("evidence_id")).limit(related)
    both = top.drop("__tie").select(*events.columns, F.lit(0).alias("__prio")).unionByName(with_them.select(*events.columns, F.lit(1).alias("__prio")))
    w = Window.partitionBy("event_id").orderBy("__prio", F.desc("ingested_at"), "captured_at", "source_kind", "evidence_id")  # a page's rows
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__prio")


def longest_by_kind(rows: DataFrame) -> DataFrame:
    """The row of the longest text of each kind."""
    return rows.groupBy("source_kind").agg(F.max_by(F.struct("event_id", "evidence_id", F.char_length("text").alias("text_chars")), F.struct(F.coalesce(F.char_length("text"), F.lit(0)), "event_id", "evidence_id")).alias("r")).select("source_kind", "r.*")


# ------------------------------------------------------------------ claims


def claims(rows: DataFrame, ident: str, text: str, source: str, property_: str) -> DataFrame:
    """``claim_id, source_id, claim_text, subject, property, value, scoped``: texts read as claims."""
    p = S.claim_parts(F.col(text))
    return rows.where(S.text(F.col(text)) != "").select(
        F.col(ident).alias("claim_id"), F.col(source).alias("source_id"), S.text(F.col(text)).alias("claim_text"), p["subject"].alias("subject"),
        F.coalesce(F.nullif(S.text(F.col(property_)), F.lit("")), F.lit("general")).alias("property"), F.coalesce(F.nullif(p["value"], F.lit("")), S.text(F.col(text))).alias("value"), p["scoped"].alias("scoped"),
    )


def _propositions(rows: DataFrame) -> DataFrame:
    key = (F.lower("subject").alias("subject_key"), F.lower("property").alias("property_key"))
    return rows.where("scoped").groupBy(*key).agg(F.count(F.lit(1)).alias("assertions"), F.countDistinct(F.lower("value")).alias("values_n"), F.countDistinct("source_id").alias("sources"), F.min_by("claim_text", "claim_id").alias("preferred"))


def proposition_sizes(rows: DataFrame) -> DataFrame:
    """``claim_id, cluster_size``: the number of claims on the same subject and property if their values differ, else 1."""
    size = _propositions(rows).select("subject_key", "property_key", F.when(F.col("values_n") > 1, F.col("assertions")).otherwise(1).alias("cluster_size"))
    own = rows.withColumns({"subject_key": F.when(F.col("scoped"), F.lower("subject")), "property_key": F.lower("property")})
    return own.join(size, ["subject_key", "property_key"], "left").select("claim_id", F.coalesce("cluster_size", F.lit(1).cast("long")).alias("cluster_size"))


def conflict_clusters(rows: DataFrame) -> DataFrame:
    """Scoped claims on one subject and property that state different values."""
    c = _propositions(rows).where((F.col("assertions") > 1) & (F.col("values_n") > 1))
    key = F.concat_ws("|", "subject_key", "property_key")
    return c.select(F.concat(F.lit("conflict_cluster:"), F.substring(F.sha1(key), 1, 16)).alias("cluster_id"), key.alias("proposition"), "assertions", "values_n", "sources", "preferred")


def duplicate_clusters(rows: DataFrame) -> DataFrame:
    """Scoped claims of equal text."""
    g = rows.where("scoped").groupBy(F.lower("claim_text").alias("text_key")).agg(F.count(F.lit(1)).alias("assertions"), F.countDistinct("source_id").alias("sources"))
    return g.where("assertions > 1").select(F.concat(F.lit("duplicate_cluster:"), F.substring("text_key", 1, 120)).alias("cluster_id"), "assertions", "sources")


def contradictions(rows: DataFrame, top: int = 5) -> DataFrame:
    """The subjects with the most different values, at least two."""
    g = rows.where("scoped").groupBy(F.lower("subject").alias("subject_key")).agg(F.countDistinct(F.lower("value")).alias("values_n"), F.count(F.lit(1)).alias("assertions")).where("values_n > 1")
    return g.orderBy(F.desc("values_n"), F.desc("assertions"), F.asc("subject_key")).limit(top)


#: Kinds of selections that support, refute or give context to a claim (fixed lists).
SUPPORT, REFUTE, CONTEXT = ("quote", "text", "support", "supports"), ("refute", "refutes", "contradict"), ("context", "related")


def support_counts(rows: DataFrame, selections: DataFrame) -> DataFrame:
    """``claim_id, support, refute, context``: selections (source_id, selection_kind) of a claim's source by what they say."""
    k = F.lower("selection_kind")
    per = selections.groupBy("source_id").agg(*[F.count_if(k.isin(*kinds)).alias(n) for n, kinds in (("support", SUPPORT), ("refute", REFUTE), ("context", CONTEXT))])
    out = rows.select("claim_id", "source_id").join(per, "source_id", "left")
    return out.select("claim_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("support", "refute", "context")])


def fact_matches(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``claim_id, facts``: facts (source_id, raw_value) of a claim's source whose value is in the claim's or the other way round."""
    v, f = F.lower(F.trim("value")), F.lower(F.trim("raw_value"))
    hit = (f != "") & (v.contains(f) | f.contains(v))
    return rows.join(facts, "source_id").where(hit).groupBy("claim_id").agg(F.count(F.lit(1)).alias("facts"))


def entity_claims(rows: DataFrame, name: str, source_ids: DataFrame) -> DataFrame:
    """Claims that touch an entity: of one of its sources (source_id), or with a word of its name (over two letters)."""
    words = [w for w in re.split(r"\s+", name.lower()) if len(w) > 2]
    named = reduce(lambda a, b: a | b, [F.lower("claim_text").contains(w) for w in words], F.lit(False))
    marked = rows.join(source_ids.select("source_id").distinct().withColumn("__own", F.lit(True)), "source_id", "left")
    return marked.where(F.coalesce("__own", F.lit(False)) | named).drop("__own")


def topic_claims(rows: DataFrame, term: str, source_ids: DataFrame) -> DataFrame:
    """Claims of a topic: of one of its sources, or whose text holds the term."""
    marked = rows.join(source_ids.select("source_id").distinct().withColumn("__own", F.lit(True)), "source_id", "left")
    return marked.where(F.coalesce("__own", F.lit(False)) | F.lower("claim_text").contains(term.lower())).drop("__own")


#: What marks a cell's state, by words in its claims' qualifiers, their relations and statuses (fixed lists).
MARKS = {
    "na": ("not_applicable", "not applicable", "n/a", '"na"', "no_result"),
    "incomparable": ("incompatible", "different_setup", "different setup", "different_metric", "not_comparable", "not comparable"),
    "stale": ("stale", "outdated", "superseded_by", "superseded by"),
    "reproduced": ("reproduced", "replicated", "rerun", "repeatable"),
    "independent": ("independent", "third_party", "third party", "measured"),
}
INDEPENDENT_KINDS = ("media", "search_result", "google_search_page")
_RANKS = (("accepted", "published"), ("under_review", "draft", "proposed"), ("disputed", "changes_requested"), ("rejected", "superseded"))


def compare_matrix(rows: DataFrame, subjects: int = 10, properties: int = 40, order: str = "claim_id") -> DataFrame:
    """``property, subject, state, assertions, values_n, claim_id``: one cell for each property and subject of a comparison.

    Subjects and properties come in first-seen order and are as many as the view shows. Rows have ``review_state``,
    ``relation``, ``qualifier`` and ``source_kind`` beside the claim's columns. The state is that of the first of eight
    rules that holds for a cell's claims; the selected claim is the best by review state, then the first.
    """
    c = rows.where("scoped")

    def firsts(column: str, most: int) -> DataFrame:
        return c.groupBy(column).agg(F.min(order).alias("__first")).orderBy("__first", column).limit(most).select(column)

    grid = firsts("property", properties).crossJoin(F.broadcast(firsts("subject", subjects)))  # two bounded axes
    status, relation, q = (F.lower(F.coalesce(n, F.lit(""))) for n in ("review_state", "relation", "qualifier"))
    rank = reduce(lambda w, i: w.when(status.isin(*_RANKS[i]), i), range(len(_RANKS)), F).otherwise(len(_RANKS))
    marked = {k: F.bool_or(S.contains_any(q, *words)).alias(k) for k, words in MARKS.items()}
    cells = c.groupBy("property", "subject").agg(
        F.min_by(F.struct("claim_id", "source_kind", "source_id"), F.struct(rank, F.col(order))).alias("s"), F.count(F.lit(1)).alias("assertions"), F.countDistinct(F.lower("value")).alias("values_n"),
        F.bool_and(status.isin("rejected", "superseded")).alias("gone"), F.bool_or(relation.isin("refutes", "contradicts") | (status == "disputed")).alias("refuted"), F.bool_or(relation.isin("reproduced", "replicated")).alias("again"), F.bool_or(status.isin("accepted", "published")).alias("accepted"), *marked.values(),
    )
    col = F.col
    state = (
        F.when(col("assertions").isNull(), "Missing")
        .when(col("gone") | col("na"), "NA")
        .when(col("incomparable"), "Incomparable")
        .when(col("stale"), "Stale")
        .when(col("refuted") | (col("values_n") > 1), "Disputed")
        .when(col("reproduced") | col("again"), "Reproduced")
        .when(col("accepted") & (F.lower("s.source_kind").isin(*INDEPENDENT_KINDS) | col("independent")), "Independently-measured")
        .when(F.coalesce("s.source_id", F.lit("")) != "", "Vendor-reported")
        .otherwise("Incomparable")
    )
    out = grid.join(cells, ["property", "subject"], "left")
    return out.select("property", "subject", state.alias("state"), F.coalesce("assertions", F.lit(0)).alias("assertions"), F.coalesce("values_n", F.lit(0)).alias("values_n"), col("s.claim_id").alias("claim_id"))


# ------------------------------------------------------------------ time, attempts, revisions


def in_dates(rows: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows by their date text; undated ones go only where a range is asked for."""
    day = F.substring(S.text(F.col(column)), 1, 10)
    cond = F.lit(True)
    if start or end:
        cond = (day != "") & (day >= (start or "")) & (day <= (end or "9999"))
    return rows.where(cond)


def timeline_order(selected: str, date: str, ident: str) -> list[Column]:
    return [F.asc(F.coalesce(F.nullif(S.text(F.col(selected)), F.lit("")), F.nullif(S.text(F.col(date)), F.lit("")), F.lit("9999"))), F.asc(ident)]


def fold_attempts(events: DataFrame, key: str = "subject_id", kind: str = "event_type", at: str = "created_at", ident: str = "event_id") -> DataFrame:
    """One row per attempt: when it was asked for, its state and outcome.

    The last outcome in time decides: committed, failed, or launched, which never takes back a commit. An outcome without
    a request is an attempt of its own. Partial aggregates by key, no event list.
    """
    t = F.col(kind)
    when = lambda end: F.max(F.when(t.endswith(end), F.struct(at, ident)))
    g = events.groupBy(F.col(key).alias("subject_id")).agg(
        F.min(F.when(t.endswith(".launch_requested"), F.struct(at, ident))).alias("q"), when(".committed").alias("c"), when(".launch_result").alias("l"), when(".launch_failed").alias("f")
    )
    outcome = F.greatest("c", "f", F.when(F.col("c").isNull(), F.col("l")))
    state = F.when(outcome.isNull(), "requested").when(outcome == F.col("c"), "committed").when(outcome == F.col("f"), "failed").otherwise("launched")
    return g.where(F.col("q").isNotNull() | outcome.isNotNull()).select("subject_id", F.col(f"q.{ident}").alias("request_event_id"), F.coalesce(F.col(f"q.{at}"), F.least(F.col(f"c.{at}"), F.col(f"f.{at}"), F.col(f"l.{at}"))).alias("requested_at"), state.alias("state"), outcome[ident].alias("outcome_event_id"))


def latest_revision(rows: DataFrame, key: str, number: str, updated: str, ident: str) -> DataFrame:
    """The revision of greatest number, of equal numbers the newest."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(number, updated, ident)).alias("r")).select(key, *[f"r.{c}" for c in rest])


def request_rows(counters: DataFrame, observations: DataFrame) -> DataFrame:
    """Requests by model, operation and status with the averages of their model's and operation's observations.

    ``counters`` has labels (map) and sample; ``observations`` name, labels, total, n and most.
    """
    lab = lambda n: F.coalesce(F.col("labels")[n], F.lit("")).alias(n)
    rows = counters.groupBy(lab("model"), lab("operation"), lab("status")).agg(F.sum("sample").alias("requests"))
    per = observations.groupBy(lab("model"), lab("operation"), "name").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("most").alias("most")).where("n > 0")
    one = lambda n, e: F.max(F.when(F.col("name") == n, e))
    avg = F.col("total") / F.col("n")
    wide = per.groupBy("model", "operation").agg(one("duration", avg).alias("avg_duration"), one("duration", F.col("most")).alias("max_duration"), one("queue", avg).alias("avg_queue"), one("batch", avg).alias("avg_batch"))
    return rows.join(wide, ["model", "operation"], "left")


# ------------------------------------------------------------------ cursors and briefs


def encode_cursor(limit: int, key: str) -> str:
    """An opaque token of a page's limit and the sort key of its last row."""
    return base64.urlsafe_b64encode(json.dumps({"l": int(limit), "k": key}, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(token: str) -> tuple[int, str] | None:
    """Limit and key of a token; None for what is none."""
    try:
        made = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        return int(made["l"]), str(made["k"])
    except (ValueError, KeyError, TypeError):
        return None


def next_cursor(shown: int, total: int, limit: int, last_key: str) -> str | None:
    """The token of the page that follows, None where all rows are shown."""
    return encode_cursor(limit, last_key) if shown and total > shown else None


def definition_parts(c: Column) -> Column:
    """``struct<term, definition>`` of ``term: definition`` or ``term - definition``; without either all is the term."""
    t = S.text(c)
    colon, dash = t.contains(":"), t.contains(" - ")
    term = F.when(colon, F.substring_index(t, ":", 1)).when(dash, F.substring_index(t, " - ", 1)).otherwise(t)
    rest = F.when(colon, F.regexp_extract(t, r"(?s)^[^:]*:(.*)$", 1)).when(dash, F.regexp_extract(t, r"(?s)^.*? - (.*)$", 1)).otherwise("")
    term = F.substring(S.text(term), 1, 240)
    return F.struct(F.coalesce(F.nullif(term, F.lit("")), F.lit("Untitled term")).alias("term"), F.substring(S.text(rest), 1, 10_000).alias("definition"))


def brief_items(c: Column, most: int = 5000) -> Column:
    """The lines of a brief as items, trimmed and cut, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), lambda x: F.rtrim(F.substring(S.text(x), 1, most))), lambda x: x != "")


def merge_recent(parts: Sequence[DataFrame], at: str, ident: str, each: int = 50, most: int = 80) -> DataFrame:
    """The newest rows of several tables, the newest of all first."""
    order = lambda df: df.orderBy(F.desc(at), F.asc(ident))
    return order(union_all([order(p).limit(each) for p in parts])).limit(most)
