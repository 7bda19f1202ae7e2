"""Hybrid retrieval: exact, keyword and vector branches, weighted reciprocal rank fusion, hydration, reranking."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import scalars as S

#: Weights of the branches and the constant of the fusion (fixed values).
WEIGHTS = {"exact": 4.0, "keyword": 1.2, "text_dense": 1.0, "ocr_dense": 0.95, "vl_image_dense": 0.85, "caption_dense": 0.75, "account_dense": 0.6, "rerank": 2.0}
K = 60
#: Branches of the search modes; exact is in all, an unknown mode is hybrid (fixed values).
_TEXT = ("text_dense", "ocr_dense", "caption_dense", "account_dense")
MODES = {"hybrid": ("exact", "keyword", *_TEXT), "keyword": ("exact", "keyword"), "semantic": ("exact", *_TEXT), "visual": ("exact", "vl_image_dense", "caption_dense", "ocr_dense", "text_dense"), "precision": ("exact", "keyword", *_TEXT)}
#: Filters and the names that requests give them (fixed values).
ALIASES = {
    "source_projects": ("source_projects", "source_project", "projects", "project"),
    "source_kinds": ("source_kinds", "source_kind", "kinds", "kind"),
    "author_handles": ("author_handles", "author_handle", "handles", "handle"),
    "domains": ("domains", "domain"),
    "topics": ("topics", "topic"),
    "entities": ("entities", "entity"),
}
_COLUMN = {"source_projects": "source_project", "source_kinds": "source_kind", "author_handles": "author_handle", "domains": "domain", "topics": "topics", "entities": "entities"}
MOST_RESULTS, RERANKED = 100, 3


def normal_filters(asked: dict | None) -> dict:
    """A request's filters under their own names: values of all aliases in order and once, flags, dates."""
    asked = asked or {}
    out: dict = {}
    for name, aliases in ALIASES.items():
        values: list[str] = []
        for a in aliases:
            given = asked.get(a)
            values += [x for x in (str(v).strip() for v in (given if isinstance(given, (list, tuple)) else [] if given is None else str(given).split(","))) if x]
        if values:
            out[name] = list(dict.fromkeys(values))
    for flag in ("has_media", "has_ocr"):
        if asked.get(flag) not in (None, ""):
            out[flag] = bool(S.tristate(str(asked[flag])))
    for day in ("date_from", "date_to"):
        if v := str(asked.get(day) or "").strip():
            out[day] = v
    return out


def day_bound(value: str, start: bool) -> Column:
    """The instant (without zone, UTC) that a date bound means: a bare day as upper bound is its last second."""
    bare = re.fullmatch(r"\d{4}-\d{2}-\d{2}", value) is not None
    t = S.instant(F.lit(value)).cast("timestamp_ntz")
    return t + F.expr("INTERVAL 86399 SECOND") if bare and not start else t


def row_filter(filters: dict, day_bounds: bool = False) -> Column:
    """The condition on evidence rows; lists match any of their values, handles without @ and case.

    Date bounds are instants, inclusive; ``day_bounds`` takes a bare upper bound as the whole day (index searches).
    """
    cond = F.lit(True)
    for name, column in _COLUMN.items():
        if values := filters.get(name):
            if name == "author_handles":
                cond &= F.regexp_replace(F.lower(column), "^@+", "").isin([v.lower().lstrip("@") for v in values])
            elif name in ("topics", "entities"):
                cond &= F.arrays_overlap(column, F.array(*[F.lit(v) for v in values]))
            else:
                cond &= F.col(column).isin(values)
    for flag in ("has_media", "has_ocr"):
        if flag in filters:
            cond &= F.col(flag) == int(filters[flag])
    for name, start in (("date_from", True), ("date_to", False)):
        if v := filters.get(name):
            t = day_bound(v, start) if day_bounds else S.instant(F.lit(v)).cast("timestamp_ntz")
            cond &= (F.col("captured_at") >= t) if start else (F.col("captured_at") <= t)
    return cond


def payload_filter(filters: dict) -> Column:
    """The condition on vector payloads: as on rows, but dates only where both bounds name one day."""
    of = {k: v for k, v in filters.items() if k not in ("date_from", "date_to", "has_ocr")}
    cond = row_filter(of)
    if (day := filters.get("date_from")) and day == filters.get("date_to") and re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
        cond &= F.date_format("captured_at", "yyyy-MM-dd") == day
    return cond


def branch_limit(limit: int) -> int:
    return min(80, max(4 * limit, 20))


def ranked(df: DataFrame, branch: str, score: str, ident: str, limit: int) -> DataFrame:
    """``evidence_id, branch, rank, score`` of a branch's best rows: a top-k, then ranks over those k only."""
    top = df.orderBy(F.desc(score), F.asc(ident)).limit(limit)
    w = Window.orderBy(F.desc(score), F.asc(ident))
    return top.select(F.col(ident).alias("evidence_id"), F.lit(branch).alias("branch"), F.row_number().over(w).alias("rank"), F.col(score).cast("double").alias("score"))


def exact(rows: DataFrame, query: str, limit: int, ts: str = "ingested_at", filters: dict | None = None, state: DataFrame | None = None) -> DataFrame:
    """Ids that the query names: those of its look-up keys in ``state`` (key, evidence_id) first, then rows whose id,
    address or handle it is, newest first; one rank per evidence id."""
    q = query.strip()
    hit = rows.where(row_filter(filters or {}) & ((F.col("evidence_id") == q) | (F.col("canonical_url") == q) | (F.regexp_replace(F.lower("author_handle"), "^@+", "") == q.lstrip("@").lower())))
    newest = hit.groupBy("evidence_id").agg(F.max(F.unix_timestamp(F.col(ts).cast("timestamp"))).cast("double").alias("at"))
    if state is not None and (keys := lookup_keys(q)[:5]):
        first = F.lit(1e18) - F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key")) * F.lit(1e12)
        known = state.where(F.col("key").isin(keys)).select("evidence_id", first.alias("at"))
        newest = known.unionByName(newest).groupBy("evidence_id").agg(F.max("at").alias("at"))
    return ranked(newest, "exact", "at", "evidence_id", limit)


#: Kinds of keys that the state knows (fixed list).
KEY_KINDS = ("post", "account", "media", "search", "capture", "user_input", "web_document")


def lookup_keys(query: str) -> list[str]:
    """Keys that a query may name, in order: itself, the post of an address or a number, an account."""
    q = query.strip()
    out = [q] if q.split("/")[0] in KEY_KINDS and "/" in q else []
    if m := re.search(r"(?:x|twitter)\.com/[^/\s]+/status/(\d+)", q):
        out.append(f"post/{m[1]}")
    if re.fullmatch(r"\d{12,25}", q):
        out.append(f"post/{q}")
    if re.fullmatch(r"@?[A-Za-z0-9_]{1,30}", q):
        out.append(f"account/{q.lower().lstrip('@')}")
    return list(dict.fromkeys(out))


def _occurrences(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def keyword_scores(rows: DataFrame, query: str, fields: dict[str, float], ident: str = "evidence_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``ident, score`` of every row that holds a term of the query, by BM25 over weighted fields; the whole match set.

    Lengths and term counts are taken once per row, the corpus's size, mean length and document frequencies are one
    row crossed in, a side of one row.
    """
    terms = sorted(set(t for t in query.lower().split() if t))
    if not terms:
        return rows.where(F.lit(False)).select(ident, F.lit(0.0).alias("score"))
    words = F.concat(*[F.array_repeat(F.split(F.lower(F.coalesce(F.col(f), F.lit(""))), r"[^\p{L}\p{N}]+"), max(1, round(w))) for f, w in fields.items()])
    doc = rows.select(ident, F.filter(F.flatten(words), lambda x: x != "").alias("w"))
    doc = doc.select(ident, F.size("w").alias("len"), F.array(*[_occurrences("w", t) for t in terms]).alias("tf"))
    stats = doc.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.coalesce(F.avg("len"), F.lit(1.0)), F.lit(1e-9)).alias("mean"), F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(terms))]).alias("df"))
    hits = doc.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))  # one row
    parts = []
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col("df")[i] + 0.5) / (F.col("df")[i] + 0.5))
        f = F.col("tf")[i]
        parts.append(idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("mean"))))
    return hits.groupBy(ident).agg(F.max(reduce(lambda x, y: x + y, parts)).alias("score"))


def keyword(rows: DataFrame, query: str, fields: dict[str, float], limit: int, ident: str = "evidence_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The best ``limit`` matches of the query's terms, with ranks; see ``keyword_scores``."""
    return ranked(keyword_scores(rows, query, fields, ident, k1, b), "keyword", "score", ident, limit)


def vector(points: DataFrame, query: Sequence[float], branch: str, limit: int, ident: str = "evidence_id", embedding: str = "embedding", where: Column | None = None) -> DataFrame:
    """Exact nearest points by cosine; payload filters come before the scoring."""
    base = points if where is None else points.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return ranked(base.select(ident, S.cosine(F.col(embedding), q).alias("score")), branch, "score", ident, limit)


def vector_of(points: DataFrame, query: DataFrame, branch: str, limit: int, ident: str = "evidence_id", embedding: str = "embedding") -> DataFrame:
    """Nearest points to the one vector ``q`` that ``query`` holds: its single row is crossed in, each vector made once."""
    one = F.get(F.transform(F.array(embedding), lambda v: S.cosine(v, F.col("q"))), F.lit(0))
    return ranked(points.crossJoin(F.broadcast(query.select("q").limit(1))).select(ident, one.alias("score")), branch, "score", ident, limit)


def fuse(branches: Sequence[DataFrame], weights: dict[str, float] = WEIGHTS, k: int = K) -> DataFrame:
    """Weighted reciprocal rank fusion: sum of weight / (k + best rank) over the branches of a candidate."""
    both = reduce(DataFrame.unionByName, branches)
    best = both.groupBy("evidence_id", "branch").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    w = F.coalesce(F.try_element_at(table, F.col("branch")), F.lit(1.0))
    return best.groupBy("evidence_id").agg(F.sum(w / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("branch", "rank")))).alias("ranks"))


def hydrate(candidates: DataFrame, latest: DataFrame, payload: DataFrame | None = None) -> DataFrame:
    """Candidates with their latest row; what that lacks comes from the branches' own payload."""
    out = candidates.join(latest, "evidence_id", "left")
    if payload is None:
        return out
    both = [c for c in payload.columns if c != "evidence_id"]
    out = out.join(payload.select("evidence_id", *[F.col(c).alias(f"__{c}") for c in both]), "evidence_id", "left")
    for c in both:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"__{c}")) if c in out.columns else F.col(f"__{c}"))
    return out.drop(*[f"__{c}" for c in both])


def rerank_document(title: str = "title", snippet: str = "snippet", url: str = "canonical_url", topics: str = "topics", entities: str = "entities") -> Column:
    """What a reranker reads of a hit: its non-empty parts by line, at most 2,200 characters."""
    parts = [F.nullif(F.col(c), F.lit("")) for c in (title, snippet, url)] + [F.nullif(F.array_join(c, " "), F.lit("")) for c in (topics, entities)]
    return F.substring(F.concat_ws("\n", *parts), 1, 2200)


def plan_search(request: dict) -> dict:
    """A request made definite: query, mode, branches, limits, filters, whether to rerank. ValueError without a query."""
    query = str(request.get("query") or "").strip()
    if not query:
        raise ValueError("query is required")
    mode = str(request.get("mode") or "hybrid").strip().lower()
    mode = mode if mode in MODES else "hybrid"
    limit = S.clamp(request.get("limit"), 20, MOST_RESULTS)
    rerank_mode = "sync" if mode == "precision" else str(request.get("rerank") or "off").lower()
    return {"query": query, "mode": mode, "branches": MODES[mode], "limit": limit, "branch_limit": branch_limit(limit), "filters": normal_filters(request.get("filters")), "rerank": rerank_mode == "sync", "reranked": min(RERANKED, limit)}


def search(request: dict, branches: dict[str, Callable[[dict], DataFrame]], latest: DataFrame, scorer: Callable[[Column], Column] | None = None) -> tuple[DataFrame, dict]:
    """The hits of a request and what happened: each branch of its mode, fused, hydrated, reranked.

    ``branches`` makes a branch's ranked candidates from the definite request. A branch that lacks or raises is told
    among ``errors`` and the answer is degraded, the others still count.
    """
    asked = plan_search(request)
    made, errors = [], []
    for name in asked["branches"]:
        try:
            made.append(branches[name](asked))
        except Exception as e:  # noqa: BLE001 - a branch is an outside service as a rule
            errors.append({"branch": name, "reason": "branch_unavailable", "severity": "warn", "error": str(e)})
    info = {**asked, "errors": errors, "degraded": bool(errors), "warnings": [] if made else [{"stage": "search", "reason": "no_branch", "severity": "warn"}]}
    if not made:
        return latest.where(F.lit(False)).withColumn("score", F.lit(0.0)), info
    top = fuse(made).orderBy(F.desc("score"), F.asc("evidence_id")).limit(asked["limit"])
    hits = hydrate(top, latest)
    if asked["rerank"] and scorer is not None:
        hits = rerank(hits, scorer, "title", asked["reranked"])
    return hits.orderBy(F.desc("score"), F.asc("evidence_id")), info




def rerank(candidates: DataFrame, scorer: Callable[[Column], Column], text: str, top: int = 3, k: int = K, weight: float = WEIGHTS["rerank"]) -> DataFrame:
    """The best ``top`` candidates get weight / (k + rank by the scorer) on top of their score."""
    w = Window.orderBy(F.desc("score"), F.asc("evidence_id"))
    head = candidates.orderBy(F.desc("score"), F.asc("evidence_id")).limit(top).withColumn("rr", scorer(F.col(text)))
    head = head.select("evidence_id", F.row_number().over(Window.orderBy(F.desc("rr"), F.asc("evidence_id"))).alias("rerank_rank"))
    out = candidates.join(F.broadcast(head), "evidence_id", "left")  # at most `top` rows
    out = out.withColumn("score", F.col("score") + F.when(F.col("rerank_rank").isNull(), 0.0).otherwise(F.lit(weight) / (F.lit(float(k)) + F.col("rerank_rank"))))
    return out.orderBy(F.desc("score"), F.asc("evidence_id"))


def stand_in_embedding(text: Column, size: int = 16) -> Column:
    """A deterministic stand-in for a model's vector: hashed word counts. Not a model, for tests and wiring only."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    slots = F.transform(words, lambda x: F.pmod(F.xxhash64(x), F.lit(size)))
    counted = lambda s: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("float"))
    return F.get(F.transform(F.array(slots), counted), F.lit(0))  # the slots are worked out once
