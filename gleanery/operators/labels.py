"""Deterministic labels of evidence rows as native expressions, and the research plans made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import scalars as S

#: Labels by source kind, forms by kind, ordered needles of web forms, needles of modalities (fixed values).
SOURCE = {"x_post": "source.x.post", "x_account": "source.x.profile", "x_page": "source.x.page", "google_search_page": "source.google.serp", "search_result": "source.search.result", "web_page": "source.web.page", "user_input": "source.user.input", "media": "source.media", "capture": "source.capture"}
FORM = {"x_post": ("form.social_post", 1.0), "x_account": ("form.social_profile", 1.0), "x_page": ("form.social_page", 0.95), "google_search_page": ("form.search_page", 0.95), "search_result": ("form.search_result", 1.0), "media": ("form.media_artifact", 0.95), "user_input": ("form.user_note", 1.0), "capture": ("form.capture", 0.9)}
WEB_FORMS = (
    (("leaderboard", "rank", "score", "benchmark"), "form.leaderboard", 0.82),
    (("docs", "documentation", "api reference", "reference"), "form.docs_page", 0.78),
    (("pricing", "price", "$/mo", "free plan", "enterprise plan"), "form.pricing_page", 0.78),
    (("model card", "model-card"), "form.model_card", 0.8),
    (("blog", "release notes", "announcing", "launching"), "form.blog_post", 0.7),
)
IMAGE, VIDEO = (".png", ".jpg", ".jpeg", ".webp", ".gif"), (".mp4", ".mov", ".webm")
TABLE, CODE = ("table", "leaderboard", "rank", "score"), ("github.com", ".go", ".py", ".js", "```")
COMPARE, VERIFY = ("benchmark", "leaderboard", "score", "rank"), ("launch", "release", "announcing", "available", "model card")


def _table(kinds: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])


def _kept(*labels: Column) -> Column:
    return F.filter(F.array(*labels), lambda x: x.isNotNull())


def source_label(kind: Column) -> Column:
    return F.when(S.text(kind) != "", F.coalesce(F.try_element_at(_table(SOURCE), kind), F.concat(F.lit("source."), S.slug(kind))))


def with_haystacks(rows: DataFrame) -> DataFrame:
    """The lower-cased texts that rules search, made once per row and not once per needle."""
    topics = F.array_join(F.coalesce("topics", F.array().cast("array<string>")), " ") if "topics" in rows.columns else F.lit("")
    return rows.withColumns(
        {
            "__look": F.lower(F.concat_ws(" ", *[S.text(F.col(c)) for c in ("text", "title", "canonical_url")])),
            "__form": F.lower(F.concat_ws(" ", *[S.text(F.col(c)) for c in ("source_kind", "domain", "canonical_url", "title", "text")])),
            "__act": F.lower(F.concat_ws(" ", *[S.text(F.col(c)) for c in ("source_kind", "title", "text")], topics)),
        }
    )


#: What a media kind must hold for a modality, and the further needles that re-labelling looks for (fixed lists).
KIND_IMAGE, KIND_VIDEO, KIND_PDF = ("image", "photo", "screenshot"), ("video", "mp4", "mov"), ("pdf",)
AGAIN = {"image": ("image", "screenshot"), "video": ("video",), "pdf": (" pdf",)}


def modality_labels(media_kind: Column | None = None, again: bool = False) -> Column:
    """Labels of a row with haystacks; ``again`` is the wider rule of re-labelling, over kind and domain too."""
    t = F.col("__form") if again else F.col("__look")
    kind = F.lower(F.coalesce(media_kind, F.lit(""))) if media_kind is not None else F.lit("")
    more = AGAIN if again else {"image": (), "video": (), "pdf": ()}
    return _kept(
        F.when((F.coalesce("text", F.lit("")) != "") | (F.coalesce("title", F.lit("")) != ""), "modality.text"),
        F.when((F.col("has_media") == 1) | S.contains_any(kind, *KIND_IMAGE) | S.contains_any(t, *IMAGE, *more["image"]), "modality.image"),
        F.when(S.contains_any(kind, *KIND_VIDEO) | S.contains_any(t, *VIDEO, *more["video"]), "modality.video"),
        F.when(S.contains_any(kind, *KIND_PDF) | S.contains_any(t, ".pdf", *more["pdf"]), "modality.pdf"),
        F.when(S.contains_any(t, *TABLE), "modality.table"),
        F.when(S.contains_any(t, *CODE), "modality.code"),
    )


def form_label() -> Column:
    """``struct<label, confidence>``: by kind first, then the first rule whose needle is in the row."""
    hay = F.col("__form")
    github = S.text(F.col("domain")).contains("github.com")

    def made(label: str, confidence: float) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))

    rules = F.when(hay.contains(".pdf"), made("form.pdf", 0.94)).when(github & S.contains_any(hay, "/blob/", "/tree/"), made("form.github_file", 0.9)).when(github, made("form.github_repo", 0.84))
    for needles, label, confidence in WEB_FORMS:
        rules = rules.when(S.contains_any(hay, *needles), made(label, confidence))
    rules = rules.otherwise(made("form.web_page", 0.6))
    kind = F
    for k, (label, confidence) in FORM.items():
        kind = kind.when(F.col("source_kind") == k, made(label, confidence))
    return kind.otherwise(rules)


def quality_labels(flags: Column | None = None) -> Column:
    own = _kept(
        F.when(F.col("has_ocr") == 1, "quality.has_ocr"),
        F.when((S.text(F.col("canonical_url")) != "") & (F.col("source_kind") == "web_page"), "quality.direct_web_capture"),
        F.when(F.col("source_kind") == "user_input", "quality.user_supplied"),
    )
    return F.array_distinct(F.concat(F.transform(flags, lambda f: F.concat(F.lit("quality."), S.slug(f))), own)) if flags is not None else own


def action_labels(challenge: Column | None = None) -> Column:
    hay = F.col("__act")
    return _kept(
        F.when(challenge, "action.review_capture") if challenge is not None else F.lit(None).cast("string"),
        F.when(S.contains_any(hay, *COMPARE), "action.compare"),
        F.when(S.contains_any(hay, *VERIFY), "action.verify"),
        F.when((F.col("source_kind") == "search_result") | (F.coalesce(F.size("links"), F.lit(0)) > 0), "action.collect_more"),
        F.when(F.col("source_kind") == "user_input", "action.review"),
    )


def annotate(rows: DataFrame, flags: str | None = None, media_kind: str | None = None, again: bool = False) -> DataFrame:
    """One row per label: event_id, evidence_id, input_hash, family, label_id, status, confidence, value_json, position.

    Everything is one projection and one ``inline``; families come in a fixed order per row, ``position`` counts within
    a family. ``flags`` names a column with a quality object's JSON text: its set flags become labels and a challenge
    asks for a review. ``media_kind`` names a column with a kind of media. ``again`` is the profile of re-labelling:
    wider needles, no flags. Equal labels of one row count once.
    """
    from gleanery.operators.ingest import challenged, quality_flags

    def made(labels: Column, family: str, status, confidence, value) -> Column:
        return F.transform(
            F.array_distinct(labels),
            lambda x, i: F.struct(F.lit(family).alias("family"), x["label"].alias("label_id"), status(x).alias("status"), confidence(x).alias("confidence"), value(x).alias("value_json"), i.alias("position")),
        )

    def plain(labels: Column, family: str, status: str, confidence: float) -> Column:
        return made(F.transform(labels, lambda x: F.struct(x.alias("label"))), family, lambda x: F.lit(status), lambda x: F.lit(confidence), lambda x: F.col("__kind_json"))

    def texts(c: str, family: str, label, confidence: float, name: str) -> Column:
        many = F.filter(F.transform(S.clean_list(F.col(c)), lambda x: F.struct(label(x).alias("label"), x.alias("value"))), lambda s: s["label"] != "topic.")
        return made(many, family, lambda x: F.lit("proposed"), lambda x: F.lit(confidence), lambda x: F.to_json(F.struct(x["value"].alias(name))))

    use_flags = flags is not None and not again
    kind, domain = S.text(F.col("source_kind")), S.text(F.col("domain"))
    rows = with_haystacks(rows).withColumns({"__kind": form_label(), "__kind_json": F.to_json(F.struct(kind.alias("source_kind"))), "__form_json": F.to_json(F.struct(domain.alias("domain"), kind.alias("source_kind")))})
    form = F.col("__kind")
    forms = made(F.array(F.struct(form["label"].alias("label"))), "content_form", lambda x: F.when(form["confidence"] >= 0.95, "accepted").otherwise("proposed"), lambda x: form["confidence"], lambda x: F.col("__form_json"))
    made_all = F.concat(
        plain(_kept(source_label(F.col("source_kind"))), "source", "accepted", 1.0),
        plain(modality_labels(F.col(media_kind) if media_kind else None, again), "modality", "accepted", 0.95),
        forms,
        texts("topics", "topic", lambda x: F.concat(F.lit("topic."), S.slug(x)), 0.72, "topic_text"),
        texts("entities", "entity", lambda x: F.lit("entity.mentioned"), 0.7, "entity_text"),
        plain(quality_labels(quality_flags(F.col(flags)) if use_flags else None), "evidence_quality", "accepted", 0.9),
        plain(action_labels(challenged(F.col(flags)) if use_flags else None), "actionability", "proposed", 0.72),
    )
    raw = F.col("raw_json") if "raw_json" in rows.columns else F.lit("")
    return rows.select("event_id", "evidence_id", S.stable_hash(raw).alias("input_hash"), F.inline(made_all))


def annotation_ids(labels: DataFrame, producer: str = "semantic") -> DataFrame:
    """Labels with their deterministic ids: equal inputs give equal ids, so a repeated run adds nothing."""
    return labels.withColumns(
        {
            "annotation_id": S.short_id("ann", F.col("evidence_id"), F.col("family"), F.col("label_id"), F.col("value_json"), F.col("input_hash")),
            "activity_id": S.short_id("act", F.lit(producer), F.col("event_id"), F.col("evidence_id"), F.col("input_hash")),
        }
    )


def label_states(annotations: DataFrame) -> DataFrame:
    """``event_id, evidence_id, labels``: the state of a target's labels, in order, as one row of each labelled event."""
    one = F.struct("annotation_id", F.col("family").alias("annotation_family"), "label_id", "confidence", "status", F.lit(1).alias("taxonomy_version"), "value_json")
    order = F.array_position(F.array(*[F.lit(x) for x in FAMILIES]), F.col("family"))
    got = annotations.groupBy("event_id", "evidence_id").agg(F.array_sort(F.collect_set(F.struct(order.alias("o"), "position", one.alias("label")))).alias("l"))
    return got.select("event_id", "evidence_id", F.transform("l", lambda x: x["label"]).alias("labels"))


FAMILIES = ("source", "modality", "content_form", "topic", "entity", "evidence_quality", "actionability")

# ------------------------------------------------------------------ plans

#: Generator and its version, which enter all ids (fixed values).
GENERATOR, GENERATOR_VERSION = "deterministic_research_planner", "0.1.0"
#: Trigger label, in order of precedence -> what is made of it (fixed values of the data contract).
SIGNALS = (
    ("quality.user_supplied", "user_seed", "research_direction", "expand_user_seed", "What research direction should be opened from this user-supplied seed: {}?",
     "User-supplied evidence should be turned into explicit research directions before it disappears into the general corpus.", (0.82, 0.78, 0.55, 0.65, 0.72, 0.95), ("search_web", "search_x_recent", "open_seed_links", "summarize_findings")),
    ("action.compare", "comparison_opportunity", "comparison", "collect_comparison_evidence", "How does the system, claim, or benchmark in {} compare across primary and independent sources?",
     "The evidence carries comparison or benchmark signals and should be connected to competing systems, metrics, or claims.", (0.74, 0.72, 0.48, 0.55, 0.7, 0.35), ("search_benchmarks", "open_primary_sources", "extract_metrics", "compare_claims")),
    ("action.verify", "verification_needed", "verification", "verify_primary_sources", "What primary-source evidence verifies the release, availability, or documentation claims in {}?",
     "The evidence contains launch, release, model-card, or availability cues that should be verified against primary sources.", (0.68, 0.67, 0.5, 0.48, 0.62, 0.35), ("open_primary_sources", "search_release_posts", "check_docs_or_model_card")),
    ("action.collect_more", "source_expansion", "source_discovery", "collect_related_sources", "What additional primary sources, launch posts, docs, benchmarks, or discussions connect to {}?",
     "The evidence points outward through links, search results, or source references and can seed more collection.", (0.58, 0.6, 0.52, 0.42, 0.52, 0.35), ("open_seed_links", "search_web", "search_x_recent")),
)
SCORES = ("priority", "expected_value", "uncertainty", "novelty", "impact", "user_interest")
#: Strength of sources: of web pages, posts and profiles, of search results, of what users supply, of the rest.
STRENGTHS = (0.75, 0.45, 0.65, 0.55)


def planner_evidence(rows: DataFrame, order: tuple[str, ...] = ("ingested_at", "event_id")) -> DataFrame:
    """One row per evidence id: fields of its last row, topics and entities of all rows, each once and sorted."""
    last = F.max_by(F.struct("source_kind", "canonical_url", "title", F.substring("text", 1, 800).alias("text_preview")), F.struct(*order)).alias("r")
    lists = [F.sort_array(F.collect_set(c)).alias(c) for c in ("topic", "entity")]
    scalars = rows.groupBy("evidence_id").agg(last).select("evidence_id", "r.*")
    both = F.concat(
        F.transform(S.clean_list(F.col("topics")), lambda x: F.struct(x.alias("topic"), F.lit(None).cast("string").alias("entity"))),
        F.transform(S.clean_list(F.col("entities")), lambda x: F.struct(F.lit(None).cast("string").alias("topic"), x.alias("entity"))),
    )
    named = rows.select("evidence_id", F.inline(both)).distinct().groupBy("evidence_id").agg(*lists)
    empty = F.array().cast("array<string>")
    return scalars.join(named, "evidence_id", "left").withColumns({"topics": F.coalesce("topic", empty), "entities": F.coalesce("entity", empty)}).drop("topic", "entity")


def plan(rows: DataFrame, annotations: DataFrame, order: tuple[str, ...] = ("captured_at", "event_id")) -> DataFrame:
    """One row per evidence id that a signal is made of: the rule that holds, its texts, scores and ids.

    Labels of all the id's annotations count; the first rule whose label is among them holds. Topic is the first topic
    label, of several rows the least, else a slug of the topics, else uncategorized. Ids without annotations or without
    a trigger label give no row.
    """
    has = annotations.where(F.col("label_id") != "").groupBy("evidence_id").agg(
        F.sort_array(F.collect_set("label_id")).alias("labels"),
        F.sort_array(F.collect_set("annotation_id")).alias("annotation_ids"),
        F.min(F.when(F.col("family") == "topic", F.struct("position", "label_id"))).alias("first"),
    )
    e = planner_evidence(rows, order).join(has, "evidence_id")
    slugs = F.filter(F.transform("topics", lambda x: S.slug_letters(x, "_", "")), lambda x: x != "")
    rule = None
    for label, signal, question, task, ask, why, scores, actions in SIGNALS:
        made = F.struct(
            F.lit(signal).alias("signal_type"), F.lit(question).alias("question_type"), F.lit(task).alias("task_type"), F.lit(ask).alias("ask"), F.lit(why).alias("rationale"),
            *[F.lit(x).alias(n) for n, x in zip(SCORES, scores, strict=True)], F.array(*[F.lit(x) for x in actions]).alias("actions"),
        )
        has_label = F.array_contains("labels", label)
        rule = F.when(has_label, made) if rule is None else rule.when(has_label, made)
    entity = S.slug_letters(F.get("entities", F.lit(0)), "_", "")
    e = e.withColumns(
        {
            "rule": rule,
            "topic_label_id": F.coalesce("first.label_id", F.concat(F.lit("topic."), F.get(slugs, F.lit(0))), F.lit("topic.uncategorized")),
            "entity_id": F.when(F.coalesce(entity, F.lit("")) != "", F.concat(F.lit("entity."), entity)).otherwise(""),
        }
    ).where(F.col("rule").isNotNull())
    kind = F.col("source_kind")
    direct = F.array_contains("labels", "quality.direct_web_capture") | kind.isin("web_page", "x_post", "x_account")
    strength = F.when(direct, STRENGTHS[0]).when(kind == "search_result", STRENGTHS[1]).when(F.array_contains("labels", "quality.user_supplied"), STRENGTHS[2]).otherwise(STRENGTHS[3])
    shown = F.substring(S.first_text(F.col("title"), F.col("text_preview"), F.col("canonical_url"), F.col("evidence_id"), F.col("topic_label_id")), 1, 140)
    actions = F.when(kind == "search_result", F.concat(F.array(F.lit("open_search_result")), F.col("rule.actions"))).otherwise(F.col("rule.actions"))
    return e.select(
        "evidence_id", "canonical_url", "labels", "annotation_ids", "topic_label_id", "entity_id", "rule.*", strength.alias("source_strength"), actions.alias("suggested_actions"),
        F.replace(F.col("rule.ask"), F.lit("{}"), shown).alias("question_text"), F.concat_ws(":", F.lit(GENERATOR), F.lit(GENERATOR_VERSION), "rule.signal_type", "evidence_id").alias("dedupe_key"),
    ).drop("ask", "actions")


def signals(planned: DataFrame) -> DataFrame:
    key = F.col("dedupe_key")
    return planned.select(
        S.short_id("sig", key).alias("signal_id"), "signal_type", F.col("entity_id").alias("primary_entity_id"), "topic_label_id", F.array("evidence_id").alias("evidence_ids"), "annotation_ids", F.col("question_text").alias("signal_summary"), "rationale",
        F.col("novelty").alias("novelty_score"), F.col("uncertainty").alias("uncertainty_score"), F.col("impact").alias("impact_score"), F.col("source_strength").alias("source_strength_score"), F.col("user_interest").alias("user_interest_score"),
    )


def _seeds() -> Column:
    return F.filter(F.array("entity_id"), lambda x: x != "")


def questions(planned: DataFrame) -> DataFrame:
    key = F.col("dedupe_key")
    return planned.select(
        S.short_id("q", key).alias("question_id"), "question_text", "question_type", F.array(S.short_id("sig", key)).alias("trigger_signal_ids"), F.array("evidence_id").alias("seed_evidence_ids"), _seeds().alias("seed_entity_ids"), F.col("labels").alias("seed_label_ids"),
        "rationale", "priority", "expected_value", "uncertainty", F.lit("open").alias("status"), S.short_id("act", key).alias("generated_by_activity_id"), F.lit(GENERATOR).alias("generator_name"), F.lit(GENERATOR_VERSION).alias("generator_version"),
    )


def tasks(planned: DataFrame) -> DataFrame:
    key = F.col("dedupe_key")
    payload = F.to_json(F.struct(F.coalesce("canonical_url", F.lit("")).alias("canonical_url"), F.array("evidence_id").alias("seed_evidence_ids"), "suggested_actions", "topic_label_id"))
    budget = F.to_json(F.struct(F.lit(6).alias("max_collector_steps"), F.lit(20).alias("max_runtime_minutes")))
    return planned.select(
        S.short_id("task", key).alias("task_id"), S.short_id("q", key).alias("question_id"), "task_type", payload.alias("task_payload_json"), F.array("evidence_id").alias("seed_evidence_ids"), _seeds().alias("seed_entity_ids"), "priority", budget.alias("budget_json"),
        "dedupe_key", F.lit("open").alias("status"), "rationale",
    )


def only_new(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not stored yet."""
    return rows.join(existing.select(key).distinct(), key, "left_anti")
