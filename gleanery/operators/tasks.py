"""Work made from evidence: embedding tasks, media routing, research chunks, lookup keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import scalars as S
from gleanery.operators import documents

#: Vector of a source kind, and how much text a model gets (fixed values).
VECTOR_OF = {"x_account": "account_dense", "media": "ocr_dense"}
MOST_CHARS = 4000


def embedding_tasks(evidence: DataFrame) -> DataFrame:
    """``point_id, evidence_id, vector_name, text``: what to embed; media give text and caption if they differ."""
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in VECTOR_OF.items() for x in kv]), F.col("source_kind")), F.lit("text_dense"))
    body = S.truncate(S.text(F.col("text")), MOST_CHARS)
    caption = S.truncate(S.text(F.col("title")), MOST_CHARS)
    tasks = F.array(
        F.struct(name.alias("vector_name"), body.alias("text")),
        F.struct(F.lit("caption_dense").alias("vector_name"), F.when((F.col("source_kind") == "media") & (caption != body), caption).otherwise(F.lit("")).alias("text")),
    )
    rows = evidence.select("evidence_id", F.inline(F.filter(tasks, lambda t: t["text"] != "")))
    return rows.select(S.uuid_from(F.col("evidence_id")).alias("point_id"), "evidence_id", "vector_name", "text").distinct()


def route_media(media: DataFrame, done: DataFrame, newest: int = 100) -> DataFrame:
    """The newest media whose content no finished run has, as requests to the three lanes."""
    latest = media.groupBy("media_id").agg(F.max_by(F.struct("sha256", "media_kind", "captured_at"), F.struct("captured_at", "observation_id")).alias("m")).select("media_id", "m.*")
    open_ = latest.join(done.where("status = 'ok'").select(F.col("source_sha256").alias("sha256")).distinct(), "sha256", "left_anti")
    top = open_.orderBy(F.desc("captured_at"), F.asc("media_id")).limit(newest)
    return top.select("media_id", "sha256", F.explode(F.array(F.lit("ocr"), F.lit("vl"), F.lit("embed"))).alias("lane"))


def research_chunks(docs: DataFrame, key: str, text: str, project: str) -> DataFrame:
    """Chunks of documents as user inputs with deterministic ids."""
    made = documents.chunk_documents(docs, key, text)
    ident = F.format_string(f"research-doc-{project}-%s-chunk-%04d", F.substring(S.stable_hash(F.col(key), F.lit(project)), 1, 20), F.col("chunk_no"))
    return made.select(key, "chunk_no", ident.alias("input_id"), "n_chars")
