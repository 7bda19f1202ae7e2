"""Queries of the llm problems and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import boilerplate, packing, pii, repeated_lines, scans, splitting, survivors, tokens
from gleanery.sources import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    chosen = survivors.choose_survivors(table(spark, d, "evidence_latest"), least=2)
    return chosen.select(F.col("body_record").alias("record_id"))


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.build_survivors(table(spark, d, "evidence_latest"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise_lines(table(spark, d, "media_observed"), table(spark, d, "media_ocr_results"))


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(table(spark, d, "media_observed"), table(spark, d, "media_ocr_results"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence_events").where(F.col("source_kind") == "web_page")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.boilerplate_lines(_pages(spark, d))


def p3_main_body(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.extract_main(_pages(spark, d)).select("event_id", "evidence_id", "body").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.covered_lines(_pages(spark, d)).withColumnRenamed("source", "domain")


def p5_sequences(spark: SparkSession, d: str) -> DataFrame:
    found = repeated_lines.prefixspan(_pages(spark, d))
    return found.select("length", F.col("source").alias("domain"), F.array_join("sequence", "\n").alias("line_texts"), "support", "documents")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).select("event_id", "evidence_id", "domain", "text")
    return repeated_lines.remove_repeated(pages, repeated_lines.covered_lines(pages)).select("event_id", "evidence_id", "clean_text").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    split = splitting.split_items(table(spark, d, "evidence_events"), table(spark, d, "size_limits"))
    return split.where(F.col("n_pieces") > 1).select("event_id", "evidence_id").distinct()


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    split = splitting.split_items(table(spark, d, "evidence_events"), table(spark, d, "size_limits"))
    rows = split.select("event_id", "evidence_id", "source_kind", "n_pieces", F.posexplode("pieces").alias("piece_no", "p"))
    return rows.select("event_id", "evidence_id", "source_kind", "n_pieces", "piece_no", F.col("p.start").alias("start_char"), F.col("p.piece").alias("piece")).distinct()


def p7_canary_chunks(spark: SparkSession, d: str) -> DataFrame:
    return splitting.judge_runs(table(spark, d, "ops_canary_runs"), table(spark, d, "evidence_events"), table(spark, d, "size_limits"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents").select("doc_id", "text"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.count_tokens(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"))
    caps = table(spark, d, "size_limits").where(F.col("unit") == "tokens").select("limit_name", F.col("max_size").alias("capacity"))
    return packing.fill_containers(sizes, caps).withColumnRenamed("item_id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.detect(table(spark, d, "documents"), table(spark, d, "known_names"))
    return found.select("doc_id", "pii_type", "start_char")


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.mask(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "known_names"))


QUERIES = {f.__name__: f for f in (p1_found, p1_survivors, p2_found, p2_paragraphs, p3_found, p3_main_body, p5_found, p5_sequences, p5_clean, p7_found, p7_pieces, p7_canary_chunks, p8_ids, p9_containers, p10_found, p10_masked)}

ORACLES = {
    "p5_found": r"""
        WITH pages AS (SELECT domain, evidence_id, text FROM evidence_events WHERE source_kind = 'web_page' AND domain IS NOT NULL),
        lines AS (
            SELECT domain, evidence_id, regexp_replace(trim(regexp_replace(lower(l), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), '[0-9]+', '0', 'g') AS line_text
            FROM (SELECT domain, evidence_id, unnest(string_split(text, chr(10))) AS l FROM pages)
        ),
        n AS (SELECT domain, count(DISTINCT evidence_id) AS n FROM pages GROUP BY domain)
        SELECT domain, line_text FROM lines JOIN n USING (domain) WHERE line_text <> ''
        GROUP BY domain, line_text, n HAVING count(DISTINCT evidence_id) >= 5 AND count(DISTINCT evidence_id) * 100 >= n * 20
    """,
    "p7_found": """
        SELECT DISTINCT e.event_id, e.evidence_id FROM evidence_events e
        JOIN size_limits l ON l.source_kind = e.source_kind AND l.unit = 'chars' WHERE length(e.text) > l.max_size
    """,
}
