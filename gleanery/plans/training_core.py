"""Queries of the core (general) data problems: p4 and p6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import messages, nested
from gleanery.sources import table


def _bridge(spark: SparkSession, d: str, bodies: bool = True) -> DataFrame:
    return nested.occurrences(table(spark, d, "capture_events"), bodies=bodies)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per occurrence: deliveries whose object at a place has another identity tell the same occurrence."""
    return nested.places(table(spark, d, "capture_events")).where(F.size("versions") > 0).select("event_id", "parent_path", "child_path")


def p4_bridge(spark: SparkSession, d: str) -> DataFrame:
    return _bridge(spark, d, bodies=False).drop("body")


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.objects(_bridge(spark, d))


def _flat(field: str, top_level: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return nested.flat_table(_bridge(spark, d), field, top_level)

    return run


#: One flat table for each kind of object, those of the four arrays first.
P4_TABLES = {f"p4_{k}": _flat(k, True) for k in nested.PLACES} | {f"p4_{'attached_media' if k == 'media' else k}": _flat(k) for k in nested.FLAT_FIELDS if k == "media" or k not in nested.PLACES}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return messages.repeated_messages(table(spark, d, "evidence_events"))


def p6_messages(spark: SparkSession, d: str) -> DataFrame:
    return messages.keep_one_delivery(table(spark, d, "evidence_events"))


QUERIES = {f.__name__: f for f in (p4_found, p4_bridge, p4_objects, p6_found, p6_messages)} | P4_TABLES

ORACLES = {
    "p6_found": """
        SELECT event_id, evidence_id FROM evidence_events GROUP BY event_id, evidence_id HAVING count(*) > 1
    """,
}
