"""Loading of the named parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "evidence_events", "evidence_latest", "media_observed", "media_ocr_results", "capture_events",
    "ops_canary_runs", "size_limits", "known_names",
)


def table_names() -> tuple[str, ...]:
    return _NAMES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table, file or directory; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
