"""The ingest steps as named processors over tables, to be chained by configuration, with counters of what they saw."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleanery.operators import ingest

Processor = Callable[[DataFrame], DataFrame]


def _valid(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNull())


#: Processors by name; each takes and gives a table.
REGISTRY: dict[str, Processor] = {
    "capture_parse": ingest.parse,
    "capture_validate": ingest.validate,
    "valid_only": _valid,
    "source_kind_router": ingest.source_kinds,
    "observed_event_projector": ingest.project_all,
    "observed_shadow_envelope": ingest.shadow_envelope,
    "media_request_builder": ingest.media_requests,
    "media_shadow_envelope": ingest.media_shadow_envelope,
    "dlq_error_enricher": ingest.dead_letters,
}


def register(name: str, processor: Processor) -> None:
    """Adds a processor; a name that is taken is an error."""
    if name in REGISTRY:
        raise ValueError(f"{name} is taken")
    REGISTRY[name] = processor


def run(df: DataFrame, names: Sequence[str], counted: bool = False) -> tuple[DataFrame, dict[str, Observation]]:
    """The table after the named processors, and a counter of rows behind each (filled by the first action on it)."""
    counters: dict[str, Observation] = {}
    for i, name in enumerate(names):
        if name not in REGISTRY:
            raise ValueError(f"no processor {name}")
        df = df.transform(REGISTRY[name])
        if counted:
            counters[name] = Observation(f"{i}_{name}")
            df = df.observe(counters[name], F.count(F.lit(1)).alias("rows"))
    return df, counters


def with_meta(df: DataFrame, **values: Column | str) -> DataFrame:
    """Metadata of messages as columns: an expression, or the name of the column it is copied from."""
    return df.withColumns({k: F.col(v) if isinstance(v, str) else v for k, v in values.items()})


def keyed_order(df: DataFrame, key: str, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Messages of one key in one partition, in order: what a topic promises its readers."""
    spread = df.repartition(partitions, key) if partitions else df.repartition(key)
    return spread.sortWithinPartitions(key, *order)
