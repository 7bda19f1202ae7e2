"""All core queries and their SQL, by name."""

from __future__ import annotations

from gleanery.plans import enrichment_plans, ingest_plans, read_models, reference, reference_more, training_core  # noqa: F401 - the modules register their queries

QUERIES = {**reference.QUERIES, **training_core.QUERIES}
ORACLES = {**reference.ORACLES, **training_core.ORACLES}
