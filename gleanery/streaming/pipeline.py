"""The incremental run: capture records to observed events, evidence, labels, state and error envelopes.

Every micro-batch goes through the same functions as a batch run. Delivery is at least once: a batch writes under its
number, repeats overwrite what they wrote, and messages seen before are dropped on request within a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.operators import ingest, labels
from gleanery.sources import readers
from gleanery.sources.sinks import Snapshots

EVIDENCE = ("event_id", "evidence_id", "source_kind", "canonical_url", "author_handle", "domain", "title", "text", "topics", "entities", "links", "captured_at")


def evidence_of(observed: DataFrame) -> DataFrame:
    """Observed events in the fact table's shape."""
    media = F.col("source_kind") == "media"
    return observed.select(
        *EVIDENCE,
        (media | (F.coalesce(F.size("media_ids"), F.lit(0)) > 0)).cast("int").alias("has_media"),
        (media & (F.col("text") != "")).cast("int").alias("has_ocr"),
        F.coalesce("quality", "capture_quality").alias("quality"),
        F.coalesce("media_kind", F.lit("")).alias("media_kind"),
    )


def process(batch: DataFrame) -> dict[str, DataFrame]:
    """All outputs of a set of records: observed, evidence (captures' own rows included), annotations, collector runs,
    media requests, planned signals and error envelopes."""
    checked = ingest.validate(ingest.parse(batch))
    valid = checked.where(F.col("error").isNull())
    return {"errors": ingest.dead_letters(checked), **_made(valid, ingest.project_all(valid))}


def _made(valid: DataFrame, observed: DataFrame) -> dict[str, DataFrame]:
    roots = ingest.root_rows(valid).withColumnRenamed("capture_quality", "quality").withColumn("media_kind", F.lit(""))
    evidence = evidence_of(observed)
    evidence = evidence.unionByName(roots.select(evidence.columns))
    return {"observed": observed, "media_requests": ingest.media_requests(observed), "collector_runs": ingest.collector_runs(valid), **_labelled(evidence)}


def _labelled(evidence: DataFrame) -> dict[str, DataFrame]:
    annotations = labels.annotation_ids(labels.annotate(evidence, flags="quality", media_kind="media_kind"))
    return {"evidence": evidence, "annotations": annotations, "signals": labels.signals(labels.plan(evidence, annotations))}


def write_batch(spark: SparkSession, out: str):
    """The ``foreachBatch`` function: outputs under the batch's number, latest evidence as a snapshot.

    Every output is read from what was written before it: records are parsed and projected once a batch.
    """

    def run(batch: DataFrame, number: int) -> None:
        def written(name: str, df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
            return spark.read.schema(df.schema).parquet(f"{out}/{name}/batch={number}")

        batch = batch.persist()
        try:
            checked = ingest.validate(ingest.parse(batch))
            written("errors", ingest.dead_letters(checked))
            valid = checked.where(F.col("error").isNull())
            observed = written("observed", ingest.project_all(valid))
            made = _made(valid, observed)
            for name in ("media_requests", "collector_runs"):
                written(name, made[name])
            evidence = written("evidence", made["evidence"])
            for name in ("annotations", "signals"):
                written(name, _labelled(evidence)[name])
            Snapshots(spark, f"{out}/state").put(number, evidence, ["evidence_id"], ["captured_at", "event_id"])
        finally:
            batch.unpersist()

    return run


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True, dedupe: str | None = None) -> StreamingQuery:
    """Starts the run over a spool folder; ``once`` stops after what is there. ``dedupe`` is a watermark such as
    ``1 day``: records of one key delivered again within it are dropped.

    An output folder belongs to one checkpoint: a fresh checkpoint would count batches from 0 and overwrite what is
    there, so it is refused (ValueError).
    """
    fs = Snapshots(spark, out)
    if fs.has("observed") and not fs.has("offsets", checkpoint):
        raise ValueError(f"{out} was written by another run: give its checkpoint or another folder")
    records = readers.stream_records(spark, folder)
    if dedupe:
        at = records.withColumn("at", F.col("received_at").cast("timestamp"))
        records = at.withWatermark("at", dedupe).dropDuplicatesWithinWatermark(["raw_value"]).drop("at")
    w = records.writeStream.foreachBatch(write_batch(spark, out)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="60 seconds")).start()


def windowed_activity(stream: DataFrame, ts: str, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Tumbling counts of a stream, late records admitted within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("bucket"), "n")
