from pyspark.sql import functions as F

from gleanery.sources import table
from gleanery.streaming import pipeline


def test_stream_equals_batch(spark, sf, tmp_path):
    records = table(spark, sf, "capture_events").select("topic_name", "kafka_partition", "kafka_offset", "kafka_key", "received_at", "raw_value")
    records.repartition(3).write.parquet(str(tmp_path / "spool"))
    out = str(tmp_path / "out")
    q = pipeline.start(spark, str(tmp_path / "spool"), out, str(tmp_path / "check"))
    q.awaitTermination(120)
    made = pipeline.process(records)
    for name in ("observed", "evidence", "errors"):
        got = spark.read.parquet(f"{out}/{name}").drop("batch")
        want = made[name].select(got.columns)
        assert got.count() == want.count() > 0
        assert got.exceptAll(want).count() == 0
    state = pipeline.Snapshots(spark, f"{out}/state").read()
    assert state.count() == made["evidence"].select("evidence_id").distinct().count()


def test_restart_adds_nothing(spark, sf, tmp_path):
    table(spark, sf, "capture_events").select("topic_name", "kafka_partition", "kafka_offset", "kafka_key", "received_at", "raw_value").limit(20).write.parquet(str(tmp_path / "spool"))
    for _ in range(2):
        pipeline.start(spark, str(tmp_path / "spool"), str(tmp_path / "out"), str(tmp_path / "check"), dedupe="1 day").awaitTermination(120)
    n = spark.read.parquet(str(tmp_path / "out/observed"))
    assert n.select("batch").distinct().count() == 1 and n.where(F.col("event_id").isNotNull()).count() == n.count()
