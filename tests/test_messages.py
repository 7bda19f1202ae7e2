import datetime as dt

from gleanery.operators.messages import keep_one_delivery, repeated_messages

T = dt.datetime
SCHEMA = "event_id string, evidence_id string, ingested_at timestamp_ntz, text string, rn int, __kept string"


def test_earliest_delivery_wins_and_ties_are_settled(spark):
    rows = [
        ("a", "1", T(2025, 1, 2), "late", 1, "x"),
        ("a", "1", T(2025, 1, 1), "first", 2, "y"),
        ("b", "1", T(2025, 1, 1), "same", 3, None),
        ("b", "1", T(2025, 1, 1), "same", 3, None),
        ("c", "1", None, "no time", 4, None),
        ("c", "1", T(2025, 1, 9), "timed", 5, None),
        (None, "1", None, None, None, None),
        (None, "1", None, None, None, None),
    ]
    out = keep_one_delivery(spark.createDataFrame(rows, SCHEMA), deliveries="n").collect()
    got = {r.event_id: r for r in out}
    assert len(out) == 4 and out[0].asDict().keys() >= {"rn", "__kept"}
    assert got["a"].text == "first" and got["a"].n == 2
    assert got["b"].text == "same" and got["c"].text == "timed" and got[None].n == 2


def test_result_does_not_depend_on_order(spark):
    rows = [("k", "1", T(2025, 1, 1), t, i, None) for i, t in enumerate("dcba")]
    a = keep_one_delivery(spark.createDataFrame(rows, SCHEMA)).collect()
    b = keep_one_delivery(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    assert a == b


def test_empty_table(spark):
    assert keep_one_delivery(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_folds_before_the_shuffle(spark):
    df = keep_one_delivery(spark.createDataFrame([("a", "1", T(2025, 1, 1), "t", 1, None)], SCHEMA).repartition(4))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min_by") == 1


def test_repeated_messages_come_from_the_kept_rows(spark):
    rows = [("a", "1", T(2025, 1, 2), "late", 1, "x"), ("a", "1", T(2025, 1, 1), "first", 2, None), ("b", "1", None, None, None, None), ("c", None, None, None, None, None), ("c", None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = repeated_messages(df)
    assert {(r.event_id, r.evidence_id) for r in found.collect()} == {("a", "1"), ("c", None)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "text" in plan  # the whole row takes part
    assert repeated_messages(df.where("false")).count() == 0
    assert repeated_messages(df.select("event_id", "evidence_id", "ingested_at")).count() == 2
