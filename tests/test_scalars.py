import hashlib

import pytest
from pyspark.sql import functions as F

from gleanery.functions import scalars as S


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("r")).first()["r"]


def test_stable_hash_and_ids(spark):
    want = hashlib.sha256(b"run\x003\x00n\xc3\xa9\x00").hexdigest()
    assert one(spark, S.stable_hash(F.lit("run"), F.lit(3), F.lit("né"))) == want
    assert one(spark, S.short_id("ann", F.lit("run"), F.lit(3), F.lit("né"))) == f"ann_{want[:24]}"
    assert one(spark, S.uuid_from(F.lit("run"), F.lit(3), F.lit("né"))).replace("-", "") == want[:32]


@pytest.mark.parametrize(("text", "want"), [(" Code Agents! ", "code_agents"), ("--A--b", "a_b"), ("", ""), ("Ü", "")])
def test_slug(spark, text, want):
    assert one(spark, S.slug(F.lit(text))) == want


def test_trim_takes_all_white_space(spark):
    assert one(spark, S.ws_trim(F.lit("\t a b\n "))) == "a b"
    assert one(spark, S.first_text(F.lit(" \n"), F.lit(None).cast("string"), F.lit(" x "))) == "x"


def test_hosts_and_status(spark):
    assert one(spark, S.host(F.lit("https://WWW.Example.test:8080/a?b"))) == "example.test"
    assert one(spark, S.host(F.lit("not a url"))) == ""
    assert one(spark, S.status_handle(F.lit("https://x.com/Ann_B/status/123?s=1"))) == "ann_b"
    assert one(spark, S.status_id(F.lit("https://example.test/"))) == ""
    assert [one(spark, S.capture_kind(F.lit(u))) for u in ("", "https://foox.com/", "https://www.google.de/search", "https://a.test/")] == ["capture", "x_page", "google_search_page", "web_page"]


def test_times(spark):
    now = F.lit("2025-01-01T00:00:00Z")
    assert one(spark, S.time_text(F.lit("2025-03-02T10:00:00+02:00"), now)) == "2025-03-02T08:00:00Z"
    assert one(spark, S.time_text(F.lit("2025-03-02T10:00:00.250Z"), now)) == "2025-03-02T10:00:00.25Z"
    assert one(spark, S.time_text(F.lit("2025-03-02"), now)) == "2025-03-02T00:00:00Z"
    assert one(spark, S.time_text(F.lit("soon"), now)) == "soon" and one(spark, S.time_text(F.lit(""), now)) == "2025-01-01T00:00:00Z"
    assert [one(spark, S.date_precision(F.lit(x))) for x in ("2025", "2025-01", "2025-01-02", "2025-01-02T03:04", "")] == ["year", "month", "day", "datetime", "unknown"]


def test_lists_flags_and_numbers(spark):
    c = F.array(F.lit(" a "), F.lit(""), F.lit(None).cast("string"), F.lit("b"), F.lit("a"))
    assert one(spark, S.clean_list(c)) == ["a", "b"] and one(spark, S.clean_list(F.lit(None).cast("array<string>"))) == []
    assert [one(spark, S.percent(F.lit(a), F.lit(b))) for a, b in ((1, 0), (1, 3), (5, 2), (1, 40))] == [0, 33, 100, 2]
    assert S.tristate("Yes") is True and S.tristate("off") is False and S.tristate("maybe") is None
    assert one(spark, S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, S.mime_of(F.lit("a/b.JPG?x=1"))) == "image/jpeg" and one(spark, S.mime_of(F.lit(None).cast("string"))) == "image/png"


def test_claims_and_json(spark):
    r = one(spark, S.claim_parts(F.lit("Model A: 12 points: best")))
    assert (r.subject, r.value, r.scoped) == ("Model A", "12 points: best", True)
    r = one(spark, S.claim_parts(F.lit("Model A is fast")))
    assert (r.subject, r.value) == ("Model A", "fast")
    assert one(spark, S.claim_parts(F.lit("plain"))).scoped is False
    assert one(spark, S.canonical_json(F.lit('{"b":1, "a":[2]}'))) == '{"a":[2],"b":1}' and one(spark, S.canonical_json(F.lit("{"))) is None


def test_text_helpers(spark):
    assert one(spark, S.paragraphs(F.lit("a\n\n b \n \n\nc"))) == ["a", "b", "c"]
    assert one(spark, S.markdown_title(F.lit("x\n## Head line \ny"))) == "Head line"
    assert one(spark, S.clean_space(F.lit("a \r\n\n\n\n b\tc "))) == "a\n\nb c"
    assert one(spark, S.letters_upper(F.lit("ab-1 é"))) == "AB1É"
