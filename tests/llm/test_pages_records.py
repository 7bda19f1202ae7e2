import datetime as dt

import pytest

from gleanery.llm import boilerplate as B
from gleanery.llm import survivors as V

PAGE = """Skip to content
Home | Topics | Docs | Sign in
We and our 12 partners use cookies to remember you. Got it  Reject
Home > News > How the index was rebuilt
How the index was rebuilt
By Ann Bee · 3 min read
Share on: Chirp · Mail · 12
The index was rebuilt after the team had found that half of its pages were older than a year.

Method
See also: Another story of the day
- First point, 12%
Model A 1.2 | Suite | 12.3% | 9
It is not clear why the numbers of the second run are so far from those of the first one.
You may also like
Inside the new crawler
Why the old one failed
© 2025 Site Media. All rights reserved.
Comments are closed."""


def test_main_body():
    good = [n for n, x in B.classify(PAGE, "How the index was rebuilt – Site", "www.site.test") if x == "good"]
    assert good == [5, 6, 8, 10, 12, 13, 14]
    untitled = [n for n, x in B.classify(PAGE, None, None) if x == "good"]
    assert untitled == good
    assert B.main_body(None, "t", "d") is None and B.main_body(" \n", None, None) == "" and B.classify("", None, None) == []
    assert all(B.main_body(x, "T", "s.test") == "" for x in ("404 – the page you asked for is gone.", "Checking your browser before you continue…"))
    assert B.main_body("Access denied. Your request was blocked (ref 1).", "T", "s.test") == ""


def test_densities_and_brand():
    assert B.link_density("Home | Topics | Docs") == 1.0 and B.link_density("A sentence of words without any") == 0.0
    assert B.stop_density("it is of the") == 1.0 and B.stop_density("") == 0.0
    assert B.brand_of("blog.quo-bbb.example") == "quo" and B.brand_of(None) == "" and B.title_of("A title here - Quo", "quo") == "A title here"


def test_long_page_keeps_every_paragraph():
    text = "\n".join(["Title line of it"] + ["This is one of the many sentences that are in the body of a page."] * 20_000)
    assert len(B.main_body(text, "Title line of it", None)) == len(text)


def test_page_table(spark):
    rows = [("e", "1", PAGE, None, "site.test", "web_page"), ("e", "1", PAGE, None, "site.test", "web_page"), ("e", "2", None, None, None, "web_page"), (None, None, "", "", "", "web_page")]
    df = spark.createDataFrame(rows, "event_id string, evidence_id string, text string, title string, domain string, source_kind string")
    lines = B.boilerplate_lines(df).collect()
    assert len(lines) == 11 and {r.evidence_id for r in lines} == {"1"} and 9 not in {r.line_no for r in lines}
    assert B.extract_main(df).count() == 4 and B.boilerplate_lines(df.where("false")).count() == 0


BODY = "The first paragraph says é what was found. It has two sentences.\n\nThe second one says why it matters to all of the readers."


@pytest.mark.parametrize(
    ("text", "fault"),
    [
        (BODY, None), (BODY.replace("\n\n", "\n"), None), (None, "empty"), (" \n", "empty"), ("n/a", "junk"), (BODY.encode().decode("latin1"), "misread"), (BODY.replace("é", "�"), "misread"),
        (BODY.replace("é", "caf?s l?on"), "replaced"), ("<p>" + BODY + "</p>", "markup"), (BODY + "\n" + BODY, "repeated"), (BODY[:90] + " Read more", "cut"), (BODY[:80], "open end"), ("Home | Help | Docs\n" + BODY, "foreign"),
        ("404 – the page you asked for is gone.", "junk"), (BODY + " Set `max_steps` first.", None), (BODY + " naïve façade…", None), (BODY[:100] + "…", "cut"),
    ],
)
def test_faults_of_bodies(text, fault):
    faults = V.body_faults(text)
    assert (fault in faults) if fault else not faults
    assert V.body_trust(text) == 100 or fault


def exhaustive(candidates):
    """The greatest trust of any consistent choice, by trying all."""
    import itertools

    best = -1.0
    names = list(candidates)
    for combo in itertools.product(*[[None, *candidates[n]] for n in names]):
        c = {n: x for n, x in zip(names, combo) if x}
        if any(x[1].startswith("!") for x in c.values()):
            continue
        if len({x[1].split("|")[-1] for n, x in c.items() if n != "times"} - {""}) > 1:
            continue
        best = max(best, sum(x[0] for x in c.values()))
    return best


def test_branch_and_bound_is_exact():
    import random

    random.seed(5)
    changed = 0
    for _ in range(300):
        c = {n: [(float(random.randint(0, 9)), random.choice(["", "s", "t", "!"] if n != "body" else ["|", "|s", "cut|t"]), i) for i in range(random.randint(1, 4))] for n in ("body", "address", "label", "times")}
        got = V.choose_bundles(c)
        assert got.keys() == c.keys()
        held = {n: next(x for x in c[n] if x[2] == rec) for n, rec in got.items()}
        consistent = not any(x[1].startswith("!") for x in held.values()) and len({x[1].split("|")[-1] for n, x in held.items() if n != "times"} - {""}) <= 1
        if consistent:
            assert sum(x[0] for x in held.values()) == exhaustive(c)
        changed += any(held[n][0] < max(x[0] for x in c[n]) for n in c)
    assert V.choose_bundles({}) == {} and changed > 50  # the constraints decide, not the single maxima


RECORDS = "record_id long, evidence_id string, source_kind string, canonical_url string, domain string, title string, text_best string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, trust string"
T = lambda day: dt.datetime(2025, 1, day)


def test_survivors(spark):
    url = "https://site.test/a"
    rows = [
        (1, "e", "web_page", url, "site.test", "Title", BODY, T(1), T(3), "x"),
        (2, "e", "web_page", url + "?ref=feed", "site.test", "Title - Site", BODY.replace("\n\n", "\n"), T(2), T(9), "x"),
        (3, "e", "web_page", None, None, None, BODY.split("\n\n")[0], T(3), T(12), "x"),
        (4, "e", "web_page", "::bad", "", "Untitled", "<b>" + BODY + BODY + "</b>", None, None, "x"),
        (5, "f", "web_page", url, "site.test", "T", None, T(4), T(2), "x"),
        (6, None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    got = {r.evidence_id: r for r in V.choose_survivors(df).collect()}
    assert got["e"].body_record == 2 and got["e"].address_record == 1 and got["e"].label_record == 1 and got["e"].records == 4
    assert got["f"].body_record == 5 and got[None].records == 1
    assert [r.evidence_id for r in V.choose_survivors(df, least=2).collect()] == ["e"]
    built = {r.evidence_id: r for r in V.build_survivors(df).collect()}
    assert built["e"].title == "Title" and built["e"].canonical_url == url and built["e"].sources.times_record == 3 and (built["e"].first_seen_at, built["e"].last_seen_at) == (T(3), T(12)) and len(built) == 3
    assert V.choose_survivors(df.where("false")).count() == 0


def test_bundles_are_whole_and_consistent(spark):
    a, b = "https://site.test/a", "https://other.test/a?x=1"
    rows = [
        (1, "e", "web_page", b, "other.test", "A title of it", BODY, T(1), T(3), "x"),  # the whole body, of the other site
        (2, "e", "web_page", a, "site.test", "A title of it - Site", BODY.split("\n\n")[0], T(2), T(9), "x"),  # a better address, half the body
        (3, "e", "web_page", "https://third.test/", "site.test", None, None, T(9), T(1), "x"),  # host and domain differ, times out of order
        (4, "g", "web_page", "https://third.test/", "site.test", None, None, T(9), T(1), "x"),
    ]
    got = {r.evidence_id: r for r in V.build_survivors(spark.createDataFrame(rows, RECORDS)).collect()}
    e = got["e"]
    assert (e.text_best, e.canonical_url, e.domain) == (BODY, b, "other.test") and e.title == "A title of it"
    assert (e.sources.body_record, e.sources.address_record, e.sources.times_record) == (1, 1, 2) and (e.first_seen_at, e.last_seen_at) == (T(2), T(9))
    g = got["g"]  # nothing consistent: the record's own
    assert (g.canonical_url, g.first_seen_at, g.last_seen_at) == ("https://third.test/", T(9), T(1))


def test_short_blocks_inherit_from_the_nearest_decided_neighbour():
    g, b, s, h = B.GOOD, B.BAD, B.SHORT, B.HEAD
    assert B.inherit([g, s, s, s, b], set())[1:4] == [g, b, b]  # a tie goes to the one ahead
    assert B.inherit([b, s, g], set()) == [b, g, g] and B.inherit([b, s, s, s, g], set())[1] == b  # too far from its text
    assert B.inherit([g, s, s, g], set()) == [g] * 4 and B.inherit([h, s, s, g], set()) == [b, b, b, g]
    assert B.inherit([g, b, s, g], {1}) == [g, b, g, g] and B.inherit([s, s], set()) == [b, b] and B.inherit([], set()) == []


def test_runs_of_short_blocks_take_time_in_proportion():
    import time

    def took(n):
        text = "A title of it\n" + "\n".join(f"short block {i}" for i in range(n)) + "\nIt is the end of what the page says about it and of all the rest."
        began = time.perf_counter()
        assert len(B.classify(text, "A title of it", None)) == n + 2
        return time.perf_counter() - began

    took(2_000)
    assert took(32_000) < 8 * took(8_000) + 1
