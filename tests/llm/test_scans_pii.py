import pytest

from gleanery.llm import pii
from gleanery.llm import scans as S

GIVEN = frozenset("della jory isolde rocío begoña wynn".split())
FAMILY = frozenset("arneskoholt brazoarde eskalini sandlumann varnuström".split())


def found(text):
    return [(k, text[s:e]) for s, e, k in pii.find_pii(text, GIVEN, FAMILY)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to a.b+c@lab.site.example, please", [("email", "a.b+c@lab.site.example")]),
        ("mailto:x@y.test and j.doe [at] mail [dot] site [dot] invalid", [("email", "x@y.test"), ("email", "j.doe [at] mail [dot] site [dot] invalid")]),
        ("ab AT site DOT co DOT example; cd(at)site.test.", [("email", "ab AT site DOT co DOT example"), ("email", "cd(at)site.test")]),
        ("Use user@ as prefix; `model@1.4`; @handle_ops", []),
        ("jоry@site.test", [("email", "jоry@site.test")]),  # the o is Cyrillic
        ("call +44 (0)7700 900 722 or (415) 555-0198 or 555-0130", [("phone", "+44 (0)7700 900 722"), ("phone", "(415) 555-0198"), ("phone", "555-0130")]),
        ("Tel. 030 – 23125 091, tel:0034 400000959", [("phone", "030 – 23125 091"), ("phone", "0034 400000959")]),
        ("reach me: five five five zero one three zero nine", [("phone", "five five five zero one three zero nine")]),
        ("ISBN 979-0-3295-0797-0, doi 10.9986/lb.318.5689, 192.0.2.73, Seeds: 334 521 0441; run_id=67902123-53, Batch 402-34-12718", []),
        ("SSN#802381051, NI number QQ 46 86 08 C, passport no. X05543986", [("id_number", "802381051"), ("id_number", "QQ 46 86 08 C"), ("id_number", "X05543986")]),
        ("Personalausweis T22075147 et NIR 3 78 99 99 640 904 95; DNI 00575818M", [("id_number", "T22075147"), ("id_number", "3 78 99 99 640 904 95"), ("id_number", "00575818M")]),
        ("at Flat 11, 251 Mirmont Terrace and 270 bis, avenue Pryzel", [("address", "Flat 11, 251 Mirmont Terrace"), ("address", "270 bis, avenue Pryzel")]),
        ("C/ Zorbune, 63, Bitte an Kellith-Ostfara-Platz 31 senden", [("address", "C/ Zorbune, 63"), ("address", "Kellith-Ostfara-Platz 31")]),
        ("Table 40: Zorgard Drive is a disk", []),
        ("Dr. Della R. Arneskoholt, Brazoarde, Jory and Ms ESKALINI met the Velsol Harness team", [("name", "Della R. Arneskoholt"), ("name", "Brazoarde, Jory"), ("name", "ESKALINI")]),
        ("Isolde-Wynn\nSandlumann; J. von Brazoarde", [("name", "Isolde-Wynn\nSandlumann"), ("name", "J. von Brazoarde")]),
        ("Rocío Varnuström", [("name", "Rocío Varnuström")]),  # decomposed letters
        ("", []), ("   ", []), (None, []),
    ],
)
def test_found(text, want):
    assert ([] if text is None else found(text)) == want
    if text is None:
        assert pii.find_pii(None) == [] and pii.replace_pii(None, []) is None


def test_masking_keeps_the_rest():
    text = "x​ Tel. 030 23125 091 é a@b.test!"
    assert pii.replace_pii(text, pii.find_pii(text)) == "x​ Tel. [PHONE] é [EMAIL]!"


def test_offsets_survive_all_transducers():
    text = "ﬁ é x​y a [at] b [dot] test — 0171 555 0177"
    m = pii.normalise(text)
    at = m.text.index("a@b.test")
    assert text[m.source(at) :].startswith("a [at]") and text[m.source(m.text.index("0171")) :].startswith("0171")


def test_learning_and_tables(spark):
    docs = [(i, t) for i, t in enumerate(["Thanks to Della Arneskoholt for it.", "Emrys Arneskoholt wrote.", "Della Brazoarde and Emrys Brazoarde.", "Della-Oriel Brazoarde", "oriel BRAZOARDE called 555-0130", None, "", "Reach Della Arneskoholt", "the Road Map holds"])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, pii_type string")
    known = spark.createDataFrame([("Della",), (None,), ("",)], "name_part string")
    names = {(r.kind, r.name) for r in pii.learn_names(df, known).collect()}
    assert names == {("family", "arneskoholt"), ("family", "brazoarde"), ("given", "della"), ("given", "emrys"), ("given", "oriel")}
    rows = {(r.doc_id, r.pii_type, r.start_char) for r in pii.detect(df, known).collect()}
    assert rows == {(0, "name", 10), (1, "name", 0), (2, "name", 0), (2, "name", 20), (3, "name", 0), (4, "name", 0), (4, "phone", 23), (7, "name", 6)}
    assert {r.doc_id: r.text for r in pii.mask(df, known).collect()}[4] == "[NAME] called [PHONE]"
    assert pii.detect(df.where("false"), known).count() == 0


def test_learned_names_beyond_the_broadcast_bound_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Della Arneskoholt"), (1, "Della Arneskoholt"), (2, None), (3, "nobody")], "doc_id long, text string")
    known = spark.createDataFrame([("Della",)], "name_part string")
    want = sorted(pii.detect(df, known).collect())
    monkeypatch.setattr(pii, "BROADCAST_NAMES", 0)
    assert sorted(pii.detect(df, known).collect()) == want and len(want) == 2
    assert sorted(r.text or "" for r in pii.mask(df, known).collect()) == ["", "[NAME]", "[NAME]", "nobody"]


def test_page_edges():
    text = "28    THE TITLE OF IT\n\nbody of the pa-\nge goes on.\n\nSome Name, Vol. 4    l7"
    running, lines = S.split_page(text, 2, "The title of it", "First heading")
    assert running == [1, 6] and [n for n, _ in lines] == [3, 4]
    assert S.split_page("The title of it\n\nText.\nPage 1 of 9", 1, "The title of it", None)[0] == [4]
    assert S.split_page("First headinq\ntext.\n– xii –", 5, None, "First heading")[0] == [1, 3]
    assert S.split_page("2025   12   13 %", 3, "t", "h")[0] == [] and S.split_page(None, None, None, None) == ([], [])


def test_broken_words_and_glyphs():
    assert S.broken_word("a rer-", "anker ran") == ("rer", "anker") and S.broken_word("ToolRun-", "2 is") == ("ToolRun", "2")
    assert S.broken_word("open-", "and closed") is None and S.broken_word("work —", "the") is None and S.broken_word("x-", None) is None
    assert "hides" in S.glyph_candidates("hicles") and "work" in S.glyph_candidates("w0rk") and S.glyph_candidates("") == []
    assert S.skeleton("HARNES5EVAL w0rk") == S.skeleton("HarnessEval work")
    assert [bool(S._ODD_NUMBER.search(x)) for x in ("8O of 9", "64.l%", "2,S69", "16k", "1024k tokens", "in 2020.")] == [True, True, True, False, False, False]


@pytest.mark.parametrize("broadcast", [1_000_000, -1])
def test_scans_table(spark, monkeypatch, broadcast):
    monkeypatch.setattr(S, "BROADCAST_WORDS", broadcast)  # beyond the bound joins by word shuffle
    line = "the index was rebuilt after the team had found that most of its pages were stale and the queue was long"
    rows, results = [], []
    for i in range(40):
        body = [line, "we sampled the traces and kept what the planner had left behind in the memory store"]
        if i == 7:
            body[0] = body[0].replace("found", "f0und")
        if i == 8:
            body[1] = body[1].replace("planner", "plan-\nner")
        text = f"Report on scans\n\n" * (i == 0) + "\n".join(body) + f"\n\nPage {i + 1} of 40"
        rows.append((f"m{i:02}", "scan_page", text, None, "x"))
        results.append((f"m{i:02}", "scan", i + 1, "ok", 97.0, "y"))
    rows += [("z", "scan_page", None, None, None), ("v", "video", "f0und", None, None), ("m07", "scan_page", rows[7][2], None, None)]
    media = spark.createDataFrame(rows, "media_id string, media_kind string, ocr_text string, caption string, line_no string")
    ocr = spark.createDataFrame(results, "evidence_id string, source_artifact_id string, page_no long, status string, mean_confidence double, noise string")
    got = {(r.media_id, r.line_no, r.noise) for r in S.noise_lines(media, ocr).collect()}
    assert {x for x in got if x[2] != "running"} == {("m07", 1, "misread"), ("m08", 2, "hyphen")}
    assert len(got) == 42 and ("m00", 6, "running") in got
    text = " ".join(r.text for r in S.paragraphs(media, ocr).orderBy("scan", "paragraph_no").collect())
    assert "f0und" not in text and "plan-" not in text and "Page" not in text and text.count("planner") == 40
    assert S.noise_lines(media.where("false"), ocr).count() == 0


def test_corrections_hold_when_all_counts_grow(spark):
    row = lambda at, word: ("m", 0, at, word, False, None, None, None, None, 1.0, False, False, None)
    words = spark.createDataFrame([row(i, "wbere" if i == 15 else "where") for i in range(30)], S._WORDS)
    line = " ".join("wbere" if i == 15 else "where" for i in range(30))
    parts = spark.createDataFrame([("m", [0], [line], None, None, None, None)], "media_id string, numbers array<int>, lines array<string>, prev_last string, next_media string, next_no int, next_first string")
    assert [r.words for r in S.sentences(parts).collect()] == [line.split()]
    for times in (1, 10, 100):
        counts = spark.createDataFrame([("wbere", 4 * times), ("where", 120 * times), ("tbere", 4 * times), ("there", 40 * times)], "word string, n long")
        assert [(r.word, r.meant) for r in S.corrections(parts, words, counts).collect()] == [("wbere", "where")], times
    short = spark.createDataFrame([("rc", 2), ("re", 100), ("entscbeidungszusammenbangs", 2), ("entscheidungszusammenhangs", 100)], "word string, n long")
    assert {("rc", "re"), ("entscbeidungszusammenbangs", "entscheidungszusammenhangs")} <= {(r.word, r.meant) for r in S.link_words(short).collect()}


def test_hints_are_as_wide_as_the_patterns_they_guard():
    assert found("write to max at firma punkt example today") == [("email", "max at firma punkt example")]
    assert found("write to max at firma (punto) example today") == [("email", "max at firma (punto) example")]
    assert found("call five five five five zero zero zero now") == [("phone", "five five five five zero zero zero")]


def test_family_names_need_support(spark):
    texts = ["Della Zed wrote.", "Jory Zed wrote.", "Della O'Brien and Jory McDonald met.", "Della Wu left.", "Main Street, Oak Street, High Street, Elm Street; Della Street once."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([("Della", "en"), ("Jory", "en")], "name_part string, lang string")
    family = {r.name for r in pii.learn_names(docs, known).where("kind = 'family'").collect()}
    assert family == {"zed", "o'brien", "mcdonald", "wu"}  # two given names, or mostly behind them; not the street
    names = {(r.doc_id, texts[r.doc_id][r.start_char : r.end_char]) for r in pii.detect(docs, known).where("pii_type = 'name'").collect()}
    assert {(2, "Della O'Brien"), (2, "Jory McDonald"), (3, "Della Wu")} <= names and (4, "Della Street") not in names


def test_many_occurrences_take_time_in_proportion():
    import time

    def took(n):
        text = "mail a@b.test or " * n
        began = time.perf_counter()
        assert len(pii.find_pii(text)) == n
        return time.perf_counter() - began

    assert took(16_000) < 16 * took(2_000) + 1


def test_names_read_around_family_names_are_those_of_the_whole_text():
    import random

    dice = random.Random(2)
    bits = ["Della", "Jory", "Wynn", "Arneskoholt", "Brazoarde", "Varnuström", "von", "J.", "the", "plan", "of", "x" * 30, ",", "-", "\n", "Dr.", "ß", "O’Hara", "word " * 40]
    for _ in range(400):
        text = "".join(dice.choice(bits) + dice.choice([" ", " ", "  ", ""]) for _ in range(dice.randint(1, 60)))
        lower = text.casefold()
        words = set(pii._LETTERS.findall(lower))
        assert pii.names_in(text, lower, words, GIVEN, FAMILY) == (pii.find_names(text, GIVEN, FAMILY) if words & FAMILY else []), text
    long = "Della " * 100 + "Arneskoholt and more " + "z " * 500
    assert pii.names_in(long, long.casefold(), {"arneskoholt"}, GIVEN, FAMILY) == pii.find_names(long, GIVEN, FAMILY) == [(0, 600 + len("Arneskoholt"))]
