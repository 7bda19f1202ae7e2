import pytest

from gleanery.llm import repeated_lines as R
from gleanery.llm import splitting as P


def pieces(spark, text, size, lap):
    df = spark.createDataFrame([(text, size, lap)], "t string, m int, o int")
    return df.select(P.split_pieces(df.t, df.m, df.o).alias("p")).first()["p"]


@pytest.mark.parametrize("text", ["", "short", "word " * 100, "x" * 503, "para one is here.\n\npara two.\n\n" * 12, "Ä🙂漢é" * 60, "a\r\nb\r\n" * 80, "\n" * 150])
@pytest.mark.parametrize(("size", "lap"), [(50, 0), (50, 10), (20, 19), (20, 40), (1, 0)])
def test_pieces_tile_the_text(spark, text, size, lap):
    got = pieces(spark, text, size, lap)
    lap = min(lap, size - 1)
    assert all(len(p.piece) <= size for p in got)
    joined = got[0].piece
    for before, p in zip(got, got[1:]):
        assert p.start == max(0, p.core_start - lap) and p.core_start == len(joined)
        assert p.piece[: p.core_start - p.start] == joined[p.start : p.core_start]
        joined += p.piece[p.core_start - p.start :]
    assert joined == text


def test_boundaries_by_strength(spark):
    text = "First sentence here. Second one, longer.\n\nNext paragraph follows with words. End."
    assert pieces(spark, text, 60, 0)[0].piece.endswith("\n\n")
    assert pieces(spark, text, 30, 0)[0].piece == "First sentence here. "
    assert pieces(spark, "abcdefghij klmnopqrst", 15, 0)[0].piece == "abcdefghij "
    assert pieces(spark, None, 10, 1) is None and pieces(spark, "abc", None, 1) is None


def test_items_and_runs(spark):
    items = spark.createDataFrame([("a", "1", "k", "x" * 25, "n"), ("a", "1", "k", "x" * 25, "n"), ("b", "2", "k", None, "n"), ("c", "3", "other", "y" * 99, "n"), (None, None, None, "", "n")], "event_id string, evidence_id string, source_kind string, text string, n_pieces string")
    limits = spark.createDataFrame([("l", "k", "chars", 10, 2), ("t", None, "tokens", 5, 0)], "limit_name string, source_kind string, unit string, max_size int, overlap_size int")
    rows = {r.event_id: r for r in P.split_items(items, limits).distinct().collect()}
    assert rows["a"].n_pieces == 3 == rows["a"].least and rows["b"].n_pieces == 0 and rows["c"].n_pieces == 1 and rows[None].n_pieces == 1
    runs = spark.createDataFrame([("r1", "ok", 3, ["1"]), ("r2", "ok", 9, ["1"]), ("r3", "ok", None, ["1"]), ("r4", "ok", 1, ["nowhere"])], "run_id string, status string, expected_chunks long, evidence_ids array<string>")
    assert {r.run_id: r.verdict for r in P.judge_runs(runs, items, limits).collect()} == {"r1": "agrees", "r2": "differs", "r3": "missing", "r4": "unknown"}
    assert P.split_items(items.where("false"), limits).count() == 0


PAGES = "domain string, evidence_id string, text string, source string, document string"


def brute(rows, least, percent):
    """Frequent single lines by counting everything."""
    norm = lambda line: " ".join(__import__("re").sub("[0-9]+", "0", " ".join(line.lower().split())).split())
    docs, single = {}, {}
    for domain, doc, text, *_ in rows:
        if domain is None:
            continue
        docs.setdefault(domain, set()).add(doc)
        for line in set(filter(None, map(norm, (text or "").split("\n")))):
            single.setdefault((domain, line), set()).add(doc)
    return {x: len(s) for x, s in single.items() if len(s) >= least and len(s) * 100 >= percent * len(docs[x[0]])}


@pytest.mark.parametrize("broadcast", [500_000, -1])
def test_lines_and_their_removal_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(R, "BROADCAST_LINES", broadcast)  # beyond the bound sides are joined by salt
    rows = []
    for i in range(30):
        body = f"unique text {'abcdefghij'[i % 10]}{'klm'[i // 10]}"
        rows.append(("a.test", f"d{i}", f"Share  this\n{body}\n\n© {2000 + i} All\nHome\nHelp" if i % 3 else f"{body}\nHome", "s", None))
    rows += [("b.test", "x", "Home\nHelp", None, None), (None, "y", "Home", None, None), ("a.test", "d1", "Share this\nagain", None, None), ("a.test", "n", None, None, None), ("a.test", "e", " \n\t", None, None), ("a.test", None, "Home", None, None)]
    df = spark.createDataFrame(rows, PAGES)
    want = brute(rows, 5, 20)
    got = R.prefixspan(df, least=5, percent=20).collect()
    assert {(r.source, r.sequence[0]): r.support for r in got if r.length == 1} == want
    assert ("a.test", ("© 0 all", "home", "help")) in {(r.source, tuple(r.sequence)) for r in got}
    covered = R.covered_lines(df)
    assert sorted((r.source, r.line_text) for r in covered.collect()) == sorted(want)
    clean = R.remove_repeated(df, covered)
    assert clean.columns == [*df.columns, "clean_text"] and clean.count() == len(rows)
    by = {(r.domain, r.evidence_id): r for r in clean.collect()}
    assert by["a.test", "d2"].clean_text.strip() == "unique text ck" and by["b.test", "x"].clean_text == "Home\nHelp" and by[None, "y"].clean_text == "Home" and by["a.test", "n"].clean_text is None
    assert R.prefixspan(df.where("false")).count() == 0 == R.covered_lines(df.where("false")).count()


def brute_gapped(rows, least, percent):
    """Frequent sequences with anything in between by counting all subsequences of short texts."""
    docs, seen = {}, {}
    for domain, doc, text, *_ in rows:
        if domain is None:
            continue
        docs.setdefault(domain, set()).add(doc)
        lines = [x for x in (text or "").split("\n") if x]
        for pick in range(1, 1 << len(lines)):
            seen.setdefault((domain, tuple(x for i, x in enumerate(lines) if pick >> i & 1)), set()).add(doc)
    return {x: len(s) for x, s in seen.items() if len(s) >= least and len(s) * 100 >= percent * len(docs[x[0]])}


def test_prefixspan_equals_all_subsequences_with_gaps_and_long_ones(spark):
    import random

    dice = random.Random(5)
    rows = [("a.test", f"d{i}", "\n".join(x for x in "abcdefgh" if dice.random() < 0.8), "s", None) for i in range(20)]
    rows += [("b.test", f"d{i % 9}", "\n".join(dice.choices("xyz", k=6)), None, None) for i in range(25)]
    rows += [("c.test", f"d{i}", "home\nhelp" if i < 5 else "help\nhome", None, None) for i in range(26)]
    rows += [(None, "y", "a\nb", None, None), ("a.test", "n", None, None, None), ("a.test", "d1", "h\ng\nh", None, None)]
    df = spark.createDataFrame(rows, PAGES)
    got = R.prefixspan(df, least=5, percent=20).collect()
    want = brute_gapped(rows, 5, 20)
    assert {(r.source, tuple(r.sequence)): r.support for r in got} == want and len(got) == len(want)
    assert max(r.length for r in got) > 4 and all(r.length == len(r.sequence) for r in got)
    assert ("a.test", ("a", "c", "h")) in want and R.prefixspan(df.where("false")).count() == 0


def test_closed_growth_contains_every_frequent_sequence():
    import random

    def within(a, b):
        it = iter(b)
        return all(x in it for x in a)

    dice = random.Random(3)
    for _ in range(150):
        docs = [([[x for x in range(6) if dice.random() < 0.7] if dice.random() < 0.5 else dice.choices(range(5), k=dice.randint(0, 7)) for _ in range(dice.choice([1, 1, 2]))], dice.choice([1, 1, 3])) for _ in range(dice.randint(1, 9))]
        docs = [(t, w) for t, w in docs if any(t)]
        everything, closed = dict(R.grow(docs, 2)), dict(R.grow(docs, 2, closed=True))
        assert all(everything[x] == n for x, n in closed.items())
        for x, n in everything.items():
            assert any(m == n and within(x, y) for y, m in closed.items()), (docs, x)


def test_lines_on_all_pages_give_one_closed_sequence_not_a_power_set():
    docs = [([list(range(40))], 100)]
    assert [len(x) for x, _ in R.grow(docs, 50, closed=True)] == list(range(1, 41))


def test_very_long_texts_take_time_in_proportion(spark):
    import time

    def took(n):
        df = spark.createDataFrame([("Some words of a sentence. " * (n // 26), 3600, 200)], "t string, m int, o int")
        began = time.perf_counter()
        got = df.select(P.split_pieces(df.t, df.m, df.o).alias("p")).selectExpr("size(p)", "p[size(p) - 1].start").first()
        assert got[0] > n // 3600 and got[1] < n
        return time.perf_counter() - began

    took(100_000)
    small, large = took(500_000), took(4_000_000)
    assert large < 24 * small + 2
