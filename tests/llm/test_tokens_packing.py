import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import packing, tokens

tiktoken = pytest.importorskip("tiktoken")
RANKS = tokens.load_ranks(tokens.tokenizer_path())
ENC = tokens.Encoder(RANKS)
PLAIN = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def naive(data: bytes) -> list[int]:
    """Lowest rank first by looking at all pairs each time."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        best = min(((RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS), default=None)
        if best is None:
            return [RANKS[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_public_library(text):
    assert ENC.encode(text) == PLAIN.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_merge_equals_brute_force(data):
    assert ENC.merge(data) == naive(data)


def test_long_pre_tokens_and_special_strings():
    random.seed(2)
    for w in ("a" * 30_000, "".join(random.choice("abcdeéü漢🙂") for _ in range(20_000))):
        assert ENC.encode(w) == PLAIN.encode_ordinary(w)
    assert ENC.encode("<|endoftext|>") == PLAIN.encode_ordinary("<|endoftext|>") and 50256 not in ENC.encode("<|endoftext|>")
    assert ENC.encode(None) == [] and ENC.encode("") == []


def test_rank_queue_gives_ranks_in_order():
    q = tokens.RankQueue(300_000)
    want = sorted(random.sample(range(300_000), 500))
    for r in random.sample(want, len(want)):
        q.push(r, 9)
        q.push(r, 3)
    got = []
    while (x := q.pop()) is not None:
        got.append(x)
    assert [r for r, _ in got] == want and all(p == [3, 9] for _, p in got)


def test_table(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, "x"), (3, "", "y"), (4, "  \n", "z")], "doc_id long, text string, other string")
    rows = {r.doc_id: r for r in tokens.encode_texts(df).collect()}
    assert rows[1].ids == PLAIN.encode_ordinary("a b") and rows[2].ids == [] == rows[3].ids and rows[2].other == "x"
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}[4] == len(PLAIN.encode_ordinary("  \n"))
    assert tokens.encode_texts(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        tokens.encode_texts(df, result="other")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_packing_keeps_capacity_and_all_items(sizes):
    at = packing.pack(sizes, 100)
    fill = {}
    for s, b in zip(sizes, at):
        fill[b] = fill.get(b, 0) + s
    assert len(at) == len(sizes) and all(v <= 100 for v in fill.values())
    assert sorted(fill) == list(range(len(fill)))


def test_local_search_empties_a_container():
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]  # best fit takes three containers for what two hold
    plain = packing.pack(sizes, 90, tries=0)
    assert max(packing.pack(sizes, 90)) + 1 == 2 <= max(plain) + 1


def test_containers(spark):
    items = spark.createDataFrame([(1, 25), (2, None), (3, 10), (4, 4), (4, 4), (5, 6), (6, 0)], "item_id long, n_tokens int")
    caps = spark.createDataFrame([("c10", 10), ("c20", 20), ("zero", 0)], "limit_name string, capacity int")
    rows = packing.fill_containers(items, caps, block_items=3).collect()
    for cap in (10, 20):
        mine = [r for r in rows if r.capacity == cap]
        assert sum(r.n_tokens for r in mine) == 49 and {r.item_id for r in mine} == {1, 2, 3, 4, 5, 6}
        fill = {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert max(fill.values()) <= cap
        assert sorted(r.start_token for r in mine if r.item_id == 1) == list(range(0, 25, cap))
        assert all(r.part_no == 0 for r in mine if r.item_id != 1) and len([r for r in mine if r.item_id == 4]) == 2
    assert packing.fill_containers(items.where("false"), caps).count() == 0 and packing.fill_containers(items, caps.where("false")).count() == 0


def test_tails_of_all_blocks_are_searched_together(spark):
    import random

    dice = random.Random(1)
    sizes = [dice.randint(1, 60) for _ in range(3000)]
    items = spark.createDataFrame([(7 if i % 3 else None, n) for i, n in enumerate(sizes)], "item_id long, n_tokens int")  # few ids, many rows
    caps = spark.createDataFrame([("c", 100)], "limit_name string, capacity int")
    rows = packing.fill_containers(items, caps, block_items=100).collect()
    fill = {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert sorted(r.n_tokens for r in rows) == sorted(sizes) and max(fill.values()) <= 100
    apart = sum(max(packing.pack(sizes[i::30], 100)) + 1 for i in range(30))  # 30 blocks without the second search
    assert len(fill) - -(-sum(sizes) // 100) <= 6 < apart - -(-sum(sizes) // 100)


def test_more_capacities_than_one_call_takes_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_LIMITS", 3)
    items = spark.createDataFrame([(1, 5)], "item_id long, n_tokens int")
    caps = lambda n: spark.createDataFrame([(f"c{i}", 10 + i) for i in range(n)], "limit_name string, capacity int")
    assert packing.fill_containers(items, caps(3)).count() == 3
    with pytest.raises(ValueError):
        packing.fill_containers(items, caps(4))
