import json

from gleanery.operators import nested


def brute(record):
    """Paths of array-element objects by plain recursion."""
    out = []

    def walk(v, path, parent):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{path}/{k}", parent)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                here = f"{path}/{i}"
                if isinstance(x, dict):
                    out.append((parent, here))
                    walk(x, here, here)
                else:
                    walk(x, here, parent)

    for place in nested.PLACES:
        a = nested.find_place(record, place)
        if a is not None:
            walk(a, place, "")
    return sorted(out)


RECORD = {
    "collector_run_id": "r", "event_index": "3",
    "posts": [None, {"post_id": 1, "replies": [{"post_id": 2}, {"post_id": 2}], "author": {"badges": [{"kind": "x"}]}}],
    "media": {"media_id": "m", "a/b": [{"c": [[{"d": 1}]]}]},
    "web_documents": json.dumps([{"title": "t"}]),
    "search_results": [], "context": {"results": [{"url": "u"}]},
}


def test_rows_equal_plain_recursion():
    rows = nested.flatten_record(RECORD)
    assert sorted((r[2], r[3]) for r in rows) == brute(RECORD)
    assert ("posts/1", "posts/1/replies/1") in brute(RECORD) and ("", "web_documents/0") in brute(RECORD) and ("", "search_results/0") in brute(RECORD)


def test_equal_objects_share_an_identity_whatever_the_key_order():
    a = nested.flatten_record({"collector_run_id": "r", "event_index": 1, "posts": [{"a": 1, "b": [{"x": None}]}, {"b": [{"x": None}], "a": 1}, {"a": 2}]})
    ids = {r[3]: r[7] for r in a}
    assert ids["posts/0"] == ids["posts/1"] != ids["posts/2"]
    assert json.loads(next(r[9] for r in a if r[3] == "posts/0"))["b"][0]["$ref"] == ids["posts/0/b/0"]


def test_records_without_identity_or_shape_give_none():
    assert nested.flatten_record({"event_index": 1, "posts": [{"a": 1}]}) == []
    assert nested.flatten_record({"collector_run_id": " ", "event_index": 1, "posts": [{"a": 1}]}) == []
    assert nested.flatten_record({"collector_run_id": "r", "event_index": 1, "posts": ["x", None, 3], "media": "no json"}) == []
    assert nested.record_id({"collector_run_id": "r", "event_index": True}) is None
    assert nested.record_id({"collector_run_id": "r", "event_index": 2.0}) == "r:2"


def test_decoding():
    assert nested.decode('"\\"{}\\""') == {} and nested.decode("\ufeff{}") == {} and nested.decode('{"a": NaN}') is None and nested.decode(None) is None


def test_very_deep_record():
    deep = {"v": 1}
    for _ in range(3000):
        deep = {"replies": [deep]}
    assert len(nested.flatten_record({"collector_run_id": "r", "event_index": 1, "posts": [deep]})) == 3001


def test_table(spark):
    text = json.dumps(RECORD)
    rows = [(text,), (text,), ("﻿" + text,), (json.dumps(text),), ("{broken",), (None,), ("null",), ("[]",), ("",)]
    df = spark.createDataFrame([(r[0], "x") for r in rows], "raw_value string, event_id string")
    b = nested.occurrences(df)
    assert b.count() == len(brute(RECORD))
    objects = nested.objects(b)
    assert objects.count() == b.select("object_id").distinct().count() and objects.agg({"n_occurrences": "sum"}).first()[0] == b.count()
    posts = nested.flat_table(b, "posts", top_level=True).collect()
    assert [p.post_id for p in posts] == ["1"] and json.loads(posts[0].rest).keys() == {"replies", "author"}
    replies = nested.flat_table(b, "replies").collect()
    assert {(p.child_path, p.parent_path, p.post_id, p.rest) for p in replies} == {("posts/1/replies/0", "posts/1", "2", None), ("posts/1/replies/1", "posts/1", "2", None)}
    assert len({p.object_id for p in replies}) == 1 and {p.parent_object_id for p in replies} == {posts[0].object_id}
    assert [p.kind for p in nested.flat_table(b, "badges").collect()] == ["x"]
    unknown = nested.flat_table(b, "c").collect()
    assert [json.loads(p.rest) for p in unknown] == [{"d": 1}]
    assert nested.occurrences(df.where("false")).count() == 0


def test_records_deeper_than_the_parser_recurses():
    n = 20_000
    text = '{"collector_run_id":"r","event_index":1,"posts":' + "[" * n + '{"a":[{"b":"\\u00e9 \\"x"}]}' + "]" * n + "}"
    rows = nested.flatten_record(nested.decode(text))
    assert len(rows) == 2 and rows[1][2] == rows[0][3] and rows[1][3].endswith("/a/0")
    objects = 5_000
    chain = '{"posts":[' * objects + "{}" + "]}" * objects
    assert len(nested.flatten_record(nested.decode('{"collector_run_id":"r","event_index":1,"posts":[' + chain + "]}"))) == objects + 1
    assert nested.decode("[" * 100_000) is None and nested.decode("[" * 100_000 + "}") is None


def test_the_iterative_parser_agrees_with_the_usual_one():
    for text in ("{}", "[]", ' {"a" : [1, -2.5e3, "x\\n", null, true, {"b": []}]} ', '"s"', "0", "01", "[1,]", "{,}", '{"a"}', '{"a":}', "[1 2]", "", "nul", '{"a":1}}', "[NaN]", "-"):
        try:
            want = json.loads(text, parse_constant=nested._refuse)
        except ValueError:
            want = ValueError
        try:
            got = nested.parse_deep(text)
        except ValueError:
            got = ValueError
        assert got == want, text


def test_versions_of_one_place(spark):
    one = {"collector_run_id": "r", "event_index": 1, "posts": [{"a": 1}]}
    rows = [(json.dumps(one),), (json.dumps(one),), (json.dumps({**one, "posts": [{"a": 2}]}),)]
    df = spark.createDataFrame(rows, "raw_value string")
    assert nested.occurrences(df).count() == 2
    assert [len(r.versions) for r in nested.places(df).collect()] == [2]
