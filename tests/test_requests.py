"""Request contract: every violation is reported, the one-image rule only on otherwise good rows."""

import json

import pytest

from groundwire.sources.requests import has_image, parse_requests, read_requests

CASES = [
    ({"query": "What is our PPE policy?"}, []),
    ({}, ["query: missing"]),
    ({"query": ""}, ["query: too short"]),
    ({"query": "   "}, []),
    ({"query": "x" * 8000}, []),
    ({"query": "x" * 8001}, ["query: too long"]),
    ({"query": 5}, ["query: not a string"]),
    ({"query": None}, ["query: not a string"]),
    ({"query": "q", "session_id": None}, []),
    ({"query": "q", "session_id": "s" * 129}, ["session_id: too long"]),
    ({"query": "", "session_id": 7}, ["query: too short", "session_id: not a string"]),
    ({"query": "q", "image": {"bucket": "b", "key": "k.png"}}, []),
    ({"query": "q", "image": {"bucket": "b"}}, ["image.key: missing"]),
    ({"query": "q", "image": "b/k"}, ["image: not an object"]),
    ({"query": "q", "image_format": "bmp"}, ["image_format: not allowed"]),
    ({"query": "q", "image_format": "webp"}, []),
    ({"query": "q", "metadata": {"a": "1"}}, []),
    ({"query": "q", "metadata": {"a": 1}}, ["metadata: value not a string"]),
    ({"query": "q", "metadata": None}, ["metadata: not an object"]),
    ({"query": "look", "image_url": "https://example.com/a.png", "image_base64": "aaaa"},
     ["more than one image source"]),
    ({"query": "", "image_url": "u", "image_base64": "b"}, ["query: too short"]),
    ({"query": "q", "image_url": "", "image_base64": "b"}, []),
    ({"query": "q", "unknown": 1}, []),
    ([1, 2], ["body: not an object"]),
]


def reasons(spark, bodies):
    rows = [(n, b) for n, b in enumerate(bodies)]
    parsed = parse_requests(spark.createDataFrame(rows, "n int, body string"))
    return [r.reasons for r in parsed.orderBy("n").collect()]


def test_the_last_of_duplicate_keys_counts(spark):
    bodies = ['{"query":5,"query":"last","x":1,"x":2}', '{"query":"first","query":5}', '{"query":"q","metadata":{"a":1,"a":"b"}}']
    assert reasons(spark, bodies) == [[], ["query: not a string"], []]


def test_every_case(spark):
    got = reasons(spark, [json.dumps(c) for c, _ in CASES])
    assert got == [expected for _, expected in CASES]


def test_bad_json_and_empty_body(spark):
    bodies = ["{bad", '{"query":"a"} trailing', '{"query":"a"}{"query":"b"}', "", None, "{'query': 'a'}"]
    bad = ["body: not valid JSON"]
    assert reasons(spark, bodies) == [bad, bad, bad, ["query: missing"], ["query: missing"], bad]


def test_read_splits_files(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"query":"hi","image":{"bucket":"b","key":"k"}}\n{"query":""}\nnonsense\n')
    valid, rejected = read_requests(spark, str(tmp_path))
    row = valid.collect()
    assert [(r.query, r.image.bucket, r.image.key) for r in row] == [("hi", "b", "k")]
    assert sorted(r.reasons[0] for r in rejected.collect()) == ["body: not valid JSON", "query: too short"]


@pytest.mark.parametrize("field,value,expected", [
    ("image_url", "https://example.com/h.jpg", True), ("image_url", "", False), ("image_base64", "aaaa", True),
])
def test_has_image(spark, field, value, expected):
    df = spark.createDataFrame([("q", value)], f"query string, {field} string")
    assert df.select(has_image(df).alias("v")).first().v is expected
