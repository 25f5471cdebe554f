"""Tool calls: linking, order, validation, canonical JSON."""

import json

import pytest

from gridspark.llm import chat

CALLS = "conv_id bigint, call_id string, place bigint, tool string, arguments string, after array<string>, linked string"


@pytest.fixture(scope="module")
def run(spark):
    def make(calls, results):
        calls = spark.createDataFrame([(*c, "x") for c in calls], CALLS)
        results = spark.createDataFrame(results, "call_id string, content string")
        schemas = spark.createDataFrame([
            ("f", "n", "integer", True, 1.0, 9.0, None), ("f", "s", "string", False, None, None, ["a", "b"]),
            ("f", "o", "object", False, None, None, None)], chat.SCHEMA_COLUMNS)
        return {(r.conv_id, r.call_id, r.tool): r for r in chat.link_tool_calls(calls, results, schemas).collect()}

    return make


def test_order_links_and_errors(run):
    rows = run([
        (1, "a", 9, "f", '{"n": 3}', None), (1, "b", 1, "f", '{"s":"c","n":0}', ["a"]), (1, "c", 2, "f", '{"n":"x","z":1}', ["b", "a", "gone"]),
        (1, "d", 0, "g", "{}", []), (2, "e", 0, "f", "no json", None), (2, "h", 1, "f", None, ["i"]), (2, "i", 2, "f", "[1]", ["h"]),
        (2, "j", 3, "f", '{"n": 2, "o": {"b": 1, "a": [2, {"d": 1, "c": null}]}}', ["i"]), (None, "k", 0, None, '{"n":1.5}', None),
    ], [("a", "two"), ("a", "one"), ("c", None), ("nobody", "x")])
    by = {k[1]: r for k, r in rows.items()}
    assert {k: (r.depth, r.position) for k, r in by.items()} == {
        "d": (0, 1), "a": (0, 2), "b": (1, 3), "c": (2, 4), "e": (0, 1), "h": (None, 2), "i": (None, 3), "j": (None, 4), "k": (0, None)}
    assert {k: r.errors for k, r in by.items()} == {
        "a": "", "b": "n: too small; s: not a choice", "c": "n: not integer; z: unknown", "d": "tool: unknown", "e": "arguments: no object",
        "h": "arguments: no object", "i": "arguments: no object", "j": "", "k": "tool: unknown"}
    assert {k for k, r in by.items() if r.linked} == {"a", "c"}
    assert by["a"].message == '{"after":[],"arguments":{"n":3},"id":"a","result":"one","tool":"f"}'
    assert json.loads(by["j"].message)["arguments"]["o"] == {"b": 1, "a": [2, {"d": 1, "c": None}]}
    assert '"o":{"a":[2,{"c":null,"d":1}],"b":1}' in by["j"].message
    assert all(r.valid == (r.errors == "") for r in by.values())


def test_repeated_ids_and_empty_tables(run):
    rows = run([(1, "a", 0, "f", '{"n":1}', None), (1, "a", 1, "g", '{"n":1}', None), (1, None, 2, "f", '{"n":1}', None)], [])
    assert rows[1, "a", "f"].errors == "id: repeated" and rows[1, "a", "g"].errors == "id: repeated; tool: unknown"
    assert not rows[1, None, "f"].linked
    assert run([], []) == {}
