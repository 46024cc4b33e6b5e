"""Nested records: parsing in several notations, shapes, positions, latest rows."""

from __future__ import annotations

import json
from datetime import datetime

from tessera.operators import nested as N

ACTIONS = [
    {"role": "dm", "messages": [{"role": "assistant", "content": [{"type": "text", "text": "a"}, None, "bare", {"type": "tool_use", "id": "t", "name": "roll", "input": {"n": 1}}]}, None, {"role": "tool", "content": {"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "in"}]}}]},
    {"role": "player", "messages": {"role": "assistant", "content": "lone"}},
    {"role": "player"},
]
META = {"generation_metrics": [{"stage": "x", "latency_s": 1.5, "usage": {"input_tokens": 3, "output_tokens": 4}, "retries": [{"attempt": 0, "reason": "rate"}]}, None, {"stage": "y", "usage": None}]}
SCHEMA = "episode_id long, saved_at timestamp, actions string, metadata string, path string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def listed(spark, rows):
    return sorted((r.child, r.episode_id, r.path) for r in N.listed_children(N.flatten_episodes(frame(spark, rows))).collect())


WANT = [("metric", 1, "0"), ("metric", 1, "2"), ("text", 1, "0.0.0"), ("text", 1, "0.0.2"), ("text", 1, "1.0.0"), ("tool_result", 1, "0.2.0"), ("tool_use", 1, "0.0.3")]


def test_notations(spark):
    for a, m in ((json.dumps(ACTIONS), json.dumps(META)), (repr(ACTIONS), repr(META)), (json.dumps(json.dumps(ACTIONS)), json.dumps(json.dumps(META))), (json.dumps({"actions": ACTIONS}), json.dumps(META))):
        assert listed(spark, [(1, datetime(2024, 1, 1), a, m)]) == WANT


def test_broken_null_and_empty(spark):
    rows = [(1, datetime(2024, 1, 1), json.dumps(ACTIONS)[:-5], json.dumps(META)), (2, None, None, None), (3, None, "", ""), (4, None, "null", "[]"), (5, None, '"just words"', "{}"), (6, None, "[" * 3000, None)]
    assert listed(spark, rows) == [("metric", 1, "0"), ("metric", 1, "2")]
    assert listed(spark, []) == []


def test_latest_row_counts_once(spark):
    old, new = json.dumps(ACTIONS), json.dumps([{"role": "dm", "messages": [{"content": "z"}]}])
    rows = [(1, datetime(2024, 1, 1), old, None), (1, datetime(2024, 1, 2), new, None), (1, datetime(2024, 1, 2), new, None), (1, None, old, None)]
    assert listed(spark, rows) == [("text", 1, "0.0.0")]


def test_typed_tables_keep_links(spark):
    t = N.typed_tables(N.flatten_episodes(frame(spark, [(1, None, json.dumps(ACTIONS), json.dumps(META))])))
    use = t["block_tool_use"].first()
    assert (use.name, use.parent, use.position, json.loads(use.input)) == ("roll", "0.0", 3, {"n": 1})
    parents = {r.path for r in t["message"].collect()}
    assert all(r.parent in parents for name in t if name.startswith("block") for r in t[name].collect())
    m = {r.path: r for r in t["metric"].collect()}
    assert (m["0"].input_tokens, m["0"].latency_s, m["2"].total_tokens) == (3, 1.5, None)
    assert [(r.parent, r.attempt, r.reason) for r in t["retry"].collect()] == [("0", 0, "rate")]
    assert [(r.parent, r.text) for r in t["result"].collect()] == [("0.2.0", "in")]


def test_states():
    a = N.AUTOMATON
    assert a.state({"type": "text", "text": "x"}) == "text"
    assert a.state({"type": "new", "x": 1}) == "other:new"
    assert a.state({"role": "u", "content": []}) == "message"
    assert a.state({"x": 1}) == "object" and a.state([]) == "[]" and a.state(True) == "bool" and a.state([[1], None, "x"]) == "[list|str]"
    assert N.shape(a.run({"b": 1, "a": [1, "x"]})) == "{a:[num|str],b:num}"


def test_states_pass_through_arrays():
    a = N.AUTOMATON
    block = {"type": "text", "text": "x"}
    assert a.state({"role": "u", "content": [block, "bare", {"type": "tool_result", "content": [block]}]}) == "message"
    assert a.state({"role": "u", "content": [5, None]}) == "object"
    assert a.state({"type": "tool_result", "content": [block, 5]}) == "other:tool_result"
    good, bad = {"role": "dm", "messages": [{"role": "u", "content": [block]}]}, {"role": "dm", "messages": [{"role": "u", "content": [5]}]}
    assert a.state(good) == "action" and a.state(bad) == "object"
    deep = None
    for _ in range(5000):
        deep = [deep]
    assert a.state(deep) == "[list]"


def test_rows_are_routed_by_state_not_by_tag(spark):
    odd = {"type": "text", "nope": {"a": 1}}
    t = N.typed_tables(N.flatten_episodes(frame(spark, [(1, None, json.dumps([{"role": "dm", "messages": [{"role": "u", "content": [odd, {"type": "text", "text": "t"}, {"type": "image", "url": "u"}]}]}]), None)])))
    assert [(r.path, r.text) for r in t["block_text"].collect()] == [("0.0.1", "t")]
    assert sorted((r.path, r.variant) for r in t["block_other"].collect()) == [("0.0.0", "other:text"), ("0.0.2", "other:image")]
    assert listed(spark, [(1, None, json.dumps([{"messages": [{"content": [odd]}]}]), None)]) == [("text", 1, "0.0.0")]


def test_very_long_text(spark):
    big = json.dumps([{"role": "dm", "messages": [{"content": "x" * 2_000_000}]}])
    assert listed(spark, [(1, None, big, None)]) == [("text", 1, "0.0.0")]
