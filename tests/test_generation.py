"""Generation with offline clients: tools, retries, limits, episodes, tasks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import code
from tessera.generation import client as G
from tessera.generation import episodes as E
from tessera.generation import tasks as K
from tessera.generation.tools import calculate, describe, run_tool


def test_tools():
    a = run_tool("roll_dice", {"notation": "3d6+2"}, 7)
    assert a == run_tool("roll_dice", {"notation": "3d6+2"}, 7) and not a["is_error"]
    r = json.loads(a["content"])
    assert r["total"] == sum(r["rolls"]) + 2 and all(1 <= x <= 6 for x in r["rolls"])
    assert run_tool("roll_dice", {"notation": "six"})["is_error"] and run_tool("none", {})["is_error"] and run_tool("speak", "not json")["is_error"]
    assert run_tool("speak", {"character": "A", "message": "Hi", "tone": "low"})["content"] == 'A says (low): "Hi"'
    assert json.loads(run_tool("convert_units", {"amount": 2, "from_unit": "feet", "to_unit": "inches"})["content"])["amount"] == 24
    assert calculate("2 + 3 * (4 - 1) ** 2") == 29
    for bad in ("__import__('os')", "9 ** 9 ** 9", "a + 1"):
        with pytest.raises((ValueError, SyntaxError)):
            calculate(bad)
    assert describe("f", "does", {"a": "int", "b": "str"}, "types", ["b", "a"]) == "f(b, a) - does"


def test_retries_and_limits():
    class Broken:
        def complete(self, messages, args):
            raise RuntimeError("down")

    waits = []
    r = G.generate(Broken(), [{"role": "user", "content": "x"}], G.DEFAULTS, sleep=waits.append)
    assert r["finish_reason"] == "error" and waits == [1, 2]
    assert G.Args(seed=5).over(G.DEFAULTS).seed == 5 and G.Args().over(G.DEFAULTS) == G.DEFAULTS
    now = [0.0]
    b = G.TokenBucket(100, estimate=100, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        b.settle(b.take(), 100)
    assert now[0] == pytest.approx(2.0)
    assert G.parallel_calls(1000, 500) == 2 and G.parallel_calls(10, 500) == 1


def test_tool_loop_ends():
    args = G.Args(tools=("roll_dice",), max_tool_iterations=2).over(G.DEFAULTS)
    r = G.generate(G.HashClient(), [{"role": "user", "content": "go"}], args)
    assert [m["role"] for m in r["added_messages"]] == ["assistant", "tool", "assistant"] and r["content"]

    class Calls:
        def complete(self, messages, args):
            return {"content": [G.block("tool_use", id="t", name="roll_dice", input='{"notation": "d6"}')], "finish_reason": "tool_use", "usage": {}}

    r = G.generate(Calls(), [{"role": "user", "content": "go"}], args)
    assert sum(m["role"] == "tool" for m in r["added_messages"]) == 2


def test_column_is_stable(spark):
    df = spark.range(6).select("id", K.ask(F.concat(F.lit("tell me of "), F.col("id").cast("string"))).alias("c"))
    f = lambda n: {r.id: r.result.content for r in G.generate_column(df.repartition(n), "id", "c").collect()}
    assert f(1) == f(4) and len(set(f(1).values())) > 1
    nulls = spark.createDataFrame([(1, None)], "id long, c array<struct<role:string,content:string>>")
    assert G.generate_column(nulls, "id", "c").first().result.finish_reason == "error"


def test_five_turns(spark):
    rows = E.play(E.seeds(spark, 3), steps=5).collect()
    assert len(rows) == 3
    for r in rows:
        acts = json.loads(r.actions)
        assert r.step_count == 5 and len(acts) == 10 and len(r.conversation_lines) == 10
        assert [a["role"] for a in acts[:2]] == ["dungeon_master", "player"]
        m = json.loads(r.metadata)["generation_metrics"]
        assert sum(x["stage"].startswith("dungeon_master") for x in m) == 5
        assert json.loads(r.metrics)["tool_uses"] == sum(b["type"] == "tool_use" for a in acts for x in a["messages"] for b in x["content"])
    again = E.play(E.seeds(spark, 3).repartition(3), steps=5).collect()
    assert {r.episode_id: r.transcript for r in rows} == {r.episode_id: r.transcript for r in again}


def test_seen_by_has_no_raw_blocks():
    a = [{"role": "dungeon_master", "messages": [{"role": "assistant", "content": [G.block("thinking", thinking="secret"), G.block("tool_use", name="roll_dice", input="{}")]}]}]
    seen = E.seen_by("player", a)
    assert seen == [{"role": "user", "content": "<tool_call>roll_dice {}</tool_call>"}]
    assert E.seen_by("dungeon_master", a)[0] == {"role": "user", "content": "Begin."}


def test_tasks(spark):
    df = spark.createDataFrame([(1, "Name three birds"), (2, "Sum 2 and 3")], "row_id long, instruction string")
    got = K.TASKS["refusal"].run(df).collect()
    assert {r.row_id for r in got} == {1, 2} and all(r.response for r in got)
    scored = K.best_of_n(df, "row_id", "instruction", ["hash", "hash-short"])
    assert scored.count() == 4
    chunks = spark.createDataFrame([("a", "Once upon a time"), ("b", "A list")], "k string, text string")
    assert K.backtranslate(chunks, "k", keep_all=True).count() == 2
    runs = K.eval_runs(df.withColumnRenamed("instruction", "t"), "row_id", "t", 3)
    assert runs.count() == 6


def test_code():
    assert code.run_code("print(input())", "hi")["stdout"] == "hi\n"
    assert code.run_code("while True: pass", seconds=1)["error"] == "timeout"
    assert code.run_code("x = [0] * 10**9")["ok"] is False
    assert code.run_tests("def f(x): return x", "METADATA = {}\nassert f(1) == 1\nassert f(1) == 2\nassert g()")["results"] == [True, False, False]
    task = code.as_function_task("p", "def f(x):\n    return x", ["assert f(2) == 2"])
    assert task["entry_point"] == "f" and code.run_tests(task["canonical_solution"], task["test"], "f")["passed"] == 1
    assert code.run_cases("print(int(input()) + 1)", ["1", "2"], ["2", "4"]) == [True, False]
    assert code.best_snippet("```python\na\n```\n```python\nb\n```") == "b" and code.best_snippet("<solution>x = 1") == "x = 1" and code.best_snippet("no code here") is None
