"""Filters and formats of particular datasets."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import datasets as D
from tessera.sources import sinks


def test_catalogue(spark):
    rows = [(1, "en", "Category: Science-Fiction & Fantasy"), (2, "en", "Category: American Literature; Category: Romance"), (3, "fr", "Category: Fantasy"), (4, "en", None), (5, "en", "Browsing: Fantasy"), (6, "en", "Category: American Literature; Nobel Prizes")]
    df = spark.createDataFrame(rows, "`Text#` int, Language string, Bookshelves string")
    assert sorted(r.id for r in D.catalogue(df).collect()) == [1, 6]


def test_contest_problems(spark):
    tests = "struct<input:array<string>,output:array<string>>"
    schema = f"name string, source int, is_description_translated boolean, input_file string, output_file string, private_tests {tests}, solutions struct<language:array<int>,solution:array<string>>"
    ok = (["1"], ["2"])
    rows = [("b", 2, False, "", None, ok, ([2, 3], ["cpp", "py"])), ("a", 2, None, "", "", ok, ([3], ["first"])), ("c", 1, False, "", "", ok, ([3], ["x"])), ("d", 2, True, "", "", ok, ([3], ["x"])), ("e", 2, False, "in.txt", "", ok, ([3], ["x"])), ("f", 2, False, "", "", ([], []), ([3], ["x"])), ("g", 2, False, "", "", ok, ([2], ["x"]))]
    got = D.contest_problems(spark.createDataFrame(rows, schema)).collect()
    assert [(r.name, r.python_solution) for r in got] == [("a", "first"), ("b", "py")]
    assert D.code_of("PYTHON3", D.CONTEST_LANGUAGES) == 3


def test_scene_and_rows(spark):
    rich = json.dumps([{"type": "action"}] * 3 + [{"type": "dialogue"}] * 2)
    df = spark.createDataFrame([(rich,), ("[]",), ("broken",), (None,)], "c string")
    assert [r.x for r in df.select(D.scene_is_rich(F.col("c")).alias("x")).collect()] == [True, False, False, False]
    k = spark.createDataFrame([("[]", None), (None, [("user", "a")]), (None, None)], "actions string, messages array<struct<role:string,content:string>>")
    assert [r.x for r in k.select(D.row_kind(k).alias("x")).collect()] == ["roleplay", "conversation", "generic"]
    assert [r.x is None for r in k.select(D.messages_of(k).alias("x")).collect()] == [True, False, True]
    r = df.limit(1).select(D.alternating_roles(F.array(F.lit("a"), F.lit("b"))).alias("t"), D.winner_label(F.lit(0)).alias("w"), *D.pass_counts(F.array(F.array(F.lit(True), F.lit(False)), F.array(F.lit(True))))).first()
    assert [m.role for m in r.t] == ["dungeon_master", "player"] and (r.w, r.passed, r.total) == (0, 2, 3)


def test_macro_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "a")], "t string, g string")
    r = D.macro_scores(df, "t", "g").first()
    assert (r.precision, r.recall, r.f1) == (pytest.approx(0.75), pytest.approx(0.75), pytest.approx(2 / 3))


def test_puzzles(spark):
    groups = [[f"w{k}{g}{i}" for i in range(4)] for k in range(1) for g in range(4)]
    p = spark.createDataFrame([(k, [[f"{w}{k}" for w in g] for g in groups]) for k in range(5)], "id int, groups array<array<string>>")
    got = D.sample_groups(p, "id", "groups", 12).collect()
    assert len(got) == 12 and len({r.puzzle for r in got}) == 12
    assert all(len(r.groups) == 4 and len(set(r.words)) == 16 for r in got)
    r = p.limit(1).select(D.puzzle_prompt(F.array(F.lit("a"))).alias("p"), D.puzzle_answer(F.col("groups")).alias("a")).first()
    assert r.p.endswith("\na") and r.a.count("<group>") == 4


def test_formats(spark):
    df = spark.createDataFrame([("ctx", "q?", ["yes"], "so #### 12"), ("ctx", "q?", [], None)], "c string, q string, a array<string>, s string")
    rows = df.select(*D.question_row(F.col("c"), F.col("q"), F.col("a")), D.arithmetic_row(F.col("q"), F.col("s"))[1]).collect()
    assert [r.label for r in rows] == ["yes", "Cannot answer this question"] and rows[0].answer == "12"
    t = df.limit(1).select(D.thought_row(F.col("q"), F.col("a"), F.lit("x")).alias("t"), D.instruction_row(F.col("q"), F.col("c"), "S").alias("i")).first()
    assert t.t[1].content == "<thought>yes</thought>\n<solution>\nx\n</solution>" and [m.role for m in t.i] == ["system", "user", "assistant"]


def test_call_preferences_drop_equal_calls(spark):
    e = spark.createDataFrame([(1, "p", "f(1)"), (2, "p", "f(2)")], "id int, prompt string, call string")
    s = spark.createDataFrame([(1, "f(1) "), (2, "g(2)")], "id int, call string")
    assert [(r.id, r.chosen, r.rejected) for r in D.call_preferences(e, s, "id").collect()] == [(2, "f(2)", "g(2)")]


def test_evaluated_code(spark):
    df = spark.createDataFrame([(1, "```python\ndef f(x):\n    return x + 1\n```", "assert f(1) == 2\nassert f(1) == 3"), (2, "no code", "assert True")], "id int, a string, t string")
    got = {r.id: (r.passed, r.total) for r in D.evaluate_code(df, "id", "a", "t").collect()}
    assert got == {1: (1, 2), 2: (1, 1)}


def test_provider_shapes():
    m = [{"role": "system", "content": "S"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "t", "name": "f", "input": "{}"}]}, {"role": "tool", "content": [{"type": "tool_result", "tool_use_id": "t", "content": "1"}]}]
    got = D.to_tool_calls(m)
    assert [x["role"] for x in got] == ["system", "assistant", "tool"] and got[1]["tool_calls"][0]["function"]["name"] == "f" and got[2]["tool_call_id"] == "t"
    assert D.split_system(m) == ("S", m[1:])


def test_settings_and_logs(spark, tmp_path):
    sinks.write_settings(spark, {"b": 1, "a": [2]}, f"file://{tmp_path}/s.json")
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": [2], "b": 1}
    df = spark.createDataFrame([("a\nb" * 2000, 1)], "t string, n int")
    for k in range(2):
        sinks.log_samples(df, str(tmp_path / "log"), ["t", "n"], k)
    rows = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(rows) == 2 and all(len(r.t) == 1003 for r in rows)
