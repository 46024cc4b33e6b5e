"""Requests and replies of both service shapes over a transport of the test's own; the shared bucket; rows with repeated keys."""

from __future__ import annotations

import json
import threading

import pytest
from pyspark.sql import functions as F

from tessera.functions import conversation as C
from tessera.generation import client as G
from tessera.generation.providers import ChatClient, MessagesClient

ARGS = G.Args(max_tokens=100, temperature=0.5, seed=3, stop=("END",), tools=("roll_dice",))
USE = G.block("tool_use", id="t1", name="roll_dice", input='{"notation": "d6"}')
TALK = [
    {"role": "system", "content": "Be kind."}, {"role": "user", "content": "Roll."}, {"role": "assistant", "content": [G.block("thinking", thinking="hm") | {"signature": "s"}, G.block("text", text="Now."), USE]},
    {"role": "tool", "content": [G.block("tool_result", tool_use_id="t1", content="4", is_error=False)]}, {"role": "user", "content": "And?"},
]


def test_chat_shape():
    seen = []

    def transport(request):
        seen.append(request)
        return {"choices": [{"finish_reason": "tool_calls", "message": {"content": None, "reasoning": "so", "tool_calls": [{"id": "t2", "function": {"name": "roll_dice", "arguments": '{"notation": "2d6"}'}}]}}], "usage": {"prompt_tokens": 7, "completion_tokens": 2}}

    r = ChatClient(transport, "m", {"roll_dice": {"description": "Rolls.", "parameters": {"type": "object", "required": ["notation"]}}}, forced_tool="roll_dice").complete(TALK, ARGS)
    q = seen[0]
    assert [m["role"] for m in q["messages"]] == ["system", "user", "assistant", "tool", "user"]
    assert q["messages"][2]["tool_calls"][0]["function"] == {"name": "roll_dice", "arguments": '{"notation": "d6"}'} and q["messages"][3]["tool_call_id"] == "t1"
    assert q["tools"][0]["function"]["description"] == "Rolls." and q["tool_choice"]["function"]["name"] == "roll_dice" and q["max_completion_tokens"] == 100 and q["stop"] == ["END"] and q["seed"] == 3
    assert [b["type"] for b in r["content"]] == ["thinking", "tool_use"] and r["finish_reason"] == "tool_use" and r["usage"] == {"input_tokens": 7, "output_tokens": 2}
    own = ChatClient(transport, "m", forced_tool="roll_dice", local=True).request(TALK, ARGS)
    assert "tool_choice" not in own and own["max_tokens"] == 100
    assert "tools" not in ChatClient(transport, "m").request(TALK, G.Args()) and "temperature" not in ChatClient(transport, "m").request(TALK, G.Args())


def test_messages_shape():
    def transport(request):
        return {"stop_reason": "end_turn", "content": [{"type": "thinking", "thinking": "a", "signature": "z"}, {"type": "text", "text": "Four."}], "usage": {"input_tokens": 5, "output_tokens": 1}}

    c = MessagesClient(transport, "m", thinking_tokens=2000)
    q = c.request(TALK, ARGS)
    assert q["system"] == "Be kind." and [m["role"] for m in q["messages"]] == ["user", "assistant", "user"]
    assert [b["type"] for b in q["messages"][1]["content"]] == ["thinking", "text", "tool_use"] and q["messages"][1]["content"][2]["input"] == {"notation": "d6"}
    assert [b["type"] for b in q["messages"][2]["content"]] == ["tool_result", "text"]
    assert q["thinking"]["budget_tokens"] == 2000 and "temperature" not in q and q["max_tokens"] == 2100 and q["stop_sequences"] == ["END"]
    forced = MessagesClient(transport, "m", forced_tool="roll_dice", thinking_tokens=2000).request(TALK, ARGS)
    assert forced["tool_choice"] == {"type": "tool", "name": "roll_dice"} and "thinking" not in forced and forced["temperature"] == 0.5 and forced["max_tokens"] == 100
    r = c.complete(TALK, ARGS)
    assert r["content"][1]["text"] == "Four." and r["finish_reason"] == "end_turn" and r["usage"]["input_tokens"] == 5
    assert MessagesClient(lambda q: {}, "m").complete(TALK, ARGS)["content"][0]["text"] == ""


def test_tool_loop_over_a_transport():
    replies = [{"stop_reason": "tool_use", "content": [{"type": "tool_use", "id": "t", "name": "roll_dice", "input": {"notation": "d6"}}]}, {"stop_reason": "end_turn", "content": [{"type": "text", "text": "Done."}]}]
    asked = []
    c = MessagesClient(lambda q: asked.append(q) or replies[len(asked) - 1], "m")
    r = G.generate(c, [{"role": "user", "content": "Roll."}], ARGS.over(G.DEFAULTS))
    assert r["content"] == "Done." and [m["role"] for m in r["added_messages"]] == ["assistant", "tool", "assistant"]
    assert asked[1]["messages"][-1]["content"][0]["type"] == "tool_result" and json.loads(asked[1]["messages"][-1]["content"][0]["content"])["total"] <= 6


def test_threads_share_a_bucket():
    now, lock, waits = [0.0], threading.Lock(), []
    b = G.TokenBucket(100, estimate=100, clock=lambda: now[0], sleep=lambda s: (lock.acquire(), waits.append(s), lock.release()))
    ts = [threading.Thread(target=lambda: [b.take() for _ in range(5)]) for _ in range(8)]
    for t in ts:
        t.start()
    for t in ts:
        t.join()
    assert sorted(waits) == pytest.approx([float(k) for k in range(1, 40)])  # 40 calls of a second's tokens each, one at once


def test_repeated_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, None, "y")], "id long, q string, note string")
    conv = df.withColumn("c", F.when(F.col("q").isNotNull(), F.array(C.message("user", F.col("q")))))
    got = {(r.id, r.q, r.note): (r.result.finish_reason, r.result.content) for r in G.generate_column(conv, "id", "c").collect()}
    assert len(got) == 3 and got[1, "a", "x"] == ("end_turn", " ".join(["a"] * 24)) and got[1, "b", None][1].startswith("b") and got[2, None, "y"] == ("error", None)


def test_perspective_of_blocks(spark):
    kind = "id int, conv array<struct<role:string,content:array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string>>>>"
    b = lambda t, **k: {"type": t} | k
    conv = [
        ("player", [b("text", text="Go."), b("thinking", thinking="hm")]), ("dm", [b("tool_use", name="roll", input="{}"), b("text", text="You go.")]),
        ("dm", [b("thinking", thinking="only")]), ("tool", [b("tool_result", text="4")]), ("player", None),
    ]
    full = lambda x: None if x is None else [tuple(d.get(k) for k in ("type", "text", "thinking", "id", "name", "input")) for d in x]
    df = spark.createDataFrame([(1, [(r, full(c)) for r, c in conv]), (2, []), (3, None)], kind)
    got = {r.id: r for r in df.select("id", C.transcript(C.block_perspective(F.col("conv"), "dm", 8, "Begin.")).alias("dm"), C.transcript(C.block_perspective(F.col("conv"), "player", 8, "Begin.")).alias("player"), C.block_transcript(F.col("conv")).alias("t")).collect()}
    assert got[1].dm == 'user: Go.\nassistant: <tool_call>{"name":"roll","input":"{}"}</tool_call>\nYou go.\nuser: <tool_result>4</tool_result>'
    assert got[1].player.startswith("user: Begin.\nassistant: Go.\nuser: <tool_call>") and got[2].dm == "user: Begin."
    assert got[1].t == "player: Go.\ndm: <tool_use name=roll> You go.\ndm: \ntool: \nplayer: "
