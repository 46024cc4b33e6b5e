"""The model client: a protocol, an offline stand-in, registry, limits, retries, and the one place where rows meet a model."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, TimeoutError
from dataclasses import dataclass, field, fields, replace
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .tools import run_tool

Message = dict[str, Any]
BLOCK = "struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>"
RESULT = f"struct<added_messages:array<struct<role:string,content:array<{BLOCK}>>>,finish_reason:string,content:string,usage:struct<total_tokens:bigint,input_tokens:bigint,output_tokens:bigint>>"
EMPTY = dict.fromkeys(("type", "text", "thinking", "id", "name", "input", "tool_use_id", "content", "is_error"))


@dataclass(frozen=True)
class Args:
    """Generation arguments; None leaves a preset's value."""

    max_tokens: int | None = None
    temperature: float | None = None
    stop: tuple[str, ...] | None = None
    seed: int | None = None
    tools: tuple[str, ...] | None = None
    max_tool_iterations: int | None = None
    timeout_s: float | None = None
    retries: int | None = None

    def over(self, base: Args) -> Args:
        """These arguments over others: what isn't None wins."""
        return replace(base, **{f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None})


DEFAULTS = Args(max_tokens=1024, temperature=0.7, seed=0, max_tool_iterations=8, timeout_s=120.0, retries=3)


class ModelClient(Protocol):
    """One call: messages of blocks in, one assistant message of blocks out with its finish reason and usage."""

    def complete(self, messages: list[Message], args: Args) -> dict[str, Any]: ...


def block(kind: str, **own: Any) -> dict[str, Any]:
    return EMPTY | {"type": kind} | own


def text_of(messages: list[Message]) -> str:
    return "\n".join(b.get("text") or b.get("content") or "" for m in messages for b in (m["content"] if isinstance(m["content"], list) else [block("text", text=m["content"])]))


@dataclass
class HashClient:
    """Offline and deterministic: the answer is made of the words of the prompt, chosen by a hash of prompt and seed; a tool is called on the first step if tools are given."""

    words: int = 24

    def complete(self, messages: list[Message], args: Args) -> dict[str, Any]:
        said = text_of(messages)
        h = int(hashlib.sha256(f"{args.seed}|{said}".encode()).hexdigest(), 16)
        if args.tools and messages[-1]["role"] != "tool":
            name = args.tools[h % len(args.tools)]
            given = {"roll_dice": {"notation": f"{1 + h % 3}d6", "reason": "chance"}, "random_choice": {"options": ["left", "right"], "reason": "way"}, "speak": {"character": "Guide", "message": "Go on."}, "action": {"description": "looks around"}}
            content = [block("tool_use", id=f"tu_{h % 10**6}", name=name, input=json.dumps(given.get(name, {})))]
            return {"content": content, "finish_reason": "tool_use", "usage": {"input_tokens": len(said.split()), "output_tokens": 8}}
        pool = said.split() or ["nothing"]
        out = " ".join(pool[(h >> (k % 200)) % len(pool)] for k in range(min(self.words, args.max_tokens or self.words)))
        return {"content": [block("text", text=out)], "finish_reason": "end_turn", "usage": {"input_tokens": len(pool), "output_tokens": len(out.split())}}


@dataclass
class ListClient:
    """Answers from a list, first in first out; for tests."""

    answers: list[dict[str, Any]] = field(default_factory=list)

    def complete(self, messages: list[Message], args: Args) -> dict[str, Any]:
        return self.answers.pop(0)


CLIENTS: dict[str, tuple[Callable[[], ModelClient], Args]] = {"hash": (HashClient, DEFAULTS), "hash-short": (lambda: HashClient(6), replace(DEFAULTS, max_tokens=6))}


def register(name: str, make: Callable[[], ModelClient], args: Args = DEFAULTS) -> None:
    CLIENTS[name] = (make, args)


def client_of(name: str, args: Args = Args()) -> tuple[ModelClient, Args]:
    """A registered client with its arguments, those given over the preset's."""
    if name not in CLIENTS:
        raise KeyError(f"no client {name!r}; known: {', '.join(sorted(CLIENTS))}")
    make, preset = CLIENTS[name]
    return make(), args.over(preset)


class TokenBucket:
    """Tokens a second, with an estimate of a call's size that follows what calls took (weight 0.2); a call is charged the estimate and then settled. Threads may share one: a charge is booked under a lock, and a call that finds too little waits for its own debt outside it."""

    def __init__(self, rate: float, estimate: float = 500.0, weight: float = 0.2, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.estimate, self.weight, self.clock, self.sleep = rate, estimate, weight, clock, sleep
        self.level, self.at, self.lock = rate, clock(), threading.Lock()

    def _fill(self) -> None:
        now = self.clock()
        self.level, self.at = min(max(self.rate, self.estimate), self.level + (now - self.at) * self.rate), now

    def take(self) -> float:
        with self.lock:
            self._fill()
            want = self.estimate
            self.level -= want
            wait = -self.level / self.rate
        if wait > 0:
            self.sleep(wait)
        return want

    def settle(self, charged: float, used: float) -> None:
        with self.lock:
            self.level += charged - used
            self.estimate += self.weight * (used - self.estimate)


def parallel_calls(tokens_per_second: float, estimate: float) -> int:
    """Calls at a time that the rate allows."""
    return max(1, int(tokens_per_second // max(estimate, 1.0)))


def attempt(client: ModelClient, messages: list[Message], args: Args, sleep: Callable[[float], None] = time.sleep, bucket: TokenBucket | None = None) -> dict[str, Any]:
    """One completion with retries (waits of 1, 2, 4 .. 10 s) and a time limit; what still fails becomes a result with finish_reason 'error'."""
    last = ""
    for k in range(max(1, args.retries or 1)):
        charged = bucket.take() if bucket else 0.0
        pool = ThreadPoolExecutor(1)
        try:
            r = pool.submit(client.complete, messages, args).result(args.timeout_s)
            if bucket:
                bucket.settle(charged, sum(v or 0 for v in r.get("usage", {}).values()))
            return r
        except TimeoutError:
            last = f"no answer within {args.timeout_s} s"
        except Exception as e:  # noqa: BLE001  a row's failure must not fail the task
            last = f"{type(e).__name__}: {e}"
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        if k + 1 < (args.retries or 1):
            sleep(min(2**k, 10))
    return {"content": [block("text", text="")], "finish_reason": "error", "usage": {}, "error": last}


def generate(client: ModelClient, messages: list[Message], args: Args, seed: int = 0, sleep: Callable[[float], None] = time.sleep, bucket: TokenBucket | None = None) -> dict[str, Any]:
    """A completion with its tool loop: tools are run and their results appended until the model stops calling or the limit is reached."""
    added: list[Message] = []
    used = {"input_tokens": 0, "output_tokens": 0}
    for step in range((args.max_tool_iterations or 0) + 1):
        r = attempt(client, messages + added, args, sleep, bucket)
        for k in used:
            used[k] += r.get("usage", {}).get(k) or 0
        added.append({"role": "assistant", "content": r["content"]})
        calls = [b for b in r["content"] if b["type"] == "tool_use"]
        if not calls or step == (args.max_tool_iterations or 0):
            break
        results = [block("tool_result", tool_use_id=b["id"], **run_tool(b["name"], b["input"], seed=f"{seed}:{step}:{k}")) for k, b in enumerate(calls)]
        added.append({"role": "tool", "content": results})
    said = "\n".join(b["text"] for b in added[-1]["content"] if b["type"] == "text" and b["text"]).strip()
    return {"added_messages": added, "finish_reason": r["finish_reason"], "content": said, "usage": used | {"total_tokens": sum(used.values())}}


def generate_column(df: DataFrame, key: str, conversation: str, client: str = "hash", args: Args = Args(), tokens_per_second: float | None = None, partitions: int | None = None, workers: int = 4) -> DataFrame:
    """df with a column `result`, row by row as they are read: nothing is joined back, so keys may repeat. conversation:
    array of struct<role, content>. The one Python step; call it once and write or checkpoint what it gives, so that no
    plan asks the model again. A rate is shared by `partitions` tasks, each with its own limiter; rows of a task run in
    `workers` threads, in order. Null conversations give finish_reason 'error'.
    """
    rate = tokens_per_second / partitions if tokens_per_second and partitions else tokens_per_second
    src = df.coalesce(partitions) if partitions else df
    kind = to_arrow_type(_parse_datatype_string(RESULT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, own = client_of(client, args)
        bucket = TokenBucket(rate) if rate else None

        def one(pair: tuple[Any, Any]) -> dict[str, Any]:
            k, conv = pair
            if conv is None:
                return {"added_messages": [], "finish_reason": "error", "content": None, "usage": None}
            return generate(model, [{"role": m["role"], "content": m["content"]} for m in conv], own, seed=k, bucket=bucket)

        with ThreadPoolExecutor(parallel_calls(rate, 500.0) if rate else workers) as pool:
            for b in batches:
                made = list(pool.map(one, zip(b.column(key).to_pylist(), b.column(conversation).to_pylist())))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, kind)], names=[*b.schema.names, "result"])

    return src.mapInArrow(run, StructType([*df.schema.fields, StructField("result", _parse_datatype_string(RESULT))]))
