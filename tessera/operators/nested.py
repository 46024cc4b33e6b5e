"""Deeply nested semi-structured records as related flat tables.

Every record is parsed once and run through a bottom-up tree automaton that gives each object its shape (a state). The
state names the variant; each variant is routed to its own typed table, all variants keep the common supertype keys
(episode_id, path, parent, position) and the link to their parent.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_table

NODE = "episode_id long, level string, path string, parent string, position int, variant string, shape string, fields map<string,string>"
MISSING = object()


def members(state: str) -> list[str]:
    """The states of an array's entries; a state that is no array's stands for itself."""
    return [m for m in state[1:-1].split("|") if m] if state.startswith("[") else [state]


@dataclass(frozen=True)
class Rule:
    """A transition of the automaton: objects whose fields reach these states get this state.

    needs: field -> states allowed for it or, where it is an array, for each of its entries (empty: any); may: the same for
    fields that can be missing; tag: the value that the field 'type' must have.
    """

    state: str
    needs: dict[str, tuple[str, ...]] = field(default_factory=dict)
    may: dict[str, tuple[str, ...]] = field(default_factory=dict)
    tag: str | None = None

    def takes(self, value: dict, states: dict[str, str]) -> bool:
        if self.tag is not None and value.get("type") != self.tag:
            return False
        good = lambda f, a: not a or all(m in a or m.partition(":")[0] + ":" in a for m in members(states[f]))
        return all(f in states and good(f, a) for f, a in self.needs.items()) and all(f not in states or good(f, a) for f, a in self.may.items())


class Node:
    """A value with its state and its children: by field in an object, by position in an array."""

    __slots__ = ("kids", "state", "value")

    def __init__(self, value: Any):
        self.value, self.state, self.kids = value, "null", {}


class TreeAutomaton:
    """Deterministic and bottom-up. A leaf has the state of its type; an array the set of its entries' states, nulls left
    out, an array among them as 'list'; an object the first rule that takes it, else 'other:' with its type tag, else
    'object'."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules

    def run(self, value: Any) -> Node:
        """The tree of a value with the state of every node; no recursion, so that no depth is too great."""
        root = Node(value)
        order = [root]
        for n in order:
            if isinstance(n.value, dict):
                n.kids = {str(k): Node(v) for k, v in n.value.items()}
            elif isinstance(n.value, list):
                n.kids = {k: Node(v) for k, v in enumerate(n.value)}
            order.extend(n.kids.values())
        for n in reversed(order):
            n.state = self._state(n)
        return root

    def _state(self, n: Node) -> str:
        v = n.value
        if v is None:
            return "null"
        if isinstance(v, str):
            return "str"
        if isinstance(v, bool):
            return "bool"
        if isinstance(v, dict):
            states = {k: x.state for k, x in n.kids.items()}
            found = next((r.state for r in self.rules if r.takes(v, states)), None)
            return found or (f"other:{v['type']}" if isinstance(v.get("type"), str) else "object")
        if isinstance(v, list):
            return "[" + "|".join(sorted({"list" if x.state.startswith("[") else x.state for x in n.kids.values()} - {"null"})) + "]"
        return "num"

    def state(self, value: Any) -> str:
        return self.run(value).state


def shape(n: Node) -> str:
    """The structural signature of a node: an object's sorted fields with the states they have reached, anything else its state."""
    return "{" + ",".join(sorted(f"{k}:{x.state}" for k, x in n.kids.items())) + "}" if isinstance(n.value, dict) else n.state


BLOCKS = ("text", "thinking", "tool_use", "tool_result", "other:", "str")
AUTOMATON = TreeAutomaton(
    [
        Rule("text", {"text": ("str", "null")}, tag="text"),
        Rule("thinking", {"thinking": ("str", "null")}, {"signature": ("str", "null")}, tag="thinking"),
        Rule("tool_use", {"name": ("str", "null")}, tag="tool_use"),
        Rule("tool_result", {}, {"content": (*BLOCKS, "null")}, tag="tool_result"),
        Rule("usage", {"total_tokens": ("num", "null")}),
        Rule("usage", {"input_tokens": ("num", "null"), "output_tokens": ("num", "null")}),
        Rule("retry", {"attempt": ("num", "null"), "reason": ("str", "null")}),
        Rule("metric", {"stage": ("str", "null")}, {"usage": ("usage", "null"), "retries": ("retry", "null")}),
        Rule("message", {"role": ("str", "null"), "content": (*BLOCKS, "null")}),
        Rule("action", {"messages": ("message", "bare", "str", "null")}, {"role": ("str", "null")}),
        Rule("wrapper", {"actions": ()}),
        Rule("bare", {"role": ("str", "null")}, {"content": ("null",), "messages": ("null",)}),
    ]
)


def load(text: str | None) -> Any:
    """A record kept as text, in JSON, as a literal of Python, or as either inside a JSON string; MISSING where it is no whole record."""
    for _ in range(3):
        if not isinstance(text, str):
            return text
        s = text.strip().lstrip("﻿")
        if not s:
            return None
        try:
            text = json.loads(s)
            continue
        except (ValueError, RecursionError):
            pass
        try:
            text = ast.literal_eval(s)
        except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
            return MISSING
    return text if not isinstance(text, str) else MISSING


def entries(n: Node | None) -> list[tuple[int, Node]]:
    """Entries with their positions; a lone string or object stands for an array of itself, a null entry is none."""
    if n is None or n.value is None:
        return []
    return [(k, x) for k, x in n.kids.items() if x.value is not None] if isinstance(n.value, list) else [(0, n)]


def text_of(value: Any) -> str | None:
    """A field as text; null for one nested too deeply to be written."""
    if value is None or isinstance(value, str):
        return value
    try:
        return json.dumps(value, ensure_ascii=False, sort_keys=True, default=repr)
    except (RecursionError, TypeError, ValueError):
        return None


def flat(n: Node, but: tuple[str, ...] = ()) -> dict[str, str | None]:
    """The fields of an object as text, a usage spread to dotted names; anything else as its text or value."""
    if not isinstance(n.value, dict):
        return {"text" if n.state == "str" else "value": text_of(n.value)}
    out: dict[str, str | None] = {}
    for k, x in n.kids.items():
        if k in but:
            continue
        if x.state == "usage":
            out.update({f"{k}.{a}": text_of(b.value) for a, b in x.kids.items()})
        else:
            out[k] = text_of(x.value)
    return out


#: A node below an episode: level, path, parent, position, variant, the node, fields not repeated in its row.
Found = tuple[str, str, str | None, int, str, Node, tuple[str, ...]]


def nodes(actions: str | None, metadata: str | None) -> Iterator[Found]:
    """Every action, message, block, result entry, metric and retry of one episode with its variant: the state that the automaton gives it.

    A string in the place of a block is a text, one in the place of a message or action is its content.
    """
    top = AUTOMATON.run(None if (v := load(actions)) is MISSING else v)
    if top.state == "wrapper":
        top = top.kids["actions"]
    for i, act in entries(top):
        own = isinstance(act.value, dict)
        yield "action", f"{i}", None, i, act.state, act, ("messages",)
        for j, msg in entries(act.kids.get("messages") if own else act):
            said = isinstance(msg.value, dict)
            yield "message", f"{i}.{j}", f"{i}", j, msg.state, msg, ("content",)
            for k, block in entries(msg.kids.get("content") if said else msg):
                at = f"{i}.{j}.{k}"
                yield "block", at, f"{i}.{j}", k, "text" if block.state == "str" else block.state, block, ()
                inside = block.kids.get("content") if block.state == "tool_result" else None
                if inside is not None and inside.state.startswith("["):
                    for n, part in entries(inside):
                        yield "result", f"{at}.{n}", at, n, "text" if part.state == "str" else part.state, part, ()
    meta = AUTOMATON.run(None if (v := load(metadata)) is MISSING else v)
    for k, metric in entries(meta.kids.get("generation_metrics") if isinstance(meta.value, dict) else None):
        yield "metric", f"{k}", None, k, metric.state, metric, ()
        retries = metric.kids.get("retries") if isinstance(metric.value, dict) else None
        if retries is not None and isinstance(retries.value, (list, dict)):
            for n, retry in entries(retries):
                yield "retry", f"{k}.{n}", f"{k}", n, retry.state, retry, ()


def latest_episodes(episodes: DataFrame) -> DataFrame:
    """The most recently saved row of each episode; among equally late ones the one with most text, then by hash. Spark keeps one row a key and task before the shuffle."""
    size = F.length(F.coalesce("actions", F.lit(""))) + F.length(F.coalesce("metadata", F.lit("")))
    order = Window.partitionBy("episode_id").orderBy(F.col("saved_at").desc_nulls_last(), size.desc(), F.xxhash64("actions", "metadata"))
    return episodes.select("episode_id", "saved_at", "actions", "metadata").withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(F.col("episode_id").cast("long").alias("episode_id"), "actions", "metadata")


def flatten_episodes(episodes: DataFrame, levels: tuple[str, ...] | None = None, fields: bool = True) -> DataFrame:
    """All nodes of the latest row of each episode, one row a node: the supertype table.

    episodes: episode_id, saved_at, actions, metadata; other columns are ignored. Null, empty, and broken-off records
    have no nodes (a broken `actions` leaves the metrics of a whole `metadata`); null entries have none, but keep their
    position. Exact repeats and earlier checkpoints of an episode are dropped. levels: only rows of these; without
    `fields` the column is null and nothing is written out for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
        names = ["episode_id", "level", "path", "parent", "position", "variant", "shape", "fields"]
        for b in batches:
            rows: list[tuple] = []
            for e, a, m in zip(*(b.column(k).to_pylist() for k in range(3))):
                for level, path, parent, position, variant, node, but in nodes(a, m):
                    if levels is None or level in levels:
                        rows.append((e, level, path, parent, position, variant, shape(node), list(flat(node, but).items()) if fields else None))
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return latest_episodes(episodes).mapInArrow(run, NODE)


#: Typed columns of each subtype table: name -> (field, type).
TABLES: dict[str, dict[str, tuple[str, str]]] = {
    "action": {"role": ("role", "string"), "elapsed_s": ("elapsed_s", "double")},
    "message": {"role": ("role", "string")},
    "block_text": {"text": ("text", "string")},
    "block_thinking": {"thinking": ("thinking", "string"), "signature": ("signature", "string")},
    "block_tool_use": {"tool_id": ("id", "string"), "name": ("name", "string"), "input": ("input", "string")},
    "block_tool_result": {"tool_use_id": ("tool_use_id", "string"), "content": ("content", "string"), "is_error": ("is_error", "boolean")},
    "block_other": {"fields": ("*", "map<string,string>")},
    "metric": {
        "stage": ("stage", "string"), "model": ("model", "string"), "latency_s": ("latency_s", "double"), "retries": ("retries", "string"),
        "total_tokens": ("usage.total_tokens", "long"), "input_tokens": ("usage.input_tokens", "long"), "output_tokens": ("usage.output_tokens", "long"),
    },
    "result": {"text": ("text", "string"), "fields": ("*", "map<string,string>")},
    "retry": {"attempt": ("attempt", "long"), "reason": ("reason", "string"), "fields": ("*", "map<string,string>")},
}


#: Level and variants of each table; a table without variants takes those that no other table of its level names.
ROUTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "action": ("action", ()), "message": ("message", ()), "metric": ("metric", ()), "result": ("result", ()), "retry": ("retry", ()),
    **{f"block_{v}": ("block", (v,)) for v in ("text", "thinking", "tool_use", "tool_result")}, "block_other": ("block", ()),
}


def typed_table(all_nodes: DataFrame, name: str) -> DataFrame:
    """One subtype table with the supertype keys and its own typed columns; a field of another type is null there.

    Rows are routed by level and variant, the automaton's state; objects that bear a tag but not the fields of its
    subtype have the variant 'other:' with that tag and go to block_other.
    """
    level, own = ROUTES[name]
    keep = F.col("level") == level
    taken = [v for at, vs in ROUTES.values() if at == level for v in vs]
    if own or taken:
        keep &= F.col("variant").isin(*own) if own else ~F.col("variant").isin(*taken)
    cols = [F.col("fields").alias(c) if f == "*" else F.col("fields")[f].try_cast(t).alias(c) for c, (f, t) in TABLES[name].items()]
    return all_nodes.filter(keep).select("episode_id", "path", "parent", "position", "variant", "shape", *cols)


def typed_tables(all_nodes: DataFrame) -> dict[str, DataFrame]:
    """All subtype tables; the nodes are written once, so no table parses the episodes again."""
    written = cut_table(all_nodes)
    return {name: typed_table(written, name) for name in TABLES}


def listed_children(all_nodes: DataFrame) -> DataFrame:
    """child, episode_id, path of every content block and metric; the child is the variant, of an unknown one its tag."""
    child = F.when(F.col("level") == "metric", F.lit("metric")).otherwise(F.regexp_replace("variant", "^other:", ""))
    return all_nodes.filter(F.col("level").isin("block", "metric")).select(child.alias("child"), "episode_id", "path")
