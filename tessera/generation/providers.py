"""Clients for the two common shapes of chat services. Each builds a request and reads a reply; what carries them is a transport that the caller gives, a function from request to reply, so everything here is tested offline."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..functions.conversation import FINISH
from ..operators.datasets import split_system, to_tool_calls
from .client import Args, Message, block

Transport = Callable[[dict[str, Any]], dict[str, Any]]


def described(tools: tuple[str, ...] | None, schemas: dict[str, dict]) -> list[tuple[str, str, dict]]:
    """name, description and parameters of the tools of a call; a tool without a schema takes any object."""
    return [(t, schemas.get(t, {}).get("description", t), schemas.get(t, {}).get("parameters", {"type": "object"})) for t in tools or ()]


def without_none(request: dict[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in request.items() if v is not None and v != []}


@dataclass
class ChatClient:
    """The shape with tool_calls and tool messages. local: a server of one's own, which is sent no tool choice and takes the length limit under its older name."""

    transport: Transport
    model: str
    schemas: dict[str, dict] = field(default_factory=dict)
    forced_tool: str | None = None
    local: bool = False

    def request(self, messages: list[Message], args: Args) -> dict[str, Any]:
        tools = [{"type": "function", "function": {"name": n, "description": d, "parameters": p}} for n, d, p in described(args.tools, self.schemas)]
        forced = {"type": "function", "function": {"name": self.forced_tool}} if self.forced_tool and tools and not self.local else None
        return without_none({"model": self.model, "messages": to_tool_calls(messages), "temperature": args.temperature, "seed": args.seed, "stop": list(args.stop) if args.stop else None, "max_tokens" if self.local else "max_completion_tokens": args.max_tokens, "tools": tools, "tool_choice": forced})

    def complete(self, messages: list[Message], args: Args) -> dict[str, Any]:
        reply = self.transport(self.request(messages, args))
        choice = reply["choices"][0]
        said = choice["message"]
        thoughts = said.get("reasoning_content") or said.get("reasoning")
        content = [block("thinking", thinking=thoughts)] if thoughts else []
        if said.get("content"):
            content.append(block("text", text=said["content"]))
        for c in said.get("tool_calls") or ():
            given = c["function"].get("arguments") or "{}"
            content.append(block("tool_use", id=c["id"], name=c["function"]["name"], input=given if isinstance(given, str) else json.dumps(given)))
        u = reply.get("usage") or {}
        return {"content": content or [block("text", text="")], "finish_reason": FINISH.get(choice.get("finish_reason"), choice.get("finish_reason") or "end_turn"), "usage": {"input_tokens": u.get("prompt_tokens"), "output_tokens": u.get("completion_tokens")}}


@dataclass
class MessagesClient:
    """The shape with a system text apart and blocks in every message. A service of this shape refuses to think where a tool is forced, and takes no temperature where it thinks, so a forced tool wins over thinking and thinking over the temperature."""

    transport: Transport
    model: str
    schemas: dict[str, dict] = field(default_factory=dict)
    forced_tool: str | None = None
    thinking_tokens: int | None = None

    def blocks(self, content: Any) -> list[dict[str, Any]]:
        if isinstance(content, str):
            return [{"type": "text", "text": content}] if content else []
        out: list[dict[str, Any]] = []
        for b in content:
            if b["type"] == "text" and b.get("text"):
                out.append({"type": "text", "text": b["text"]})
            elif b["type"] == "thinking" and b.get("signature"):
                out.append({"type": "thinking", "thinking": b["thinking"], "signature": b["signature"]})
            elif b["type"] == "tool_use":
                try:
                    given = json.loads(b.get("input") or "{}")
                except ValueError:
                    given = None
                out.append({"type": "tool_use", "id": b["id"], "name": b["name"], "input": given if isinstance(given, dict) else {"raw": b["input"]}})
            elif b["type"] == "tool_result":
                out.append({"type": "tool_result", "tool_use_id": b["tool_use_id"], "content": b.get("content") or "", "is_error": bool(b.get("is_error"))})
        return out

    def request(self, messages: list[Message], args: Args) -> dict[str, Any]:
        system, rest = split_system(messages)
        said: list[dict[str, Any]] = []
        for m in rest:
            role, own = "assistant" if m["role"] == "assistant" else "user", self.blocks(m["content"])
            if not own:
                continue
            if said and said[-1]["role"] == role:  # roles take turns in this shape
                said[-1]["content"] += own
            else:
                said.append({"role": role, "content": own})
        tools = [{"name": n, "description": d, "input_schema": p} for n, d, p in described(args.tools, self.schemas)]
        forced = {"type": "tool", "name": self.forced_tool} if self.forced_tool and tools else None
        thinking = {"type": "enabled", "budget_tokens": self.thinking_tokens} if self.thinking_tokens and not forced else None
        limit = (args.max_tokens or 1024) + (self.thinking_tokens if thinking else 0)
        return without_none({"model": self.model, "system": system, "messages": said, "max_tokens": limit, "temperature": None if thinking else args.temperature, "stop_sequences": list(args.stop) if args.stop else None, "tools": tools, "tool_choice": forced, "thinking": thinking})

    def complete(self, messages: list[Message], args: Args) -> dict[str, Any]:
        reply = self.transport(self.request(messages, args))
        content = []
        for b in reply.get("content") or ():
            if b["type"] == "text":
                content.append(block("text", text=b["text"]))
            elif b["type"] == "thinking":
                content.append(block("thinking", thinking=b["thinking"]) | {"signature": b.get("signature")})
            elif b["type"] == "tool_use":
                content.append(block("tool_use", id=b["id"], name=b["name"], input=json.dumps(b["input"])))
        u = reply.get("usage") or {}
        return {"content": content or [block("text", text="")], "finish_reason": reply.get("stop_reason") or "end_turn", "usage": {"input_tokens": u.get("input_tokens"), "output_tokens": u.get("output_tokens")}}
