"""Episodes of several roles in turns: first step, further steps, formatting; one row is one episode."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import choice
from .client import Args, ModelClient, block, client_of, generate

SCHEMA = "episode_id long, step_count long, game_setting string, player_character string, actions string, conversation_lines array<string>, transcript string, metrics string, metadata string"
THEMES = ("a harbour town", "a mountain pass", "an old library", "a desert caravan", "a space station")
ASK = {
    "dungeon_master": "You lead the story. Describe what happens next and call a tool where chance decides.",
    "player": "You play {character}. Say or do one thing.",
    "parameters": "Name a setting and a character for a story set in {theme}, as <setting>..</setting><character>..</character>.",
}
TOOLS_OF = {"dungeon_master": ("roll_dice", "random_choice"), "player": ("action",)}


@dataclass
class Episode:
    episode_id: int
    theme: str
    seed: int
    setting: str = ""
    character: str = ""
    actions: list[dict[str, Any]] = field(default_factory=list)
    metrics: list[dict[str, Any]] = field(default_factory=list)
    steps: int = 0


def flat_text(b: dict[str, Any]) -> str | None:
    """A block as others see it: tools in tags, no thinking."""
    if b["type"] == "text":
        return b["text"]
    if b["type"] == "tool_use":
        return f"<tool_call>{b['name']} {b['input']}</tool_call>"
    return f"<tool_result>{b['content']}</tool_result>" if b["type"] == "tool_result" else None


def seen_by(role: str, actions: list[dict[str, Any]], last: int = 8) -> list[dict[str, Any]]:
    """The last actions as a role sees them: its own as assistant, the others' as user, successive ones of a side as one."""
    out: list[dict[str, Any]] = []
    for a in actions[-last:]:
        said = "\n".join(t for m in a["messages"] for b in m["content"] if (t := flat_text(b)))
        side = "assistant" if a["role"] == role else "user"
        if out and out[-1]["role"] == side:
            out[-1]["content"] += "\n" + said
        else:
            out.append({"role": side, "content": said})
    if not out or out[0]["role"] == "assistant":
        out.insert(0, {"role": "user", "content": "Begin."})
    return out


def between(text: str, tag: str) -> str | None:
    start = text.find(f"<{tag}>")
    end = text.find(f"</{tag}>", start)
    return text[start + len(tag) + 2 : end].strip() if 0 <= start < end else None


def first_step(e: Episode, client: ModelClient, args: Args, tries: int = 3) -> None:
    """Setting and character from the model, asked again more strictly up to `tries` times; else taken from the theme."""
    ask = ASK["parameters"].format(theme=e.theme)
    for k in range(tries):
        r = generate(client, [{"role": "user", "content": ask + " Answer with the two tags only." * k}], args, seed=e.seed + k)
        e.metrics.append(metric("parameters", r))
        setting, character = between(r["content"], "setting"), between(r["content"], "character")
        if setting and character:
            e.setting, e.character = setting, character
            return
    e.setting, e.character = f"A story in {e.theme}", f"Traveller {e.seed % 100}"


def metric(stage: str, r: dict[str, Any]) -> dict[str, Any]:
    return {"stage": stage, "finish_reason": r["finish_reason"], "usage": r["usage"]}


def step(e: Episode, client: ModelClient, args: Args) -> None:
    """One action of each role."""
    for role in ("dungeon_master", "player"):
        system = {"role": "system", "content": f"{e.setting}\n" + ASK[role].format(character=e.character)}
        r = generate(client, [system, *seen_by(role, e.actions)], Args(tools=TOOLS_OF[role]).over(args), seed=e.seed + e.steps)
        e.actions.append({"role": role, "messages": r["added_messages"]})
        e.metrics.append(metric(f"{role}_turn_{e.steps}", r))
    e.steps += 1


def formatted(e: Episode) -> dict[str, Any]:
    lines = [f"{a['role']}: " + " ".join(t for m in a["messages"] for b in m["content"] if (t := flat_text(b))) for a in e.actions]
    blocks = [b for a in e.actions for m in a["messages"] for b in m["content"]]
    counts = {"tool_uses": sum(b["type"] == "tool_use" for b in blocks), "turns": len(e.actions), "errors": sum(bool(b["is_error"]) for b in blocks)}
    trim = lambda o: {k: v for k, v in o.items() if v is not None}
    actions = [{"role": a["role"], "messages": [{"role": m["role"], "content": [trim(b) for b in m["content"]]} for m in a["messages"]]} for a in e.actions]
    return {
        "episode_id": e.episode_id, "step_count": e.steps, "game_setting": e.setting, "player_character": e.character, "actions": json.dumps(actions),
        "conversation_lines": lines, "transcript": "\n".join(lines), "metrics": json.dumps(counts), "metadata": json.dumps({"seed": e.seed, "generation_metrics": e.metrics}),
    }


def seeds(spark: SparkSession, n: int, salt: str = "episodes", themes: tuple[str, ...] = THEMES) -> DataFrame:
    """episode_id, theme, seed of n episodes; the same for the same salt."""
    d = spark.range(n).withColumnRenamed("id", "episode_id")
    return d.select("episode_id", choice(F.col("episode_id"), list(themes), salt).alias("theme"), F.pmod(F.xxhash64("episode_id", F.lit(salt)), F.lit(2**31)).alias("seed"))


def play(seed_rows: DataFrame, client: str = "hash", args: Args = Args(), steps: int = 3) -> DataFrame:
    """Each row played for a number of steps. A failing call is an action with finish_reason 'error', never a failed task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, own = client_of(client, args)
        for b in batches:
            rows = []
            for r in b.itertuples():
                e = Episode(int(r.episode_id), r.theme, int(r.seed))
                first_step(e, model, own)
                for _ in range(steps):
                    step(e, model, own)
                rows.append(formatted(e))
            if rows:
                yield pd.DataFrame(rows)

    return seed_rows.select("episode_id", "theme", "seed").mapInPandas(run, SCHEMA)


__all__ = ["Episode", "block", "first_step", "formatted", "play", "seeds", "seen_by", "step"]
