"""Conversations as arrays of messages: conversion, merging, context, rendering, labels.

A message is a struct of role and content; content is a text, or an array of typed blocks where the name says blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import stripped

MESSAGE = "struct<role:string,content:string>"
CONVERSATION = f"array<{MESSAGE}>"

# Roles and reasons in other vocabularies.
CHAT_ROLES = {"USER": "user", "ASSISTANT": "assistant", "FUNCTION RESPONSE": "tool", "human": "user", "gpt": "assistant", "system": "system"}
FINISH = {"stop": "end_turn", "length": "max_tokens", "tool_calls": "tool_use", "function_call": "tool_use", "content_filter": "refusal"}


def lookup(c: Column, table: dict[str, str], other: Column | None = None) -> Column:
    """A code's name; codes that aren't listed keep their own or get `other`."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(m[c], c if other is None else other)


def finish_reason(c: Column) -> Column:
    return F.coalesce(lookup(c, FINISH), F.lit("end_turn"))


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def block_text(blocks: Column, sep: str = "\n") -> Column:
    """The text blocks that aren't empty, joined and stripped."""
    own = F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull() & (b["text"] != ""))
    return stripped(F.array_join(F.transform(own, lambda b: b["text"]), sep))


def flat_messages(blocks_of: Column) -> Column:
    """Messages of blocks as one array of role, type, text; position is that in the array."""
    return F.flatten(F.transform(blocks_of, lambda m: F.transform(F.coalesce(m["content"], F.array()), lambda b: F.struct(m["role"].alias("role"), b["type"].alias("type"), F.coalesce(b["text"], b["thinking"], b["input"]).alias("text")))))


def from_chat(chat: Column, system: Column | None = None) -> Column:
    """'USER: .. ASSISTANT: .. FUNCTION RESPONSE: ..' as messages, after the system prompt if there is one."""
    rx = r"(USER|ASSISTANT|FUNCTION RESPONSE): "
    roles = F.regexp_extract_all(chat, F.lit(rx), F.lit(1))
    parts = F.split(chat, rx)
    said = F.zip_with(roles, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda r, p: message(lookup(r, CHAT_ROLES), stripped(p)))
    if system is None:
        return said
    return F.concat(F.array(message("system", stripped(F.regexp_replace(system, "^SYSTEM: ", "")))), said)


def from_pairs(pairs: Column) -> Column:
    """Structs of from and value as messages."""
    return F.transform(pairs, lambda p: message(lookup(p["from"], CHAT_ROLES), p["value"]))


def merged(conv: Column, sep: str = "") -> Column:
    """Successive messages of one role as one, within an array."""
    step = lambda acc, m: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["role"] == m["role"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(message(m["role"], F.concat(F.try_element_at(acc, F.lit(-1))["content"], F.lit(sep), m["content"])))),
    ).otherwise(F.concat(acc, F.array(message(m["role"], m["content"]))))
    return F.aggregate(conv, F.array().cast(CONVERSATION), step)


def merge_turns(turns: DataFrame, key: str, order: list[str], role: str, text: str, sep: str = "") -> DataFrame:
    """Successive turns of one role as one, in the long form: key, run, role, text, n_turns, in the order of `order` (which must be total)."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = ((F.row_number().over(w) == 1) | ~F.col(role).eqNullSafe(F.lag(role).over(w))).cast("int")
    runs = turns.select(key, role, text, *[o for o in order if o not in (key, role, text)]).withColumn("_c", changed).withColumn("_n", F.row_number().over(w)).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.transform(F.array_sort(F.collect_list(F.struct("_n", text))), lambda x: x[text])
    return runs.groupBy(key, "run").agg(F.min(role).alias(role), F.array_join(said, sep).alias(text), F.count("*").alias("n_turns"))


def last_k(arr: Column, k: int) -> Column:
    """The last k entries; all of a shorter array."""
    return F.when(F.size(arr) > 0, F.slice(arr, -F.least(F.lit(k), F.size(arr)), k)).otherwise(arr)


def all_but_last(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, F.slice(arr, 1, F.greatest(F.size(arr) - 1, F.lit(0)))).otherwise(arr)


def last_of(conv: Column, role: str = "assistant") -> Column:
    return F.try_element_at(F.filter(conv, lambda m: m["role"] == role), F.lit(-1))


def without_system(conv: Column) -> Column:
    return F.filter(conv, lambda m: m["role"] != "system")


def system_of(conv: Column) -> Column:
    return F.filter(conv, lambda m: m["role"] == "system")


def perspective(conv: Column, own: str, k: int = 8, opening: str | None = None) -> Column:
    """What a role sees of the last k messages: its own as assistant, the others as user; an opening user turn first where its own comes first."""
    seen = F.transform(last_k(conv, k), lambda m: message(F.when(m["role"] == own, "assistant").otherwise("user"), m["content"]))
    return seen if opening is None else opened(seen, opening)


def tool_text(b: Column) -> Column:
    """A block as text: tool calls and results in tags, no thinking."""
    return (
        F.when(b["type"] == "text", b["text"])
        .when(b["type"] == "tool_use", F.concat(F.lit("<tool_call>"), F.to_json(F.struct(b["name"].alias("name"), b["input"].alias("input"))), F.lit("</tool_call>")))
        .when(b["type"] == "tool_result", F.concat(F.lit("<tool_result>"), F.coalesce(b["text"], b["input"], F.lit("")), F.lit("</tool_result>")))
    )


def block_perspective(conv: Column, own: str, k: int = 8, opening: str | None = None, sep: str = "\n") -> Column:
    """What a role sees of the last k messages of blocks (struct<role, content: array of blocks>), as messages of text.

    Its own messages are the assistant's, the others the user's, with their tool calls and results as tagged text; thinking
    is in neither. Messages without anything left are dropped; an opening user turn comes first where its own does.
    """
    said = lambda m: F.array_join(F.filter(F.transform(F.coalesce(m["content"], F.array()), tool_text), lambda t: t.isNotNull() & (t != "")), sep)
    seen = F.filter(F.transform(last_k(conv, k), lambda m: message(F.when(m["role"] == own, "assistant").otherwise("user"), said(m))), lambda m: m["content"] != "")
    return seen if opening is None else opened(seen, opening)


def opened(seen: Column, opening: str) -> Column:
    """A user turn first where an assistant's comes first or there is none."""
    return F.when(F.coalesce(F.try_element_at(seen, F.lit(1))["role"] == "assistant", F.lit(True)), F.concat(F.array(message("user", F.lit(opening))), seen)).otherwise(seen)


def block_transcript(conv: Column) -> Column:
    """'role: chunk chunk' lines of messages of blocks: texts as they are, a tool call as its tag with the name, results and thinking left out."""
    chunk = lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_use", F.concat(F.lit("<tool_use name="), b["name"], F.lit(">")))
    line = lambda m: F.concat(m["role"], F.lit(": "), F.array_join(F.filter(F.transform(F.coalesce(m["content"], F.array()), chunk), lambda t: t.isNotNull()), " "))
    return F.array_join(F.transform(conv, line), "\n")


def transcript(conv: Column) -> Column:
    """'role: text' lines."""
    return F.array_join(F.transform(conv, lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def triplet(chosen: Column, rejected: Column, system: str | None = None) -> list[Column]:
    """prompt (all but the last of chosen, after a default system message), chosen and rejected (the last assistant messages)."""
    prompt = all_but_last(chosen)
    if system is not None:
        prompt = F.concat(F.array(message("system", F.lit(system))), without_system(prompt))
    return [prompt.alias("prompt"), last_of(chosen)["content"].alias("chosen"), last_of(rejected)["content"].alias("rejected")]


def alternates(conv: Column) -> Column:
    """User and assistant take turns, the user first; a system message may precede."""
    return F.aggregate(without_system(conv), F.struct(F.lit(True).alias("ok"), F.lit("user").alias("due")), lambda a, m: F.struct((a["ok"] & (m["role"] == a["due"])).alias("ok"), F.when(a["due"] == "user", "assistant").otherwise("user").alias("due")))["ok"]


def render_im(conv: Column, default_system: str = "You are a helpful assistant.", prompt: bool = False) -> Column:
    """<|im_start|>role .. <|im_end|> for each message; a default system message where none comes first."""
    one = lambda r, c: F.concat(F.lit("<|im_start|>"), r, F.lit("\n"), c, F.lit("<|im_end|>\n"))
    first = F.when(F.coalesce(F.try_element_at(conv, F.lit(1))["role"] == "system", F.lit(False)), "").otherwise(one(F.lit("system"), F.lit(default_system)))
    out = F.concat(first, F.array_join(F.transform(conv, lambda m: one(m["role"], F.coalesce(m["content"], F.lit("")))), ""))
    return F.concat(out, F.lit("<|im_start|>assistant\n")) if prompt else out


def render_header(conv: Column, begin: str = "<|begin_of_text|>", prompt: bool = False) -> Column:
    """Role in header marks, a blank line, the stripped content, an end mark."""
    head = lambda r: F.concat(F.lit("<|start_header_id|>"), r, F.lit("<|end_header_id|>\n\n"))
    out = F.concat(F.lit(begin), F.array_join(F.transform(conv, lambda m: F.concat(head(m["role"]), stripped(F.coalesce(m["content"], F.lit(""))), F.lit("<|eot_id|>"))), ""))
    return F.concat(out, head(F.lit("assistant"))) if prompt else out


def render_inst(conv: Column, begin: str = "<s>", end: str = "</s>") -> Column:
    """[INST] user [/INST] assistant; the system message goes into the last message if that is a user's, and is lost otherwise."""
    own = F.coalesce(F.try_element_at(system_of(conv), F.lit(1))["content"], F.lit(""))
    rest = without_system(conv)
    one = F.transform(
        rest,
        lambda m, i: F.when(m["role"] == "user", F.concat(F.lit("[INST]"), F.when((i == F.size(rest) - 1) & (own != ""), F.concat(own, F.lit("\n\n"))).otherwise(""), m["content"], F.lit("[/INST]"))).otherwise(F.concat(F.coalesce(m["content"], F.lit("")), F.lit(end))),
    )
    return F.concat(F.lit(begin), F.array_join(one, ""))


def fixed_length(ids: Column, n: int, pad: int = 0) -> list[Column]:
    """input_ids and attention_mask of exactly n entries."""
    return [F.slice(F.concat(ids, F.array_repeat(F.lit(pad), n)), 1, n).alias("input_ids"), F.slice(F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), n)), 1, n).alias("attention_mask")]


def masked_labels(ids: Column, mask: Column, ignore: int = -100) -> Column:
    """The ids where the mask is 1, elsewhere the ignored label."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(F.lit(ignore)))


def prompt_masked(ids: Column, prompt_length: Column, n: int, ignore: int = -100) -> Column:
    """Labels of n entries that ignore the prompt and the padding."""
    own = F.transform(ids, lambda x, i: F.when(i < prompt_length, F.lit(ignore)).otherwise(x))
    return F.slice(F.concat(own, F.array_repeat(F.lit(ignore), n)), 1, n)


def word_masked(ids: Column, key: Column, mask_id: int, vocabulary: int, share: float = 0.15, ignore: int = -100) -> list[Column]:
    """input_ids and labels of masked-word training: of `share` of the places 8 in 10 are masked, 1 in 10 random, 1 in 10 kept; chosen by a hash of key and place."""
    draw = lambda i, salt: F.pmod(F.xxhash64(key, i, F.lit(salt)), F.lit(1000))
    hit = lambda i: draw(i, 1) < int(1000 * share)
    new = F.transform(ids, lambda x, i: F.when(~hit(i), x).when(draw(i, 2) < 800, F.lit(mask_id)).when(draw(i, 2) < 900, F.pmod(F.xxhash64(key, i, F.lit(3)), F.lit(vocabulary)).cast("int")).otherwise(x))
    return [new.alias("input_ids"), F.transform(ids, lambda x, i: F.when(hit(i), x).otherwise(F.lit(ignore))).alias("labels")]


def unpadded(ids: Column, pad: int = 0) -> Column:
    """Without the padding at the end."""
    kept = F.array_max(F.transform(ids, lambda x, i: F.when(x != pad, i + 1).otherwise(0)))
    return F.when(F.coalesce(kept, F.lit(0)) > 0, F.slice(ids, 1, kept)).otherwise(F.slice(ids, 1, 0))
