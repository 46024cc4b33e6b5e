"""Scalars taken out of text: fences, tags, answers, scores, notations. Column expressions unless said otherwise."""

from __future__ import annotations

import ast
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import stripped

all_of = lambda c, rx, g=1: F.regexp_extract_all(c, F.lit(rx), F.lit(g))


def code_fences(c: Column, language: str | None = None) -> Column:
    """Contents of fenced blocks, of one language or any."""
    tag = f"(?:{language})?" if language else "[A-Za-z0-9_+-]*"
    return all_of(c, rf"(?s)```{tag}\n(.*?)\n```")


def code_blocks(c: Column) -> Column:
    """Fenced blocks and <code> elements, one text; the marks are taken off as marks, not as a set of letters."""
    fences, tags = all_of(c, r"(?s)```[A-Za-z0-9_+-]*\n?(.*?)```"), all_of(c, r"(?s)<code>(.*?)</code>")
    return F.array_join(F.transform(F.concat(fences, tags), stripped), "\n")


def json_blocks(c: Column) -> Column:
    """Fenced JSON as variants; a block that is no JSON stays a text."""
    return F.transform(code_fences(c, "json"), lambda b: F.coalesce(F.try_parse_json(b), F.try_parse_json(F.to_json(F.struct(b.alias("text"))))))


def between_tags(c: Column, tag: str) -> Column:
    """Every content of a tag; one that is left open runs to the end."""
    return all_of(c, rf"(?s)<{tag}>(.*?)(?:</{tag}>|$)")


def last_in_tag(c: Column, tag: str) -> Column:
    return F.try_element_at(between_tags(c, tag), F.lit(-1))


def instruction_tags(c: Column) -> Column:
    """Tags inside <instruction> as a map; of equal names the last counts (session setting LAST_WIN)."""
    inside = F.regexp_extract(c, r"(?s)<instruction>(.*?)(?:</instruction>|$)", 1)
    rx = r"(?s)<(\w+)>\s*(.*?)\s*</\1>"
    return F.map_from_arrays(all_of(inside, rx, 1), all_of(inside, rx, 2))


def bullet_list(m: Column) -> Column:
    """The values of a map as lines with a dash."""
    return F.array_join(F.transform(F.map_values(m), lambda v: F.concat(F.lit("- "), v)), "\n")


def prefixed_lines(c: Column) -> Column:
    """Contents of User:, Task:, API:, Call:, Result: and Agent: lines that aren't empty."""
    return F.filter(all_of(c, r"(?i)(User:|Task:|API:|Call:|Result:|Agent:)\s*(.*)", 2), lambda x: x != "")


def tool_row(c: Column) -> Column:
    """question, tool_call, call_result and agent_output of a text with exactly four such lines, taken in that order; null for any other."""
    m = prefixed_lines(c)
    names = ("question", "tool_call", "call_result", "agent_output")
    return F.when(F.size(m) == 4, F.struct(*(F.try_element_at(m, F.lit(k + 1)).alias(n) for k, n in enumerate(names))))


def fiction_label(c: Column) -> Column:
    """1 for narrative fiction, 0 for anything else named, null without a label; what stands first counts."""
    found = F.lower(F.regexp_extract(c, "(?i)(not narrative fiction|narrative fiction)", 1))
    return F.when(found == "narrative fiction", 1).when(found != "", 0)


def judge_scores(c: Column, bracketed: bool = True) -> Column:
    """Scores by criterion from 'name: 7', 'name: Score 7' and 'name: [7]'; later ones win (session setting LAST_WIN)."""
    pair = lambda rx: F.map_from_arrays(F.transform(all_of(c, rx, 1), stripped), F.transform(all_of(c, rx, 2), lambda x: x.cast("double")))
    plain = pair(r"(?d)(.*?):\s*(?:Score\s+)?(-?[0-9]+(?:\.[0-9]+)?)")
    return F.map_concat(plain, pair(r"(?d)(.*?):\s*\[(-?[0-9]+(?:\.[0-9]+)?)\]")) if bracketed else plain


def xml_answer(c: Column) -> Column:
    """What stands between the last <answer> and the next </answer>; the whole text without tags."""
    return stripped(F.substring_index(F.substring_index(c, "<answer>", -1), "</answer>", 1))


def hash_answer(c: Column) -> Column:
    """What follows the first ####, without commas and dollar signs; null without it."""
    return F.when(c.contains("####"), F.translate(stripped(F.try_element_at(F.split(c, "####"), F.lit(2))), ",$", ""))


def groups(c: Column) -> Column:
    """Comma lists inside <group> tags."""
    return F.transform(all_of(c, r"(?s)<group>(.*?)</group>"), lambda g: F.filter(F.transform(F.split(g, ","), stripped), lambda x: x != ""))


def docstring(c: Column) -> Column:
    """The first triple-quoted text, empty without one."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r'(?s)"""(.*?)"""', 1), F.lit("")), F.regexp_extract(c, "(?s)'''(.*?)'''", 1))


def asserted_function(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\bassert\s+([a-zA-Z_]\w*)\s*\(", 1), F.lit(""))


def bookshelves(c: Column) -> Column:
    """'Category: value; value' as a map to arrays; entries without a colon go under Other."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), stripped), lambda x: x != "")
    pairs = F.transform(parts, lambda p: F.when(p.contains(":"), F.struct(stripped(F.substring_index(p, ":", 1)).alias("k"), stripped(F.regexp_replace(p, "^[^:]*:", "")).alias("v"))).otherwise(F.struct(F.lit("Other").alias("k"), p.alias("v"))))
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda x: x["k"] == k), lambda x: x["v"])))


def dice(c: Column) -> Column:
    """n, sides, modifier of a notation like 2d6+1; null for anything else."""
    rx = r"^([0-9]*)d([0-9]+)([+-][0-9]+)?$"
    s = stripped(c)
    at = lambda g, other: F.coalesce(F.nullif(F.regexp_extract(s, rx, g), F.lit("")).cast("int"), F.lit(other))
    return F.when(s.rlike(rx), F.struct(at(1, 1).alias("n"), at(2, 0).alias("sides"), at(3, 0).alias("modifier")))


def title_parts(c: Column) -> Column:
    """category, author and title of '[category] author -- title'; null where a text has another form."""
    rx = r"\[([^\]]+)\]\s+(.+?)\s+--\s+(\S+)"
    return F.when(c.rlike(rx), F.struct(*(F.regexp_extract(c, rx, k + 1).alias(n) for k, n in enumerate(("category", "author", "title")))))


def tool_input(c: Column) -> Column:
    """A tool's input: an object where the text is one, else the text."""
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.to_json(F.struct(c.alias("raw")))))


# --- in Python: grammars that no regular expression takes in -------------------------------------------------------


def xml_tags(text: str | None, required: list[str] | None = None) -> dict[str, str] | None:
    """Contents by tag name, from the first opening to the first closing tag (in any case), stripped; None if a required one is missing."""
    if text is None:
        return None
    low, out = text.lower(), {}
    for tag in dict.fromkeys(re.findall(r"<([A-Za-z_]\w*)>", text)):
        start, end = low.find(f"<{tag.lower()}>"), low.find(f"</{tag.lower()}>")
        if start >= 0 and end > start:
            out[tag] = text[start + len(tag) + 2 : end].strip()
    return None if any(r not in out for r in required or []) else out


def python_parses(text: str | None) -> bool:
    try:
        ast.parse(text or "")
        return bool(text and text.strip())
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def literal_map(text: str | None) -> dict[str, float] | None:
    """A map of numbers kept as text, in JSON or as a literal of Python; values that are no numbers are null."""
    for read in (json.loads, ast.literal_eval):
        try:
            m = read(text)
        except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
            continue
        if isinstance(m, str):
            return literal_map(m)
        if isinstance(m, dict):
            return {str(k): float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else number(v) for k, v in m.items()}
    return None


def number(v: object) -> float | None:
    try:
        return float(v) if isinstance(v, str) else None
    except ValueError:
        return None


def call_parts(text: str | None) -> tuple[str, list[str], dict[str, str]] | None:
    """Name, positional and keyword arguments (as JSON) of a call with constant arguments; None for anything else."""
    try:
        node = ast.parse((text or "").strip(), mode="eval").body
        if not isinstance(node, ast.Call) or not isinstance(node.func, ast.Name):
            return None
        return node.func.id, [json.dumps(ast.literal_eval(a)) for a in node.args], {k.arg: json.dumps(ast.literal_eval(k.value)) for k in node.keywords if k.arg}
    except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError):
        return None


def markdown_parts(text: str | None) -> tuple[list[str], str | None]:
    """List items (thoughts) and the first fenced block of a Markdown text; items inside the fence aren't items."""
    thoughts, code, inside = [], None, None
    for line in (text or "").split("\n"):
        if line.lstrip().startswith("```"):
            if inside is None:
                inside = []
            else:
                code, inside = code if code is not None else "\n".join(inside), None
        elif inside is not None:
            inside.append(line)
        elif m := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line):
            thoughts.append(m[1].strip())
        elif thoughts and line.startswith(("  ", "\t")) and line.strip():
            thoughts[-1] += " " + line.strip()
    return thoughts, code


def json_types(text: str | None) -> dict[str, str] | None:
    """Key to type name of a JSON object."""
    try:
        m = json.loads(text or "")
    except ValueError:
        return None
    return {k: type(v).__name__ for k, v in m.items()} if isinstance(m, dict) else None


xml_tags_udf = F.udf(xml_tags, T.MapType(T.StringType(), T.StringType()), useArrow=True)
python_parses_udf = F.udf(python_parses, T.BooleanType(), useArrow=True)
literal_map_udf = F.udf(literal_map, T.MapType(T.StringType(), T.DoubleType()), useArrow=True)
json_types_udf = F.udf(json_types, T.MapType(T.StringType(), T.StringType()), useArrow=True)
CALL = T.StructType().add("name", T.StringType()).add("args", T.ArrayType(T.StringType())).add("named", T.MapType(T.StringType(), T.StringType()))
call_parts_udf = F.udf(call_parts, CALL, useArrow=True)
markdown_parts_udf = F.udf(markdown_parts, T.StructType().add("thoughts", T.ArrayType(T.StringType())).add("code", T.StringType()))
