"""Tools that a model may call: dice, choice, speech, action, units, arithmetic. Chance comes from a seed, arithmetic from a parser, never from eval."""

from __future__ import annotations

import ast
import json
import operator
import random
import re
from typing import Any

DICE = re.compile(r"^(\d*)d(\d+)([+-]\d+)?$")

# Factors between units.
UNITS = {
    ("centimeters", "meters"): 0.01, ("feet", "inches"): 12, ("feet", "meters"): 0.3048, ("grams", "kilograms"): 0.001, ("inches", "feet"): 0.0833333,
    ("inches", "meters"): 0.0254, ("kilograms", "pounds"): 2.20462, ("kilometers", "meters"): 1000, ("meters", "centimeters"): 100, ("meters", "feet"): 3.28084,
    ("meters", "inches"): 39.3701, ("meters", "kilometers"): 0.001, ("ounces", "pounds"): 0.0625, ("pounds", "kilograms"): 0.453592, ("pounds", "ounces"): 16,
}
OPERATIONS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.USub: operator.neg, ast.UAdd: operator.pos}


def roll_dice(rng: random.Random, notation: str, reason: str = "") -> dict[str, Any]:
    m = DICE.match(notation.strip())
    if not m or int(m[2]) < 1 or int(m[1] or 1) > 1000:
        raise ValueError(f"Invalid dice notation: {notation}")
    rolls = [rng.randint(1, int(m[2])) for _ in range(int(m[1] or 1))]
    extra = int(m[3] or 0)
    return {"notation": notation, "reason": reason, "rolls": rolls, "modifier": extra, "total": sum(rolls) + extra}


def random_choice(rng: random.Random, options: list[str], reason: str = "") -> dict[str, Any]:
    if not options:
        raise ValueError("No options provided")
    k = rng.randrange(len(options))
    return {"reason": reason, "options": options, "chosen": options[k], "index": k}


def speak(rng: random.Random, character: str, message: str, tone: str | None = None) -> dict[str, Any]:
    return {"text": f'{character} says{f" ({tone})" if tone else ""}: "{message}"'}


def action(rng: random.Random, description: str, target: str | None = None) -> dict[str, Any]:
    return {"text": f"*{description}{f' ({target})' if target else ''}*"}


def convert_units(rng: random.Random, amount: float, from_unit: str, to_unit: str) -> dict[str, Any]:
    if (from_unit, to_unit) not in UNITS:
        raise ValueError(f"Conversion from {from_unit} to {to_unit} is not supported.")
    return {"amount": amount * UNITS[from_unit, to_unit], "unit": to_unit}


def calculate(expression: str) -> float:
    """A number from + - * / // % ** and brackets; powers and sizes are bounded."""

    def value(n: ast.AST) -> float:
        if isinstance(n, ast.Expression):
            return value(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return n.value
        if isinstance(n, ast.UnaryOp) and type(n.op) in OPERATIONS:
            return OPERATIONS[type(n.op)](value(n.operand))
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Pow):
            a, b = value(n.left), value(n.right)
            if abs(b) > 64 or abs(a) > 1e6:
                raise ValueError("power out of range")
            return a**b
        if isinstance(n, ast.BinOp) and type(n.op) in OPERATIONS:
            return OPERATIONS[type(n.op)](value(n.left), value(n.right))
        raise ValueError("not an arithmetic expression")

    if len(expression) > 500:
        raise ValueError("expression too long")
    return value(ast.parse(expression.strip(), mode="eval"))


def calculator(rng: random.Random, expression: str) -> dict[str, Any]:
    return {"result": calculate(expression)}


TOOLS = {f.__name__: f for f in (roll_dice, random_choice, speak, action, convert_units, calculator)}


def run_tool(name: str, given: str | dict[str, Any] | None, seed: str | int = 0) -> dict[str, Any]:
    """content (a text: JSON, or the words of speech and action) and is_error; what goes wrong is the content of an error."""
    try:
        args = json.loads(given) if isinstance(given, str) else given or {}
        out = TOOLS[name](random.Random(str(seed)), **args)
        return {"content": out["text"] if set(out) == {"text"} else json.dumps(out), "is_error": False}
    except KeyError as e:
        return {"content": f"Unknown tool: {e.args[0]}", "is_error": True}
    except Exception as e:  # noqa: BLE001  a bad call is the model's to see
        return {"content": f"{type(e).__name__}: {e}", "is_error": True}


def describe(name: str, text: str, parameters: dict[str, str], dropout: str = "none", order: list[str] | None = None) -> str:
    """A tool's description for a prompt; dropout leaves out 'description', 'types' or 'parameters', or gives 'json'; order rearranges parameters."""
    names = order or list(parameters)
    if dropout == "json":
        return json.dumps({"name": name, "description": text, "parameters": {p: parameters[p] for p in names}})
    args = "" if dropout == "parameters" else ", ".join(p if dropout == "types" else f"{p}: {parameters[p]}" for p in names)
    return f"{name}({args})" + ("" if dropout == "description" else f" - {text}")
