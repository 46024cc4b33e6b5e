"""A bounded interpreter for small programs of models: the tree of the program is walked step by step, never compiled or run.

Only listed statements, operators, builtins and methods of plain values exist; there are no imports, classes or attributes.
Steps, rounds of a while loop, the size of numbers and texts and the depth of calls are bounded. A name or key that is
nearly right is found (one close match), and names of tools can't be assigned.
"""

from __future__ import annotations

import ast
import json
import operator
from collections.abc import Callable
from difflib import get_close_matches
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T


class Stopped(Exception):
    """A program went beyond its bounds or used what there isn't."""


class Leave(Exception):
    def __init__(self, kind: str, value: Any = None):
        self.kind, self.value = kind, value


BINARY: dict[type, Callable] = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow, ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.BitXor: operator.xor}
UNARY: dict[type, Callable] = {ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Not: operator.not_, ast.Invert: operator.invert}
COMPARE: dict[type, Callable] = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b, ast.Is: operator.is_, ast.IsNot: operator.is_not}
BUILTINS: dict[str, Any] = {f.__name__: f for f in (abs, all, any, bool, dict, enumerate, float, int, len, list, max, min, reversed, round, set, sorted, str, sum, tuple, zip)}
METHODS = {
    str: frozenset("count endswith find index isalpha isdigit islower isupper join lower lstrip replace rstrip split splitlines startswith strip title upper".split()),
    list: frozenset("append count extend index insert pop remove reverse sort".split()),
    dict: frozenset("get items keys pop setdefault update values".split()),
    set: frozenset("add discard difference intersection union".split()),
    tuple: frozenset("count index".split()),
}


class Interpreter:
    def __init__(self, tools: dict[str, Callable] | None = None, steps: int = 100_000, rounds: int = 1000, size: int = 100_000, depth: int = 50):
        self.tools, self.left, self.rounds, self.size, self.depth = tools or {}, steps, rounds, size, depth
        self.printed: list[str] = []

    def run(self, program: str, names: dict[str, Any] | None = None) -> Any:
        """The value of the last statement that is an expression; None without one."""
        scope = [dict(names or {})]
        value = None
        for s in ast.parse(program).body:
            value = self.value(s.value, scope) if isinstance(s, ast.Expr) else self.act(s, scope)
        return value

    def step(self) -> None:
        self.left -= 1
        if self.left < 0:
            raise Stopped("too many steps")

    def bounded(self, v: Any) -> Any:
        if (isinstance(v, int) and v.bit_length() > 4096) or (isinstance(v, (str, list, tuple, dict, set)) and len(v) > self.size):
            raise Stopped("a value is too large")
        return v

    # --- statements ------------------------------------------------------------------------------------------------

    def block(self, body: list[ast.stmt], scope: list[dict]) -> None:
        for s in body:
            self.act(s, scope)

    def act(self, s: ast.stmt, scope: list[dict]) -> None:
        self.step()
        of = getattr(self, f"do_{type(s).__name__}", None)
        if of is None:
            raise Stopped(f"no {type(s).__name__} here")
        of(s, scope)

    def do_Expr(self, s, scope):
        self.value(s.value, scope)

    def do_Pass(self, s, scope):
        pass

    def do_Assign(self, s, scope):
        v = self.value(s.value, scope)
        for t in s.targets:
            self.assign(t, v, scope)

    def do_AnnAssign(self, s, scope):
        if s.value is not None:
            self.assign(s.target, self.value(s.value, scope), scope)

    def do_AugAssign(self, s, scope):
        self.assign(s.target, self.two(s.op, self.value(s.target, scope), self.value(s.value, scope)), scope)

    def do_If(self, s, scope):
        self.block(s.body if self.value(s.test, scope) else s.orelse, scope)

    def looped(self, s, scope) -> bool:
        """One round; False where the loop ends."""
        try:
            self.block(s.body, scope)
        except Leave as e:
            if e.kind == "return":
                raise
            return e.kind == "continue"
        return True

    def do_For(self, s, scope):
        for v in self.value(s.iter, scope):
            self.assign(s.target, v, scope)
            if not self.looped(s, scope):
                return
        self.block(s.orelse, scope)

    def do_While(self, s, scope):
        for _ in range(self.rounds):
            if not self.value(s.test, scope):
                return self.block(s.orelse, scope)
            if not self.looped(s, scope):
                return None
        raise Stopped("too many rounds")

    def do_Break(self, s, scope):
        raise Leave("break")

    def do_Continue(self, s, scope):
        raise Leave("continue")

    def do_Return(self, s, scope):
        raise Leave("return", None if s.value is None else self.value(s.value, scope))

    def do_FunctionDef(self, s, scope):
        names = [a.arg for a in s.args.args]
        defaults = [self.value(d, scope) for d in s.args.defaults]

        def call(*given, **named):
            if len(scope) >= self.depth or self.depth <= 0:
                raise Stopped("calls too deep")
            own = dict(zip(names[len(names) - len(defaults) :], defaults)) | dict(zip(names, given)) | named
            if set(own) != set(names) or len(given) > len(names):
                raise TypeError(f"{s.name} takes {', '.join(names) or 'nothing'}")
            self.depth -= 1
            try:
                self.block(s.body, [*scope, own])
            except Leave as e:
                return e.value
            finally:
                self.depth += 1

        self.assign(ast.Name(s.name), call, scope)

    def assign(self, t: ast.expr, v: Any, scope: list[dict]) -> None:
        if isinstance(t, ast.Name):
            if t.id in self.tools:
                raise Stopped(f"{t.id} is a tool")
            scope[-1][t.id] = self.bounded(v)
        elif isinstance(t, (ast.Tuple, ast.List)):
            values = list(v)
            if len(values) != len(t.elts):
                raise ValueError("not as many values as names")
            for x, y in zip(t.elts, values):
                self.assign(x, y, scope)
        elif isinstance(t, ast.Subscript):
            at = self.value(t.value, scope)
            at[self.value(t.slice, scope)] = v
            self.bounded(at)
        else:
            raise Stopped(f"no assignment to {type(t).__name__}")

    # --- expressions -----------------------------------------------------------------------------------------------

    def value(self, e: ast.expr, scope: list[dict]) -> Any:
        self.step()
        of = getattr(self, f"of_{type(e).__name__}", None)
        if of is None:
            raise Stopped(f"no {type(e).__name__} here")
        return self.bounded(of(e, scope))

    def of_Constant(self, e, scope):
        return e.value

    def of_Name(self, e, scope):
        for place in (*scope[::-1], self.tools, BUILTINS, {"print": self.say, "range": self.span}):
            if e.id in place:
                return place[e.id]
        near = get_close_matches(e.id, [k for place in scope for k in place] + list(self.tools), 1, 0.8)
        if not near:
            raise NameError(e.id)
        return self.of_Name(ast.Name(near[0]), scope)

    def say(self, *v) -> None:
        self.printed.append(" ".join(map(str, v)))

    def span(self, *v) -> range:
        r = range(*v)
        if len(r) > self.size:
            raise Stopped("a range is too long")
        return r

    def of_List(self, e, scope):
        return [self.value(x, scope) for x in e.elts]

    def of_Tuple(self, e, scope):
        return tuple(self.value(x, scope) for x in e.elts)

    def of_Set(self, e, scope):
        return {self.value(x, scope) for x in e.elts}

    def of_Dict(self, e, scope):
        return {self.value(k, scope): self.value(v, scope) for k, v in zip(e.keys, e.values)}

    def of_JoinedStr(self, e, scope):
        return "".join(x.value if isinstance(x, ast.Constant) else format(self.value(x.value, scope), "" if x.format_spec is None else self.value(x.format_spec, scope)[:12]) for x in e.values)

    def two(self, op: ast.operator, a: Any, b: Any) -> Any:
        if type(op) not in BINARY:
            raise Stopped(f"no {type(op).__name__} here")
        if isinstance(op, ast.Pow) and not (abs(b) <= 100 and abs(a) <= 10**6):
            raise Stopped("a power is too great")
        if isinstance(op, ast.Mult) and any(isinstance(x, (str, list, tuple)) and isinstance(y, int) and len(x) * y > self.size for x, y in ((a, b), (b, a))):
            raise Stopped("a value is too large")
        return BINARY[type(op)](a, b)

    def of_BinOp(self, e, scope):
        return self.two(e.op, self.value(e.left, scope), self.value(e.right, scope))

    def of_UnaryOp(self, e, scope):
        return UNARY[type(e.op)](self.value(e.operand, scope))

    def of_BoolOp(self, e, scope):
        stop = isinstance(e.op, ast.Or)
        v = None
        for x in e.values:
            v = self.value(x, scope)
            if bool(v) == stop:
                break
        return v

    def of_Compare(self, e, scope):
        a = self.value(e.left, scope)
        for op, right in zip(e.ops, e.comparators):
            b = self.value(right, scope)
            if not COMPARE[type(op)](a, b):
                return False
            a = b
        return True

    def of_IfExp(self, e, scope):
        return self.value(e.body if self.value(e.test, scope) else e.orelse, scope)

    def of_Slice(self, e, scope):
        return slice(*(None if x is None else self.value(x, scope) for x in (e.lower, e.upper, e.step)))

    def of_Subscript(self, e, scope):
        at, key = self.value(e.value, scope), self.value(e.slice, scope)
        if isinstance(at, dict) and key not in at and isinstance(key, str) and (near := get_close_matches(key, [k for k in at if isinstance(k, str)], 1, 0.8)):
            key = near[0]
        return at[key]

    def of_Call(self, e, scope):
        given = [x for a in e.args for x in (self.value(a.value, scope) if isinstance(a, ast.Starred) else [self.value(a, scope)])]
        named = {k.arg: self.value(k.value, scope) for k in e.keywords if k.arg}
        if isinstance(e.func, ast.Attribute):
            own = self.value(e.func.value, scope)
            if e.func.attr not in METHODS.get(type(own), ()):
                raise Stopped(f"no method {e.func.attr} of {type(own).__name__}")
            if e.func.attr == "replace" and (len(own) + 1) * len(given[1]) > self.size:
                raise Stopped("a value is too large")
            return getattr(own, e.func.attr)(*given, **named)
        of = self.value(e.func, scope)
        if not callable(of):
            raise TypeError("not a function")
        out = of(*given, **named)
        return list(out) if isinstance(out, (enumerate, reversed, zip)) else out

    def of_Lambda(self, e, scope):
        return lambda *v: self.value(e.body, [*scope, dict(zip([a.arg for a in e.args.args], v))])

    def comprehended(self, e, scope, of: Callable[[list[dict]], Any]) -> list:
        own: list = []

        def go(k: int, inner: list[dict]) -> None:
            if k == len(e.generators):
                own.append(of(inner))
                self.bounded(own)
                return
            g = e.generators[k]
            for v in self.value(g.iter, inner):
                self.step()
                self.assign(g.target, v, inner)
                if all(self.value(c, inner) for c in g.ifs):
                    go(k + 1, inner)

        go(0, [*scope, {}])
        return own

    def of_ListComp(self, e, scope):
        return self.comprehended(e, scope, lambda s: self.value(e.elt, s))

    of_GeneratorExp = of_ListComp

    def of_SetComp(self, e, scope):
        return set(self.of_ListComp(e, scope))

    def of_DictComp(self, e, scope):
        return dict(self.comprehended(e, scope, lambda s: (self.value(e.key, s), self.value(e.value, s))))


def interpret(program: str | None, tools: dict[str, Callable] | None = None, **bounds: int) -> dict[str, str | None]:
    """value (as JSON, else its text), printed and error of a program; a null one is an error like any other."""
    i = Interpreter(tools, **bounds)
    try:
        v = i.run(program or "")
        if program is None:
            raise Stopped("no program")
    except Exception as e:  # noqa: BLE001  whatever a program does is its own error
        return {"value": None, "printed": "\n".join(i.printed), "error": f"{type(e).__name__}: {e}"}
    try:
        text = None if v is None else json.dumps(v)
    except (TypeError, ValueError):
        text = str(v)
    return {"value": text, "printed": "\n".join(i.printed), "error": None}


INTERPRETED = T.StructType().add("value", T.StringType()).add("printed", T.StringType()).add("error", T.StringType())
interpret_udf = F.udf(lambda p: interpret(p), INTERPRETED, useArrow=True)
