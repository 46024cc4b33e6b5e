"""The bounded interpreter: what it runs, what it refuses, where it stops."""

from __future__ import annotations

import pytest

from tessera.functions.interpreter import interpret


@pytest.mark.parametrize(
    ("program", "value"),
    [
        ("1 + 2 * 3", "7"), ("x = 3\nx **= 2\nx", "9"), ("[k * k for k in range(5) if k % 2]", "[1, 9]"), ("def f(n, m=2):\n    return 1 if n < 2 else n * f(n - 1)\nf(5)", "120"),
        ("a, (b, c) = 1, (2, 3)\n{'s': a + b + c}", '{"s": 6}'), ("n = 0\nwhile True:\n    n += 1\n    if n > 4:\n        break\nn", "5"), ("'a-b'.split('-')", '["a", "b"]'), ("sorted({'b': 1, 'a': 2})", '["a", "b"]'),
        ("f'{3:03d}!'", '"003!"'), ("sum(x for x in (1, 2, 3))", "6"), ("out = []\nfor i, c in enumerate('ab'):\n    out.append((i, c))\nout", '[[0, "a"], [1, "b"]]'), ("max([3, 1], key=lambda v: -v)", "1"), ("x = [1, 2, 3]\nx[1:] = [9]\nx", "[1, 9]"), ("1 < 2 < 3 and not 0", "true"), ("pass", None),
    ],
)
def test_values(program, value):
    assert interpret(program) == {"value": value, "printed": "", "error": None}


@pytest.mark.parametrize(
    ("program", "error"),
    [
        ("import os", "Stopped: no Import here"), ("().__class__", "Stopped: no Attribute here"), ("''.__class__()", "Stopped: no method"), ("open('x')", "NameError: open"), ("while True:\n    pass", "Stopped: too many rounds"), ("9 ** 9 ** 9", "Stopped: a power"), ("'x' * 10**9", "Stopped: a value is too large"),
        ("for i in range(10**9):\n    pass", "Stopped: a range"), ("def f():\n    return f()\nf()", "Stopped: calls too deep"), ("[a for a in range(1000) for b in range(1000)]", "Stopped: too many steps"), ("speak = 1", "Stopped: speak is a tool"), ("class A:\n    pass", "Stopped: no ClassDef here"), ("1 / 0", "ZeroDivisionError"), (None, "Stopped: no program"), ("x = = 1", "SyntaxError"), ("x = [1]\nx.extend(x * 90000)\nx * 2", "Stopped: a value is too large"),
    ],
)
def test_bounds(program, error):
    assert interpret(program, {"speak": print})["error"].startswith(error)


def test_tools_and_near_names():
    said = []
    r = interpret("total_price = 4\nspeek(totl_price)\nprint('done', {'colour': 1}['color'])", {"speak": said.append})
    assert r["error"] is None and said == [4] and r["printed"] == "done 1"
