"""Running and testing code from text: each piece in its own process with limits on time, memory and files, never in the worker."""

from __future__ import annotations

import ast
import json
import os
import re
import resource
import subprocess
import sys
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT_S, LIMIT_MB = 2.0, 256
RUN = T.StructType().add("ok", T.BooleanType()).add("stdout", T.StringType()).add("error", T.StringType())
TESTED = T.StructType().add("results", T.ArrayType(T.BooleanType())).add("passed", T.IntegerType()).add("total", T.IntegerType()).add("error", T.StringType())


def _limits(seconds: float, mb: int):
    def set_limits() -> None:
        resource.setrlimit(resource.RLIMIT_CPU, (int(seconds) + 1, int(seconds) + 1))
        resource.setrlimit(resource.RLIMIT_AS, (mb << 20, mb << 20))
        resource.setrlimit(resource.RLIMIT_FSIZE, (1 << 20, 1 << 20))
        resource.setrlimit(resource.RLIMIT_NOFILE, (32, 32))
        os.setsid()

    return set_limits


def run_code(code: str | None, stdin: str = "", seconds: float = LIMIT_S, mb: int = LIMIT_MB) -> dict:
    """ok, stdout, error of a program; isolated mode, an empty environment and an empty folder. This bounds accidents, it is no prison: untrusted code belongs in a container."""
    if not code or not code.strip():
        return {"ok": False, "stdout": "", "error": "empty"}
    with tempfile.TemporaryDirectory() as folder:
        try:
            p = subprocess.run([sys.executable, "-I", "-S", "-c", code], input=stdin, capture_output=True, text=True, timeout=seconds, cwd=folder, env={}, preexec_fn=_limits(seconds, mb))
        except subprocess.TimeoutExpired:
            return {"ok": False, "stdout": "", "error": "timeout"}
        return {"ok": p.returncode == 0, "stdout": p.stdout, "error": None if p.returncode == 0 else (p.stderr.strip().splitlines() or ["killed"])[-1]}


def asserts_as_list(tests: str) -> str:
    """Tests whose asserts are gathered as a list of booleans `_results`, in the order they run; METADATA assignments are dropped."""
    tree = ast.parse(tests)

    class Gather(ast.NodeTransformer):
        def visit_Assert(self, node: ast.Assert) -> ast.AST:
            holds = ast.Lambda(args=ast.arguments(posonlyargs=[], args=[], kwonlyargs=[], kw_defaults=[], defaults=[]), body=node.test)
            return ast.Expr(ast.Call(ast.Name("_check", ast.Load()), [holds], []))

        def visit_Assign(self, node: ast.Assign) -> ast.AST | None:
            return None if any(isinstance(t, ast.Name) and t.id == "METADATA" for t in node.targets) else node

    return ast.unparse(ast.fix_missing_locations(Gather().visit(tree)))


def run_tests(code: str | None, tests: str | None, entry_point: str | None = None, seconds: float = LIMIT_S) -> dict:
    """Which asserts hold: results, passed, total, error."""
    try:
        gathered = asserts_as_list(tests or "")
    except SyntaxError as e:
        return {"results": [], "passed": 0, "total": 0, "error": f"tests: {e.msg}"}
    call = f"\ncheck({entry_point})" if entry_point and "def check(" in gathered else ""
    head = "_results = []\ndef _check(f):\n    try:\n        _results.append(bool(f()))\n    except Exception:\n        _results.append(False)\n"
    # results are written whatever happens, after a mark that the code can't know
    mark = f"<<{os.urandom(8).hex()}>>"
    program = f"{head}\ntry:\n    exec({code or ''!r}, globals())\n    exec({gathered + call!r}, globals())\n    _error = None\nexcept BaseException as e:\n    _error = type(e).__name__ + ': ' + str(e)\nimport json\nprint({mark!r} + json.dumps([_results, _error]))"
    r = run_code(program, seconds=seconds)
    _, found, tail = (r["stdout"] or "").rpartition(mark)
    if not found:
        return {"results": [], "passed": 0, "total": 0, "error": r["error"]}
    results, error = json.loads(tail)
    return {"results": results, "passed": sum(results), "total": len(results), "error": error}


def run_cases(code: str | None, inputs: list[str] | None, outputs: list[str] | None, seconds: float = LIMIT_S) -> list[bool]:
    """For each input whether the program prints the expected lines; of different numbers of lines none counts."""
    out = []
    for given, want in zip(inputs or [], outputs or []):
        got = run_code(code, given, seconds)["stdout"].strip().splitlines()
        lines = (want or "").strip().splitlines()
        out.append(len(got) == len(lines) and all(a.strip() == b.strip() for a, b in zip(got, lines)))
    return out


def best_snippet(answer: str | None) -> str | None:
    """The last fenced block, else the <solution>, else the whole answer if it is Python."""
    blocks = re.findall(r"```(?:python)?\n(.*?)\n```", answer or "", re.S)
    if blocks:
        return blocks[-1]
    if m := re.search(r"<solution>(.*?)(?:</solution>|$)", answer or "", re.S):
        return m[1].strip()
    try:
        ast.parse(answer or "")
        return answer
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def as_function_task(prompt: str, code: str, tests: list[str]) -> dict[str, str | None]:
    """A task given by asserts in the form of prompt, solution, entry point and a check function."""
    name = next((m[1] for t in tests if (m := re.search(r"\bassert\s+([a-zA-Z_]\w*)\s*\(", t))), None)
    body = "\n".join("    " + (re.sub(rf"\b{name}\b", "candidate", t) if name else t) for t in tests)
    return {"prompt": prompt, "canonical_solution": code, "entry_point": name, "test": f"def check(candidate):\n{body or '    pass'}"}


run_code_udf = F.udf(lambda c: run_code(c), RUN)
run_tests_udf = F.udf(lambda c, t, e: run_tests(c, t, e), TESTED)
run_cases_udf = F.udf(lambda c, i, o: run_cases(c, i, o), T.ArrayType(T.BooleanType()))
best_snippet_udf = F.udf(best_snippet, T.StringType(), useArrow=True)
