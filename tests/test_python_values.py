"""Value ranges of Python functions: random functions run under a trace, and what variables held must lie in the ranges."""

import random
import sys

from millrace.lineage import stored
from millrace.operators import dominance, intervals
from millrace.sources import python_flow, python_values


class Writer:
    """Random functions over whole numbers, with counted loops, early exits and handlers."""

    def __init__(self, seed):
        self.random, self.lines, self.loops = random.Random(seed), ["def f(a, b):", "    global shared", "    x = y = 0", "    z = 3"], 0
        self.block(1, self.random.randint(1, 3), False)
        self.lines.append("    return x")

    def block(self, level, size, loop):
        for _ in range(size):
            self.statement(level, loop)

    def statement(self, level, loop):
        r, (v, w) = self.random.random(), self.random.choices("xyzab", k=2)
        c = self.random.randint(-6, 12)
        put = lambda text, deeper=0: self.lines.append("    " * (level + deeper) + text)
        if level > 2 or r < 0.3:
            put(self.random.choice([f"{v} = {c}", f"{v} = {w} + {abs(c)}", f"{v} = {w} - {abs(c)}", f"{v} += {abs(c)}", f"{v} = {abs(c)} + {w}", f"{v} = {w} * 2", f"{v}, {w} = {w}, {v}", f"shared = {w}", f"{v} = len('abc')"]))
        elif r < 0.6:
            put(self.random.choice([f"if {v} < {c}:", f"if {v} >= {c} and {w} != 1:", f"if not ({v} == {c} or {w} > 4):", f"if {c} <= {v} < {c + 9}:", f"if {v}:", f"if {v} < (w := 2):"]))
            self.block(level + 1, 2, loop)
            if self.random.random() < 0.5:
                put("else:")
                self.block(level + 1, 1, loop)
        elif r < 0.75:
            self.loops += 1
            n = f"n{self.loops}"
            put(f"{n} = {self.random.randint(-3, 3)}")
            put(self.random.choice([f"while {n} < {abs(c)}:", f"while {n} <= {abs(c)} and {v} < 40:"]))
            put(f"{n} += {self.random.randint(1, 3)}", 1)
            self.block(level + 1, 2, True)
        elif r < 0.85:
            put(f"for {v} in " + self.random.choice([f"range({abs(c) % 5}):", f"range({c}, {c + 4}):", f"range({c + 6}, {c}, -2):", "(1, 5):"]))
            self.block(level + 1, 2, True)
        elif r < 0.92 and loop:
            put(f"if {v} > {c}:")
            put(self.random.choice(["break", "continue"]), 1)
        else:
            put("try:")
            self.block(level + 1, 1, loop)
            put(f"{v} = 6 // ({w} % 3)", 1)
            put("except ZeroDivisionError as e:")
            self.block(level + 1, 1, loop)
            put("finally:")
            put(f"{w} = 7", 1)


def held(text):
    """(line, {variable: value}) of a few runs, before each line is run."""
    space, seen = {"shared": 0}, []
    exec(compile(text, "<written>", "exec"), space)
    code = space["f"].__code__

    def trace(frame, event, arg):
        if frame.f_code is not code:
            return None
        if event == "line":
            seen.append((frame.f_lineno, dict(frame.f_locals)))
            if len(seen) % 3000 == 0:
                raise TimeoutError
        return trace

    for a, b in ((0, 0), (-7, 3), (30, -2), (2, 5)):
        sys.settrace(trace)
        try:
            space["f"](a, b)
        except TimeoutError:
            pass
        finally:
            sys.settrace(None)
    return seen


def ranges_of(spark, texts):
    """{(path, first line of a block): [{variable: (low, high)}]}"""
    parsed = stored(python_flow.flows(spark.createDataFrame([(k, t) for k, t in texts.items()], "path string, text string")))
    begins = {(r.func, r.block): r.line for r in sorted(python_flow.relation(parsed, "lines").collect(), key=lambda r: -r.nth)}
    blocks = {}
    for r in python_flow.value_ranges(parsed).collect():
        blocks.setdefault((r.func, r.block), {})[r.variable] = (r.low, r.high)
    out = {}
    for key, line in begins.items():
        out.setdefault((key[0].split("::")[0], line), []).append(blocks.get(key, {}))
    return out


def test_what_variables_held_lies_in_the_ranges(spark):
    texts = {f"{seed}": "\n".join(Writer(seed).lines) for seed in range(8)}
    got, met, bounded = ranges_of(spark, texts), 0, 0
    for path, text in texts.items():
        for line, values in held(text):
            found = got.get((path, line))
            if found is None:
                continue
            numbers = {v: n for v, n in values.items() if isinstance(n, int) and len(v) <= 2 and v not in ("e", "w")}
            assert any(all(v in block and block[v][0] <= n <= block[v][1] for v, n in numbers.items()) for block in found), (text, line, values, found)
            met += len(numbers)
            bounded += sum(all(abs(end) < intervals.INFINITY for end in found[0][v]) for v in numbers if v in found[0])
    assert met > 200 and bounded > met / 10


def test_exact_ranges(spark):
    text = "\n".join(["def f(a):", "    i = 0", "    while i < 1000:", "        i += 1", "        j = i", "        while j > 5:", "            j -= 1", "    if a > 3:", "        b = a", "        while True:", "            b = b + 1", "    return i"])
    got = ranges_of(spark, {"p": text, "broken": "def (:", "empty": "", "null": None})
    infinity = intervals.INFINITY
    assert got["p", 3][0]["i"] == (0, 1000) and got["p", 3][0]["a"] == (-infinity, infinity)
    assert got["p", 4][0]["i"] == (0, 999)
    # Above, j has no guard in the loop that changes it: its widened bound stays.
    assert got["p", 6][0]["i"] == (1, 1000) and got["p", 6][0]["j"] == (1, infinity)
    assert got["p", 7][0]["j"] == (6, infinity) and got["p", 8][0]["j"] == (1, 5)
    assert got["p", 9][0]["a"] == (4, infinity) and got["p", 11][0]["b"] == (4, infinity)
    assert {path for path, _ in got} == {"p"}


def test_conditions():
    import ast

    of = lambda text: sorted(python_values.guards(ast.parse(text, mode="eval").body), key=str)
    assert of("3 < x") == [("false", "x", None, 3), ("true", "x", 4, None)]
    assert of("x == 2") == [("true", "x", 2, 2)] and of("x != 2") == [("false", "x", 2, 2)]
    assert of("not (x < 1 or y >= 2)") == sorted([("true", "x", 1, None), ("true", "y", None, 1)], key=str)
    assert of("x < y") == of("x < 2.5") == of("x < (x := 3)") == of("f(x)") == []


def test_widening_points_lie_on_every_cycle(spark):
    """Random graphs, also such that no block dominates its cycle: without the points none is left."""
    r = random.Random(9)
    graphs = {f"g{k}": {(a, b) for a in range(8) for b in r.sample(range(8), r.randint(0, 2))} | {(0, 1 + k % 7)} for k in range(40)}
    graphs["irreducible"] = {(0, 1), (0, 2), (1, 2), (2, 1)}
    edges = stored(spark.createDataFrame([(g, a, b) for g, e in graphs.items() for a, b in e], "func string, src int, dst int"))
    entries = spark.createDataFrame([(g, 0) for g in graphs], "func string, block int")
    points = {(p.func, p.block) for p in dominance.widening_points(edges, dominance.dominators(edges, entries)).collect()}
    for g, e in graphs.items():
        live = {0}
        while more := {b for a, b in e if a in live} - live:
            live |= more
        left = {(a, b) for a, b in e if a in live and (g, a) not in points and (g, b) not in points}
        while ends := {b for _, b in left} - {a for a, _ in left}:
            left = {(a, b) for a, b in left if b not in ends}
        assert not left, (g, e)
