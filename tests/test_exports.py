"""Origins of names against Python's own import, and against a plain walk."""

import random
import sys

from millrace.operators import exports


def got(spark, definitions, imports):
    d = spark.createDataFrame(definitions, "module string, name string, line int")
    i = spark.createDataFrame(imports, "module string, source string, name string, alias string, line int")
    return {(r.module, r.name): (r.origin, r.origin_name) for r in exports.origins(d, i).collect()}


def test_origins_are_those_of_pythons_import(spark, tmp_path, monkeypatch):
    """Random packages without rings: each module imports from later ones; Python says where each function was defined."""
    random.seed(7)
    definitions, imports = [], []
    names = ["f", "g", "h", "_p"]
    for p in range(12):
        for k in range(5):
            module, lines = f"mr_pkg{p}_m{k}", []
            for line in range(1, random.randint(2, 5)):
                source = f"mr_pkg{p}_m{random.randint(k + 1, 5)}" if k < 4 else None
                if source and not source.endswith("m5") and random.random() < 0.3:
                    lines.append(f"from {source} import *")
                    imports.append((module, source, "*", None, line))
                    continue
                name = random.choice(names)
                lines.append(f"def {name}(): pass")
                definitions.append((module, name, line))
            lines.append("import os.path")
            (tmp_path / f"{module}.py").write_text("\n".join(lines) + "\n")
    # Named imports of what a module defines itself, under another name, as the last line.
    for p in range(12):
        source, name = f"mr_pkg{p}_m4", [d[1] for d in definitions if d[0] == f"mr_pkg{p}_m4"][0]
        with (tmp_path / f"mr_pkg{p}_m0.py").open("a") as f:
            f.write(f"from {source} import {name} as taken\n")
        imports.append((f"mr_pkg{p}_m0", source, name, "taken", 99))
    monkeypatch.syspath_prepend(str(tmp_path))
    want = {}
    for module in sorted({d[0] for d in definitions} | {i[0] for i in imports}):
        for name, value in vars(__import__(module)).items():
            if callable(value) and getattr(value, "__module__", "").startswith("mr_pkg"):
                want[module, name] = (value.__module__, value.__name__)
    for module in [m for m in sys.modules if m.startswith("mr_pkg")]:
        del sys.modules[module]
    assert got(spark, definitions, imports) == want
    assert sum(k[0] != v[0] for k, v in want.items()) > 20


def test_rings_and_sources_outside(spark):
    definitions = [("a", "x", 5), ("b", "y", 1)]
    imports = [("a", "b", "*", None, 1), ("b", "a", "*", None, 2), ("c", "d", "n", None, 1), ("d", "c", "n", None, 1), ("a", "numpy", "array", "arr", 9)]
    want = {("a", "x"): ("a", "x"), ("a", "y"): ("b", "y"), ("a", "arr"): ("numpy", "array"), ("b", "x"): ("a", "x"), ("b", "arr"): ("numpy", "array")}
    # In b the star comes after y and brings y, which is b's own through a: a ring, so no origin there, and none for a's.
    found = got(spark, definitions, imports)
    assert {k: v for k, v in found.items() if k[1] != "y"} == {k: v for k, v in want.items() if k[1] != "y"}
    assert ("c", "n") not in found and ("b", "y") not in found
