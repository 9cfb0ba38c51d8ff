"""Python source as relations: functions, imports and calls, and the call graph resolved by joins.

Parsing is the one per-file step, a small helper over the standard ``ast``
module under ``mapInArrow``; everything after it is joins and aggregates.
Files that do not parse give no rows but an ``error``.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import graph
from millrace.sources.python_flow import SLICE, statements, text_slices

_KINDS = {"string": (T.StringType(), pa.string()), "int": (T.IntegerType(), pa.int32()), "boolean": (T.BooleanType(), pa.bool_()), "strings": (T.ArrayType(T.StringType()), pa.list_(pa.string()))}
_FUNCTION = {"name": "string", "qualified": "string", "owner": "string", "is_async": "boolean", "params": "strings", "decorators": "strings", "docstring": "string", "start_line": "int", "end_line": "int", "cyclomatic": "int", "cognitive": "int", "nesting": "int", "returns": "int"}
_IMPORT = {"module": "string", "name": "string", "alias": "string", "level": "int", "line": "int"}
_CALL = {"caller": "string", "target": "string", "receiver": "string", "line": "int"}
_PARTS = {"functions": _FUNCTION, "imports": _IMPORT, "calls": _CALL}

_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case, ast.Assert)
_DEEPER = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


#: Nodes in which no definition, call or branch stands.
_LEAVES = frozenset({ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del, ast.Pass, ast.Break, ast.Continue, ast.arg, ast.alias, ast.Global, ast.Nonlocal, *ast.operator.__subclasses__(), *ast.unaryop.__subclasses__(), *ast.cmpop.__subclasses__(), *ast.boolop.__subclasses__()})


def _measures(node: ast.AST) -> dict:
    """Measures of what stands in a function, nested definitions left out."""
    cyclomatic, cognitive, nesting, returns, todo = 1, 0, 0, 0, [(node, 0)]
    while todo:
        at, depth = todo.pop()
        for x in ast.iter_child_nodes(at):
            if type(x) in _LEAVES or isinstance(x, _SCOPES):
                continue
            chained = isinstance(at, ast.If) and isinstance(x, ast.If) and x in at.orelse
            inner = depth + (isinstance(x, _DEEPER) and not chained)
            nesting = max(nesting, inner)
            returns += isinstance(x, ast.Return)
            cyclomatic += isinstance(x, _BRANCHES) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0)
            if isinstance(x, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Match)):
                cognitive += 1 + max(0, inner - 1)
            cognitive += isinstance(x, ast.BoolOp)
            todo.append((x, inner))
    return {"cyclomatic": cyclomatic, "cognitive": cognitive, "nesting": nesting, "returns": returns}


def _extract(text: str, parts: tuple[str, ...] = tuple(_PARTS)) -> dict:
    """The rows of ``parts``. Functions and imports are statements, so expressions are visited for calls only."""
    out: dict = {"functions": [], "imports": [], "calls": [], "error": None}
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as fault:
        return out | {"error": str(fault)}
    inside = ast.iter_child_nodes if "calls" in parts else statements

    def walk(node: ast.AST, path: tuple[str, ...], owner: str | None, caller: str) -> None:
        for child in inside(node):
            if type(child) in _LEAVES:
                continue
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = ".".join((*path, child.name))
                if "functions" in parts:
                    a = child.args
                    params = [p.arg for p in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))]
                    out["functions"].append({"name": child.name, "qualified": name, "owner": owner, "is_async": isinstance(child, ast.AsyncFunctionDef), "params": params, "decorators": [ast.unparse(d) for d in child.decorator_list], "docstring": ast.get_docstring(child), "start_line": child.lineno, "end_line": child.end_lineno, **_measures(child)})
                walk(child, (*path, child.name), owner, name)
            elif isinstance(child, ast.ClassDef):
                walk(child, (*path, child.name), child.name, caller)
            else:
                if isinstance(child, ast.Import):
                    out["imports"] += [{"module": n.name, "name": None, "alias": n.asname or n.name.split(".")[0], "level": 0, "line": child.lineno} for n in child.names]
                elif isinstance(child, ast.ImportFrom):
                    out["imports"] += [{"module": child.module or "", "name": n.name, "alias": n.asname or n.name, "level": child.level, "line": child.lineno} for n in child.names]
                elif isinstance(child, ast.Call):
                    f = child.func
                    if isinstance(f, ast.Name):
                        out["calls"].append({"caller": caller, "target": f.id, "receiver": None, "line": child.lineno})
                    elif isinstance(f, ast.Attribute):
                        out["calls"].append({"caller": caller, "target": f.attr, "receiver": f.value.id if isinstance(f.value, ast.Name) else ast.unparse(f.value), "line": child.lineno})
                walk(child, path, owner, caller)

    walk(tree, (), None, "<module>")
    return out


def _modules(batches, parts: tuple[str, ...], size: int):
    arrow = {k: pa.list_(pa.struct([(n, _KINDS[t][1]) for n, t in _PARTS[k].items()])) for k in parts}
    for batch in batches:
        for paths, texts in text_slices(batch, size):
            found = [_extract(t or "", parts) for t in texts]
            columns = [pa.array([f[k] for f in found], t) for k, t in arrow.items()]
            yield pa.RecordBatch.from_arrays([paths, *columns, pa.array([f["error"] for f in found], pa.string())], ["path", *parts, "error"])


def modules(files: DataFrame, parts: tuple[str, ...] = tuple(_PARTS)) -> DataFrame:
    """(path, *parts, error) of (path, text), rows given out after each ``python_flow.SLICE`` bytes of texts; ``parts`` as in ``relation``, all by default. Write it before deriving several relations."""
    spark_type = lambda f: T.ArrayType(T.StructType([T.StructField(n, _KINDS[t][0]) for n, t in f.items()]))
    schema = T.StructType([T.StructField("path", T.StringType()), *(T.StructField(k, spark_type(_PARTS[k])) for k in parts), T.StructField("error", T.StringType())])
    return files.select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(lambda batches: _modules(batches, parts, SLICE), schema)


def relation(parsed: DataFrame, name: str) -> DataFrame:
    """One of ``functions``, ``imports``, ``calls`` as rows with their file."""
    return parsed.select(F.col("path").alias("file"), F.inline(name))


def _directory(column: str):
    return F.regexp_replace(column, "[^/]*$", "")


def call_edges(parsed: DataFrame) -> DataFrame:
    """(src, dst, line): calls with the best function of that name; nodes are file::qualified.

    A candidate scores 100 if its module is imported by the caller's file or is
    that file, 50 in the same folder, 25 under the same first folder; the best
    wins, of equals the first file, then the first name. Names given by ``import
    ... as`` are taken back first. Calls without a candidate have no edge.
    """
    functions, calls, imports = (relation(parsed, n) for n in ("functions", "calls", "imports"))
    seen = imports.select(F.col("file").alias("by"), F.element_at(F.split("module", r"\."), -1).alias("module")).distinct()
    renamed = imports.where("name is not null and alias <> name").groupBy("file", F.col("alias").alias("target")).agg(F.min("name").alias("named"))
    sites = calls.join(renamed, ["file", "target"], "left").select("file", "caller", F.coalesce("named", "target").alias("target"), "line").distinct()
    candidates = functions.select(F.col("name").alias("target"), F.col("file").alias("at"), "qualified", F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1).alias("stem"))
    met = sites.join(candidates, "target").join(seen, (F.col("by") == F.col("file")) & (F.col("module") == F.col("stem")), "left")
    score = F.when((F.col("at") == F.col("file")) | F.col("module").isNotNull(), 100).otherwise(0) + F.when(_directory("at") == _directory("file"), 50).otherwise(0) + F.when(F.split("at", "/")[1] == F.split("file", "/")[1], 25).otherwise(0)
    w = Window.partitionBy("file", "caller", "target", "line").orderBy(F.col("score").desc(), "at", "qualified")
    best = met.withColumn("score", score).withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return best.select(F.concat_ws("::", "file", "caller").alias("src"), F.concat_ws("::", "at", "qualified").alias("dst"), "line")


def dead_functions(parsed: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, reason) of functions that no entry point reaches; entry points are module code, main, tests and decorated functions."""
    functions = relation(parsed, "functions").withColumn("node", F.concat_ws("::", "file", "qualified"))
    entry = F.rlike("name", F.lit("^(main|test_.*|__.*__)$")) | (F.size("decorators") > 0)
    seeds = functions.where(entry).select("node").unionByName(edges.where(F.col("src").endswith("::<module>")).select(F.col("src").alias("node")))
    dead = functions.join(graph.reach(edges.select("src", "dst"), seeds).select("node"), "node", "left_anti")
    called = edges.where("src != dst").select(F.col("dst").alias("node")).distinct().withColumn("called", F.lit(True))
    return dead.join(called, "node", "left").select("node", F.when(F.col("called"), "only_by_dead").otherwise("never_called").alias("reason"))
