"""The Python front end on a small tree of sources."""

from millrace.lineage import stored
from millrace.operators import graph
from millrace.sources import python_code

FILES = [
    ("/p/app/main.py", "from util import helper\n\ndef main():\n    return process(1)\n\ndef process(x):\n    if x and x > 1 or x < 0:\n        for i in range(x):\n            if i:\n                pass\n    return helper(x)\n"),
    ("/p/app/util.py", "import os as system\n\nclass Box:\n    '''A box.'''\n    @property\n    def size(self):\n        'How big.'\n        return len(self.items)\n\n    async def fill(self, *xs, k=1, **rest):\n        return helper(k)\n\ndef helper(x):\n    return x\n\ndef alone():\n    return lonely()\n\ndef lonely():\n    return alone()\n\ndef unused():\n    pass\n"),
    ("/p/other/util.py", "def helper(y):\n    return y\n"),
    ("/p/bad.py", "def broken(:\n"),
    ("/p/none.py", None),
]


def test_relations_and_call_graph(spark):
    parsed = stored(python_code.modules(spark.createDataFrame(FILES, "path string, text string")))
    assert [r.path for r in parsed.where("error is not null").collect()] == ["/p/bad.py"]
    functions = {(r.file, r.qualified): r for r in python_code.relation(parsed, "functions").collect()}
    process = functions["/p/app/main.py", "process"]
    assert (process.cyclomatic, process.nesting, process.returns) == (6, 3, 1)
    fill = functions["/p/app/util.py", "Box.fill"]
    assert fill.is_async and fill.params == ["self", "xs", "k", "rest"] and fill.owner == "Box"
    assert functions["/p/app/util.py", "Box.size"].docstring == "How big." and functions["/p/app/util.py", "Box.size"].decorators == ["property"]
    imports = {(r.module, r.name, r.alias) for r in python_code.relation(parsed, "imports").collect()}
    assert imports == {("util", "helper", "helper"), ("os", None, "system")}

    edges = stored(python_code.call_edges(parsed))
    found = {(r.src, r.dst) for r in edges.collect()}
    assert ("/p/app/main.py::process", "/p/app/util.py::helper") in found and ("/p/app/main.py::main", "/p/app/main.py::process") in found
    affected = graph.reach(edges.select("src", "dst"), spark.createDataFrame([("/p/app/util.py::helper",)], "node string"), backward=True)
    assert {r.node.split("::")[1]: r.distance for r in affected.collect()} == {"helper": 0, "process": 1, "Box.fill": 1, "main": 2}
    dead = {r.node.split("::")[1]: r.reason for r in python_code.dead_functions(parsed, edges).where("node not like '%other%'").collect()}
    assert dead == {"Box.fill": "never_called", "alone": "only_by_dead", "lonely": "only_by_dead", "unused": "never_called"}


def test_parts_alone_and_in_slices(spark):
    """A part asked for alone is the same as with the others; rows leave Python by the size of texts, not by batches."""
    import pyarrow as pa

    text = "def f(a):\n    import os\n    if a:\n        def g():\n            return os.path.join(a, (lambda: a)())\n    class C:\n        def h(self):\n            try:\n                f(1)\n            except E:\n                pass\n"
    whole = python_code._extract(text)
    for part in ("functions", "imports", "calls"):
        assert python_code._extract(text, (part,))[part] == whole[part] and whole[part]
    assert [c["receiver"] for c in whole["calls"]] == ["os.path", None] and [f["qualified"] for f in whole["functions"]] == ["f", "f.g", "f.C.h"]
    batch = pa.RecordBatch.from_arrays([pa.array([f"{k}" for k in range(60)]), pa.array([text, None, "def (:"] * 20)], ["path", "text"])
    out = pa.Table.from_batches(list(python_code._modules([batch], ("functions",), 1000)))
    assert out["path"].to_pylist() == batch["path"].to_pylist() and len(out["path"].chunks) > 3 and out["path"].chunks[0].to_pylist() == ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12"]
    assert [x and len(x) for x in out["functions"].to_pylist()[:3]] == [3, [], []] and out["error"].null_count == 40
    plan = python_code.relation(python_code.modules(spark.createDataFrame([("m.py", text)], "path string, text string"), ("functions",)), "functions")._jdf.queryExecution().optimizedPlan().toString()
    assert "calls" not in plan and "imports" not in plan
