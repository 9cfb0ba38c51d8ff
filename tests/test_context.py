"""Contexts of entry points: order, depth, budget and the text."""

from millrace.operators import context

FILES = [("a.py", "def main():\n    b()\n    c()\n\ndef b():\n    d()"), ("z.py", "def c():\n    d()\n    main()\n\ndef d():\n    pass\n\ndef e():\n    pass")]
FUNCTIONS = [("a.py", "main", 1, 3), ("a.py", "b", 5, 6), ("z.py", "c", 1, 3), ("z.py", "d", 5, 6), ("z.py", "e", 8, 9)]
CALLS = [("a.py::main", "a.py::b"), ("a.py::main", "z.py::c"), ("a.py::b", "z.py::d"), ("z.py::c", "z.py::d"), ("z.py::c", "a.py::main")]


def test_contexts(spark):
    known = context.sources(spark.createDataFrame(FUNCTIONS, "file string, qualified string, start_line int, end_line int"), spark.createDataFrame(FILES, "path string, text string"))
    edges = spark.createDataFrame(CALLS, "src string, dst string")
    of = lambda nodes, **o: {r["entry"]: r for r in context.contexts(edges, spark.createDataFrame([(n,) for n in nodes], "node string"), known, **o).collect()}
    both = of(["a.py::main", "z.py::e", "no.py::such"], depth=2)
    assert set(both) == {"a.py::main", "z.py::e"}
    main = both["a.py::main"]
    assert (main["functions"], main["n"], main["lines"]) == (["a.py::b", "z.py::c", "z.py::d"], 3, 10)
    assert main["text"] == "# Entry: main (a.py:1-3)\ndef main():\n    b()\n    c()\n\n## Callees:\n\n### b (a.py:5-6)\ndef b():\n    d()\n\n### c (z.py:1-3)\ndef c():\n    d()\n    main()\n\n### d (z.py:5-6)\ndef d():\n    pass"
    assert both["z.py::e"]["text"] == "# Entry: e (z.py:8-9)\ndef e():\n    pass"
    assert of(["a.py::main"], depth=1)["a.py::main"]["functions"] == ["a.py::b", "z.py::c"]
    assert of(["a.py::main"], depth=2, budget=5)["a.py::main"]["functions"] == ["a.py::b"]
    assert of(["a.py::main"], depth=0, budget=1)["a.py::main"]["functions"] == []
