"""Reports on a small source tree."""

from millrace.lineage import stored
from millrace.operators import code_metrics
from millrace.sources import python_code

BRANCHY = "def branchy(a, b, c, d, e, f):\n" + "".join(f"    if a == {i}:\n        return {i}\n" for i in range(12)) + "    return 0\n"
FILES = [
    ("/p/a.py", BRANCHY + "\n# note\ndef plain():\n    'Says.'\n    return branchy(1, 2, 3, 4, 5, 6)\n"),
    ("/p/test_a.py", "from a import plain\n\nclass TestA:\n    def test_good(self):\n        assert plain() == 1\n\n    def test_weak(self):\n        plain()\n\n    def test_called(self):\n        self.assertEqual(plain(), 1)\n"),
]


def test_reports(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    parsed = stored(python_code.modules(files))
    functions, calls = python_code.relation(parsed, "functions"), python_code.relation(parsed, "calls")
    report = {r.name: r for r in code_metrics.function_report(functions).collect()}
    assert report["branchy"].cyclomatic == 13 and report["branchy"].risk == "medium" and report["branchy"].issues == ["complex", "many_parameters", "many_returns"]
    assert report["plain"].issues == [] and report["test_good"].n_params == 0
    lines = {r.path: r for r in code_metrics.file_report(functions, files).collect()}
    a = lines["/p/a.py"]
    assert (a.physical, a.blank, a.comment, a.functions, a.most_complex, a.issues) == (32, 2, 1, 2, 13, 3)
    assert [(r.owner, r.methods, r.god) for r in code_metrics.class_report(functions).collect()] == [("TestA", 3, False)]
    docs = {(r.file, r.kind): (r.documented, r.total) for r in code_metrics.documentation(functions).collect()}
    assert docs == {("/p/a.py", "function"): (1, 2), ("/p/test_a.py", "method"): (0, 3)}
    tests = {r.test: (r.assertions, r.weak) for r in code_metrics.weak_tests(functions, calls, files).collect()}
    assert tests == {"TestA.test_good": (1, False), "TestA.test_weak": (0, True), "TestA.test_called": (1, False)}
    coupling = {r.module: (r.ce, r.ca) for r in code_metrics.file_coupling(python_code.call_edges(parsed)).collect()}
    assert coupling == {"/p/test_a.py": (1, 0), "/p/a.py": (0, 1)}
