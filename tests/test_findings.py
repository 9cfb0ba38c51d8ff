"""Findings on small sources: rules, suppression, deduplication, gates, sinks."""

import json

from millrace.lineage import stored
from millrace.operators import findings
from millrace.sources import python_code

TEXT = """import os, pickle, hashlib
password = "abcdefgh1"
def run(x):
    os.system(x)
    eval(x)  # nosec
    # noqa: PY-MD5
    hashlib.md5(x)
    pickle.loads(x)  # nosec: PY-EVAL
    json.loads(x)
"""


def test_findings(spark):
    files = spark.createDataFrame([("a.py", TEXT), ("b.py", "x = 1\n"), ("c.py", None)], "path string, text string")
    calls = python_code.relation(stored(python_code.modules(files)), "calls")
    found = findings.call_findings(calls).unionByName(findings.line_findings(files))
    marked = findings.suppressed(found, findings.markers(files)).collect()
    assert {(r.rule, r.line): r.suppressed for r in marked} == {("TXT-SECRET", 2): False, ("PY-SYSTEM", 4): False, ("PY-EVAL", 5): True, ("PY-MD5", 7): True, ("PY-PICKLE", 8): False}
    kept = spark.createDataFrame(marked).where("not suppressed").drop("suppressed")
    assert findings.deduplicated(kept.unionByName(kept)).count() == 3
    total = findings.summary(kept).where("category is null and severity is null").first()
    assert (total.n, total.files) == (3, 1)
    assert findings.gate(kept, {4: 3}).first().passed and findings.gate(kept, {4: 2}).first().reasons == ["3 critical"]
    result = json.loads(findings.sarif_results(kept.where("rule = 'PY-SYSTEM'")).first().value)
    assert result["level"] == "error" and result["locations"][0]["physicalLocation"]["region"]["startLine"] == 4


def test_mermaid(spark):
    edges = spark.createDataFrame([("f", 0, 1, None), ("f", 1, 2, "true")], "func string, src int, dst int, label string")
    assert findings.mermaid(edges, "func").first().value == "flowchart TD\n    0 --> 1\n    1 -->|true| 2"
