"""Every registered query against its SQL on the smallest tables."""

import datetime
import glob
import math
import os
import sys

import duckdb
import pytest

from millrace.plans import registry

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        connection.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if hasattr(value, "__float__"):
        return "nan" if math.isnan(float(value)) else f"{float(value):.4f}"
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, TABLES)
    want = db.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_operators(tmp_path):
    """The entry module and the rest of the library stand without ``llm`` and the pipeline."""
    import shutil
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and set(q) - set(e.oracle_sql()) == {'type3_clones'}"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_code_files(spark, tmp_path):
    from millrace.sources.tables import code_files

    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.rs").write_text("fn main() {}\n")
    (tmp_path / "src" / "node_modules" / "c.py").write_text("no\n")
    got = code_files(spark, str(tmp_path), ("py", "rs")).collect()
    assert sorted((r.language, r.text) for r in got) == [("python", "x = 1\n"), ("rust", "fn main() {}\n")]
