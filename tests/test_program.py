"""Slices, chops, integrity, constants and chunks on hand-built functions."""

from millrace.operators import chunks, program

DFG = [("x", 1, 2), ("x", 1, 4), ("y", 2, 3), ("z", 3, 4), ("w", 4, 5)]


def dfg(spark):
    return spark.createDataFrame([(f, v, a, b) for f in ("f", "g") for v, a, b in DFG], "func string, variable string, from_line int, to_line int")


def at(spark, *lines):
    return spark.createDataFrame([("f", n) for n in lines], "func string, line int")


def lines(df):
    assert {r.func for r in df.collect()} <= {"f"}
    return sorted(r.line for r in df.collect())


def test_slices_and_chops(spark):
    d = dfg(spark)
    assert lines(program.slices(d, at(spark, 3))) == [1, 2, 3]
    assert lines(program.slices(d, at(spark, 3), backward=False)) == [3, 4, 5]
    assert lines(program.slices(d, at(spark, 4), variable="x")) == [1, 4]
    assert lines(program.slices(d, at(spark, 99))) == []
    assert lines(program.chops(d, at(spark, 1), at(spark, 5))) == [1, 2, 3, 4, 5]
    assert lines(program.chops(d, at(spark, 2), at(spark, 4))) == [2, 3, 4]
    assert lines(program.chops(d, at(spark, 1), at(spark, 4), "x")) == [1, 4]
    cdg = spark.createDataFrame([("f", 7, 2)], "func string, from_line int, to_line int")
    assert lines(program.slices(d, at(spark, 3), cdg=cdg)) == [1, 2, 3, 7]


def test_blocks(spark):
    blocks = spark.createDataFrame([("f", 0, "entry", 1, 2), ("f", 1, "body", 3, 200), ("f", 2, "body", 201, 202), ("f", 3, "exit", 203, 203), ("f", 9, "body", 300, 301)], "func string, block int, block_type string, start_line int, end_line int")
    edges = spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("f", 2, 1), ("f", 1, 3), ("f", 3, 77)], "func string, src int, dst int")
    assert [(r.src, r.dst) for r in program.invalid_edges(blocks, edges).collect()] == [(3, 77)]
    good = edges.where("dst != 77")
    assert program.cyclomatic(blocks.where("block != 9"), good).first().complexity == 2
    assert [r.block for r in program.unreachable_blocks(blocks, good).collect()] == [9]
    assert {r.line: r.block for r in program.block_for_line(blocks, at(spark, 1, 150, 202, 250)).collect()} == {1: 0, 150: 1, 202: 2}


def test_constants(spark):
    edges = spark.createDataFrame([("f", 0, 1), ("f", 0, 2), ("f", 1, 3), ("f", 2, 3)], "func string, src int, dst int")
    sets = spark.createDataFrame([("f", 1, "a", "1"), ("f", 2, "a", "1"), ("f", 1, "b", "1"), ("f", 2, "b", "2"), ("f", 0, "c", "5"), ("f", 1, "d", "3")], "func string, block int, variable string, value string")
    unknown = spark.createDataFrame([("f", 0, "d")], "func string, block int, variable string")
    got = {(r.block, r.variable): r.value for r in program.constants(edges, sets, unknown).collect()}
    assert got == {(1, "c"): "5", (2, "c"): "5", (3, "c"): "5", (3, "a"): "1"}


def test_chunks_cover_all_lines(spark):
    text = "\n".join(f"def f{i}():\n    return {i}\n" if i % 7 == 0 else f"    x{i} = {i} * {i}" for i in range(300))
    rows = chunks.with_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "y" * 9000)], "doc_id int, text string"), budget=60, overlap=10).orderBy("doc_id", "chunk").collect()
    of = lambda k: [r for r in rows if r.doc_id == k]
    assert of(2) == of(3) == [] and len(of(4)) == 1
    parts, all_lines = of(1), text.split("\n")
    covered = set()
    for a, b in zip(parts, parts[1:]):
        assert a.first_line < b.first_line <= a.end_line + 1
    for r in parts:
        assert r.tokens <= 60 and r.chunk_text == "\n".join(all_lines[r.first_line - 1 : r.end_line])
        covered |= set(range(r.first_line, r.end_line + 1))
    assert covered == set(range(1, len(all_lines) + 1))
