"""The threshold join of vectors against all pairs, and what its bounds leave out."""

import numpy as np

from millrace.operators import nearest


def vectors_of(seed, centres, each, spread, dims=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    return [(int(c * each + k), [float(np.float32(x)) for x in middle[c] + spread * rng.normal(size=dims)]) for c in range(centres) for k in range(each)]


def brute(rows, threshold):
    first = {}
    for i, v in sorted(rows):
        first.setdefault(tuple(v), i)
    reps = [(i, np.array(v)) for v, i in first.items() if any(v)]
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    return {(a, b): cos(x, y) for a, x in reps for b, y in reps if a < b and cos(x, y) >= threshold}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>")


def test_no_pair_is_lost_and_bounds_prune(spark):
    rows = vectors_of(1, 12, 25, 0.15) + [(900, [1.0] + [0.0] * 7), (901, [2.0] + [0.0] * 7)]
    for threshold in (0.98, 0.9, 0.3):
        near = nearest.SimilarPairs(frame(spark, rows), threshold, pivots=40)
        found = {(r.a, r.b): r.similarity for r in near.pairs().collect()}
        want = brute(rows, threshold)
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-5 for k in want)
        blocks = sum(near.chunks.values())
        met = near.block_pairs().count()
        assert met <= blocks * (blocks + 1) / 2
        if threshold >= 0.9:
            assert met < blocks * (blocks + 1) / 4  # more than half of the pairs of blocks never meet


def test_one_cell_of_many_blocks(spark, monkeypatch):
    """A cell that holds nearly all is cut; copies are one class and cost nothing."""
    monkeypatch.setattr(nearest, "ITEMS", 16)
    rows = vectors_of(2, 1, 120, 0.3)
    rows += [(1000 + k, rows[5][1]) for k in range(200)]
    near = nearest.SimilarPairs(frame(spark, rows), 0.9, pivots=2)
    found = [(r.a, r.b) for r in near.pairs().collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, 0.9).keys()
    assert max(near.chunks.values()) > 2
    members = dict(map(tuple, near.members().collect()))
    assert len(members) == len(rows) and {members[1000 + k] for k in range(200)} == {5}


def test_zero_null_and_no_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, [0.0, 3.0]), (3, [1.0, 0.0])]
    near = nearest.SimilarPairs(frame(spark, rows), 1.0)
    assert [(r.a, r.b, r.similarity) for r in near.pairs().collect()] == [(3, 4, 1.0)]
    assert sorted(map(tuple, near.members().collect())) == [(3, 3), (3, 3), (4, 4), (5, 5)]
    assert nearest.SimilarPairs(frame(spark, rows[:2]), 0.5).pairs().collect() == []
