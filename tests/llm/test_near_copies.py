"""The pipeline's near copies against all pairs."""

import random

import corpus_pipeline
from millrace.lineage import stored
from millrace.llm import near_copies, simhash


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    """The smallest id of each component of J >= 0.8."""
    sets, top = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                low, high = sorted((find(a), find(b)))
                top[high] = low
    return {find(i) for i in top}


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_pipeline_stage_links_all_near_copies(spark, monkeypatch):
    r = random.Random(3)
    line = " ".join(f"notice{i}" for i in range(30))
    texts = []
    for k in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(60, 200))]
        texts += [" ".join(base)] + [edited(r, base, e) for e in (1, 2, 3, 4, 6, 9)]
        texts += [line + " " + " ".join(f"v{r.randrange(3000)}" for _ in range(r.randint(1, 9)))]
    chain = [f"c{i}" for i in range(120)]
    texts += [" ".join(chain[3 * i : 3 * i + 80]) for i in range(12)]  # each near the next only
    crowd = [f"d{i}" for i in range(100)]
    texts += [edited(r, crowd, e % 4) for e in range(60)]
    texts += ["", None, " \n", "two words", "Two  words", "five words are just one"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute(rows)
    monkeypatch.setattr(near_copies, "COMMON", 2)
    monkeypatch.setattr(near_copies, "SAMPLED", 2)
    got = [x.doc_id for x in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()]
    assert sorted(got) == sorted(want)


def test_bitmaps_never_differ_in_more_than_the_sets(spark):
    import numpy as np

    r = random.Random(5)
    for size in (0, 1, 3, 60, 900):
        a = {r.randrange(-(2**63), 2**63) for _ in range(size)}
        b = {x for x in a if r.random() < 0.9} | {r.randrange(-(2**63), 2**63) for _ in range(size // 20)}
        for longs in (near_copies.LONGS, near_copies.FINE):
            maps = [near_copies.parities(np.array(sorted(s), "<i8"), longs) for s in (a, b)]
            assert [len(x) for x in maps] == [longs] * 2
            assert sum(int(x).bit_count() for x in (maps[0] ^ maps[1]).view("<u8")) <= len(a ^ b)


def test_columns_of_any_name_stay(spark):
    rows = [(0, "one two three four five six", "a", 1, 2.0), (1, "one two three four five six", "b", 3, 4.0), (None, "other words", None, 5, None), (2, None, "c", None, 6.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash string, _of long, _key double")
    got = near_copies.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted((rows[0], *rows[2:]), key=str)


def test_pairs_follow_the_size_of_a_group_not_its_square(spark, monkeypatch):
    """Half of a group is alike, half is not quite; fingerprints find the first half, whatever prefixes would begin with."""
    formed, sift = [], near_copies._sifted

    def sifted(pairs, classes):
        pairs = stored(pairs)
        formed.append(pairs.count())
        return sift(pairs, classes)

    monkeypatch.setattr(near_copies, "_sifted", sifted)
    totals = {}
    for size in (100, 400):
        r, base = random.Random(1), [f"w{i}" for i in range(150)]
        texts = [edited(r, base, 1 + i % 2 if i < size // 2 else 6) for i in range(size)]
        formed.clear()
        kept = near_copies.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert {x.doc_id for x in kept.collect()} == brute(list(enumerate(texts)))
        assert sum(formed[1:]) < size
        totals[size] = sum(formed)
    assert totals[400] < 6 * totals[100]


def test_sorted_fingerprints_find_near_ones(spark):
    r = random.Random(8)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    prints, planted = [r.getrandbits(64) for _ in range(400)], set()
    for i in range(0, 400, 2):
        bits = r.sample(range(64), i % 6)
        prints[i + 1] = prints[i] ^ sum(1 << b for b in bits)
        planted.add((i, i + 1))
    prints += [7] * 20  # of one fingerprint each meets the next
    fps = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(prints)], "node long, fp long")
    got = [tuple(x) for x in simhash.neighbours(fps, 12).collect()]
    assert len(got) == len(set(got)) and all(a < b and (prints[a] ^ prints[b]).bit_count() <= 12 for a, b in got)
    assert len(planted & set(got)) >= 0.95 * len(planted)
    assert {(i, i + 1) for i in range(400, 419)} <= set(got)
    assert not [p for p in simhash.neighbours(fps, 0).collect() if prints[p.a] != prints[p.b]]
