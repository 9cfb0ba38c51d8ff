"""Every registered query over a small table against brute force, and over empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from millrace.llm.queries import ORACLE_SQL, QUERIES


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def key(row):
    return tuple((v is None, v) for v in row)


def rows_of(spark, name, sf_dir):
    return [tuple(r) for r in QUERIES[name](spark, sf_dir).collect()]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, name, empty_dir):
    assert rows_of(spark, name, empty_dir) == []


def test_op1(spark, sf_dir, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in texts:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert sorted(rows_of(spark, "op1_token_counts", sf_dir), key=key) == sorted(want, key=key)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """Of each row its fingerprint, the smallest id of its component and the component itself, rows linked at two differing bits or fewer."""
    prints = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                group[top(a)] = top(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        least.setdefault(top(x), []).append(i)
    return prints, [min((i for i in least[top(x)] if i is not None), default=None) for x in range(len(rows))], [top(x) for x in range(len(rows))]


def test_op2(spark, sf_dir, texts):
    prints, first, _ = brute_components(texts)
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(texts, prints, first)]
    assert sorted(rows_of(spark, "op2_simhash", sf_dir), key=key) == sorted(want, key=key)


def test_op3(spark, sf_dir, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t in texts:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True))
    assert sorted(rows_of(spark, "op3_sentencepiece", sf_dir), key=key) == sorted(want, key=key)


def brute_cut(raws, length=200):
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield gone, bytes(b for b, g in zip(r, gone) if not g), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))


def test_op4(spark, sf_dir, texts):
    raws = [(t or "").encode() for _, t in texts]
    want = [(i, len(r), sum(gone), spans, sha(kept)) for (i, _), r, (gone, kept, spans) in zip(texts, raws, brute_cut(raws))]
    assert sorted(rows_of(spark, "op4_suffix_dedup", sf_dir), key=key) == sorted(want, key=key)


def test_op4_rows_of_one_id_are_told_apart(spark):
    """Two texts with one 32-bit hash under a null id: only the one that repeats goes; its copies under that id go alike."""
    from pyspark.sql import functions as F

    from millrace.llm import suffix_dedup

    many = spark.range(400_000).select(F.concat(*(F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 256) for k in range(4))).alias("text"))
    pair = many.groupBy(F.hash("text")).agg(F.collect_list("text").alias("texts")).where(F.size("texts") > 1).first().texts
    a, b = pair[:2]
    rows = [(None, a), (None, b), (None, a), (7, a), (7, "short"), (7, b[:199])]
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, 256, [(0, 256)], b"") if t == a else (i, len(t), [], t.encode()) for i, t in rows]
    assert sorted(((r.id, r.n_bytes, [tuple(s) for s in r.removed], bytes(r.kept)) for r in got), key=str) == sorted(want, key=str)


def test_op4_crowded_buckets(spark, monkeypatch):
    from millrace.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "CROWD", 2)
    r = random.Random(3)
    some = lambda n: "".join(r.choice("abcdefg hij") for _ in range(n))
    shared = [some(260), some(500), some(210)]
    rows = [(i, some(r.randint(0, 300)) + r.choice(shared)[r.randint(0, 60) :] + some(r.randint(0, 200)) + r.choice(shared) + some(r.randint(0, 90))) for i in range(40)]
    rows += [(50, "x" * 1000), (51, "ab" * 400), (52, rows[3][1]), (None, rows[7][1]), (5, rows[6][1])]
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    raws = [t.encode() for _, t in rows]
    want = [(i, len(raw), kept) for (i, _), raw, (_, kept, _) in zip(rows, raws, brute_cut(raws))]
    assert sorted(((g.id, g.n_bytes, bytes(g.kept)) for g in got), key=key) == sorted(want, key=key)


def test_op5(spark, sf_dir, texts):
    got = QUERIES["op5_syncmers"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    by_text = {}
    for g in got:
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
        by_text.setdefault((g.doc_id, g.n_chars), set()).add(g.fingerprint)
    plain = [(i, t or "") for i, t in texts if i is not None and i != 5]
    order = sorted(dict(plain), reverse=True)
    known = dict(plain)
    digests = {(g.doc_id, g.edited_sha256) for g in got}
    for a, b in zip(order, order[1:]):
        if a > 5 >= b or b == 5:
            continue  # the rows of id 5 stand between
        third = len(known[a]) // 3
        assert (a, sha(known[a][: len(known[a]) - third] + known[b][:third])) in digests
    last = [(i, t) for i, t in texts if i is None][-1]  # null ids come last, the greatest id follows
    third = len(last[1]) // 3
    assert (None, sha(last[1][: len(last[1]) - third] + known[order[0]][:third])) in digests
    copies = {g.fingerprint for g in got if g.doc_id in (3, 100, 101, 102)}
    assert len(copies) == 1


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = [s for s in names if s not in full]
        level = (sum(sizes.values()) - sum(most * sizes[s] for s in full)) / max(1, sum(weight[s] for s in rest))
        over = {s for s in rest if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def test_op6(spark, sf_dir, texts):
    got = QUERIES["op6_mixing"](spark, sf_dir).collect()
    again = QUERIES["op6_mixing"](spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((g.doc_id, g.size) for g in got), key=key) == sorted(((i, count(t)) for i, t in texts), key=key)
    sizes = Counter()
    for i, t in texts:
        sizes[None if i == 7 else f"s{(i or 0) % 3}"] += count(t)
    want = brute_targets(dict(sizes))
    assert len({(g.source_size, round(g.target, 6)) for g in got}) == len(sizes)
    taken = Counter()
    for g in got:
        assert 0 <= g.taken <= 3 * g.size
        taken[g.source_size] += g.taken
    for s, n in sizes.items():
        assert abs(taken[n] - want[s]) <= 1


@pytest.mark.parametrize("seed", range(3))
def test_targets_fill_up(spark, seed):
    from millrace.llm import mixing

    r = random.Random(seed)
    sizes = {f"s{i:02}": r.choice([0, 1, 10, 1000, 50_000]) for i in range(12)} | {None: 5}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = brute_targets(sizes)
    assert all(abs(g.target - want[g.source]) < 1e-6 * max(1, want[g.source]) for g in got)
    assert abs(sum(g.target for g in got) - sum(sizes.values())) < 1e-6 * sum(sizes.values())


def test_op7(spark, sf_dir, texts):
    got = QUERIES["op7_media"](spark, sf_dir).collect()
    want = []
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((i, len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:])))
    assert sorted((tuple(g)[:5] for g in got), key=key) == sorted(want, key=key)
    assert len({(g.media_sha256, g.feature) for g in got if g.doc_id in (3, 100, 101, 102)}) == 1


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute_spans(text):
    def right(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    kinds = [k for k, _ in PATTERNS]
    spans = [(m.start(), k, m.end()) for k, p in PATTERNS for m in re.finditer(p, text) if right(k, m[0])]
    return sorted(spans, key=lambda s: (s[0], kinds.index(s[1])))


def test_op8(spark, sf_dir, texts):
    got = QUERIES["op8_pii"](spark, sf_dir).collect()
    want = []
    for i, t in texts:
        spans = brute_spans(t or "")
        want.append((i, *(sum(k == s[1] for s in spans) for k, _ in PATTERNS), sha(",".join(f"{k}:{a}:{b}" for a, k, b in spans))))
    assert sorted((tuple(g)[:6] for g in got), key=key) == sorted(want, key=key)
    extra = next(g.spans for g in got if g.doc_id == 121)
    assert [s.split(":")[0] for s in extra.split(",")] == ["national_phone", "iban"]


def test_pii_against_patterns():
    from millrace.llm import pii

    r = random.Random(5)
    for _ in range(3000):
        t = "".join(r.choice(["a", "b.", "@", "1", "22", "255", "256", ".", "-", "+", " ", "(", "_d", "é", "4111111111111111", "x@y.z"]) for _ in range(r.randint(0, 30)))
        assert [(s["start"], s["kind"], s["end"]) for s in pii.find(t) if s["base"]] == brute_spans(t), t
    assert pii.find("1" * 200_000 + "a" * 200_000 + "." * 10) == []
    assert pii.redact("to x@y.org.") == "to [EMAIL]."


def test_op9(spark, sf_dir):
    got = rows_of(spark, "op9_url_filters", sf_dir)
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{sf_dir}/pages.parquet/*.parquet'")
    want = db.execute(ORACLE_SQL["op9_url_filters"]).fetchall()
    assert sorted(got, key=key) == sorted(want, key=key)
    by_id = {r[0]: r for r in got}
    assert by_id[0][3:] == ("example.org/es/", "block") and by_id[4][3:] == (None, "block") and by_id[10][3:] == (None, "allow")


def test_op10(spark, sf_dir, texts):
    got = QUERIES["op10_toxicity"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for g in got:
        assert 0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3)
        assert g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 4 == 2)
    assert len({g.score for g in got if g.doc_id in (130, 131)}) == 1


def test_toxicity_on_held_out_rows(spark):
    from millrace.llm import toxicity

    r = random.Random(2)
    plain = "the of and thon ering tion wh ou edge river stone light".split()
    docs, labels = [], []
    for i in range(600):
        toxic = i % 8 == 0
        words = [r.choice(plain) for _ in range(r.randint(5, 80))]
        if toxic:
            for w in r.choices(["moron", "scum", "idiotic"], k=3):
                words.insert(r.randint(0, len(words)), w)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = toxicity.with_score(frame, model).where(toxicity.held_out()).collect()
    assert len(scored) > 100
    wrong = sum((g.score >= toxicity.TOXIC) != (g.doc_id % 8 == 0) for g in scored)
    assert wrong <= 0.03 * len(scored)
