"""The operators' own interfaces: alignment, decoding, anchors, media files, filters, clashing columns."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from millrace.llm import bpe, jpeg, media, mixing, near_copies, piece_model, sentencepiece_ops, simhash, syncmers, token_counts, url_filters

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_long_merges_agree():
    r = random.Random(1)
    ranks = {}
    for a in ("a", "b", "ab", "ba", "aa", "aab"):
        for b in ("a", "b", "ab", "aa"):
            if r.random() < 0.6:
                ranks[a, b] = r.randint(0, 9)
    rank = lambda a, b: ranks.get((a, b), bpe.NEVER)
    for n in (49, 60, 200):
        text = [r.choice("ab") for _ in range(n)]
        short, bpe.LONG = bpe.LONG, 10**6
        want = bpe.merge(list(text), rank)
        bpe.LONG = short
        assert bpe.merge(list(text), rank) == want


def test_proven_tokens_are_single():
    proven = token_counts.proven_whole_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(proven) > 45_000 and " the" in proven


def test_spans_give_the_source_back():
    model = piece_model.PieceModel(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(4)
    for _ in range(800):
        t = "".join(r.choice(["ab", " ", "  ", "é", "中", "😀", "▁", "\n", "\0", "the ", "<s>", "<0x41>"]) for _ in range(r.randint(0, 40)))
        ids, begins, ends = model.encode(t)
        assert ids.tolist() == library.encode(t)
        raw = t.encode()
        assert b"".join(raw[a:b] for a, b in zip(begins, ends)) == raw


def test_decoding_any_ids():
    model = piece_model.PieceModel(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(6)
    for _ in range(3000):
        ids = [r.choice([r.randint(0, 31_999), r.randint(0, 300), 259]) for _ in range(r.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_character_map(squeeze):
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    model = piece_model.PieceModel(PIECES)
    norm = next(dict(piece_model.fields(v)) for n, v in piece_model.fields(library.serialized_model_proto()) if n == 3)
    model.map, model.squeeze = piece_model.CharacterMap(norm[2]), int(squeeze)
    r = random.Random(8)
    for _ in range(500):
        t = "".join(r.choice(["a", " ", "  ", "Ａ", "ｶﾞ", "ﬁ", "é", "é", "　", "\t", "①", "b", "한"]) for _ in range(r.randint(1, 15)))
        out, align = model.normalise(t)
        assert out == library.normalize(t), repr(t)
        assert len(align) == len(out.encode()) + 1 and (np.diff(align) >= 0).all() and align[-1] <= len(t.encode())


def test_pieces_keep_and_replace_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)], "doc_id long, text string, ids string")
    out = sentencepiece_ops.with_pieces(df, PIECES)
    assert out.columns == ["doc_id", "text", "ids", "begins", "ends"]
    rows = sentencepiece_ops.with_decoded(out, PIECES).collect()
    assert [r.decoded for r in rows] == ["a b", "a b", ""] and rows[2].ids == []


def test_simhash_crowded_buckets(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(4)]
    prints = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3))) & (1 << 64) - 1 for b in base for _ in range(60)})
    signed = [p - (p >> 63 << 64) for p in prints]
    got = {(g.id, g.component) for g in _components(spark, signed)}
    group = {p: p for p in prints}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 2:
                group[top(b)] = top(a)
    least = {}
    for i, p in enumerate(prints):
        least.setdefault(top(p), i)
    assert got == {(i, least[top(p)]) for i, p in enumerate(prints)}


def _components(spark, signed):
    prints = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    return prints.join(simhash.grouped(prints).select("fp", F.col("first").alias("component")), "fp").collect()


def test_one_of_each(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (2, "quite another text here"), (2, "quite another text here"), (None, "lonely words of none"), (None, "lonely words of none"), (7, None), (8, "")]
    kept = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(k.doc_id), k.text) for k in kept) == [("1", "a b c d e"), ("2", "quite another text here"), ("7", None), ("None", "lonely words of none")]


def test_syncmers_are_context_free(spark):
    r = random.Random(12)
    middle = [f"w{r.randint(0, 500)}" for _ in range(60)]
    rows = [(0, " ".join(["x"] * 5 + middle + ["y"] * 7)), (1, " ".join(["p", "q"] + middle)), (2, "one two"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.anchors for x in syncmers.with_anchors(df).collect()}
    a = {(p.at - 5, p.hash) for p in got[0] if 5 <= p.at <= 5 + 57}
    b = {(p.at - 2, p.hash) for p in got[1] if 2 <= p.at <= 2 + 57}
    assert a == b and len(a) > 20 and len(got[2]) == 1 and got[3] == got[4] == []
    # of three words the middle one alone has the least hash where no anchor stands
    hashes = [h for (h,) in df.where("doc_id = 1").select(F.explode(F.transform(F.split("text", " "), lambda w: F.xxhash64(w)))).collect()]
    want = [i for i in range(len(hashes) - 2) if not (hashes[i + 1] < hashes[i] and hashes[i + 1] < hashes[i + 2])]
    assert [p.at for p in got[1]] == want


def test_likeness_is_positional(spark):
    r = random.Random(13)
    words = [f"w{r.randint(0, 90)}" for _ in range(300)]
    halves = " ".join(words[150:] + words[:150])
    mixed = words[:]
    r.shuffle(mixed)
    row = spark.createDataFrame([(" ".join(words), " ".join(["x", "y"] + words), halves, " ".join(mixed), "東京都は日本の首都です", "大阪と東京都は日本の首都")], "a string, shifted string, halves string, mixed string, p string, q string")
    for c in row.columns:
        row = syncmers.with_marks(row, c, f"{c}_m")
    got = row.select(*(syncmers.likeness("a_m", f"{c}_m").alias(c) for c in ("a", "shifted", "halves", "mixed")), syncmers.likeness("p_m", "q_m").alias("letters")).first()
    assert got.a == 1 and got.shifted > 0.95 and got.halves > 0.95 and got.mixed < 0.1 and got.letters > 0.5


def test_clashing_columns(spark):
    """Names that operators use inside are kept where they are a user's."""
    names = ["cut", "of", "epochs", "rest", "room", "best", "target", "whole", "range", "guest", "first", "earlier", "hashes", "anchors", "row", "cell", "part", "hash", "none"]
    df = spark.createDataFrame([(i, "http://x.com/de/9", f"text of {i}", 3 + i, "s", *range(len(names))) for i in range(5)], "doc_id long, url string, text string, size long, source string, " + ", ".join(f"`{n}` int" for n in names))
    judged = url_filters.judged(df)
    mixed = mixing.mixed(df.withColumn("key", mixing.random_key("doc_id", "text")))
    led = syncmers.with_marks(syncmers.with_next(df, "doc_id", ["text"], "text"))
    kept = near_copies.one_of_each(df)
    for out in (judged, mixed.withColumnRenamed("target", "target_"), led, kept):
        row = {r.doc_id: r for r in out.collect()}[0]
        assert all(row[n] == i for i, n in enumerate(names) if n in row and n != "target")
        assert set(names) - {"target"} <= set(out.columns)


def test_a_rule_without_literals(spark):
    rules = url_filters.rule_table(spark, host_rules=(("block", "--", "/"),), word_rules=())
    got = url_filters.judged(spark.createDataFrame([(1, "http://--/a"), (2, "http://x.y/a")], "page_id long, url string"), rules=rules).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "allow"}


def slow_blocks(image):
    """Coefficients of a single-scan file, bit by bit."""
    chosen, huffman, interval, data = image.scans[0]
    bits, marks, i = "", [], 0
    parts = [b""]
    while i < len(data):
        if data[i] == 255 and 0xD0 <= data[i + 1] <= 0xD7:
            parts.append(b"")
            i += 2
            continue
        parts[-1] += data[i : i + 1]
        i += 2 if data[i] == 255 else 1
    trees = {}
    for k, (lengths, order) in huffman.items():
        code, last, trees[k] = 0, 0, {}
        for s in order:
            code <<= lengths[s] - last
            trees[k][format(code, f"0{lengths[s]}b")] = s
            code, last = code + 1, lengths[s]
    of, places = jpeg._blocks_of_scan(image, chosen)
    out = {id(c): np.zeros((c.wide * c.high, 64), int) for c in chosen}
    mcu = 0
    for part in parts:
        bits, at = "".join(format(b, "08b") for b in part), 0
        pred = [0] * len(chosen)

        def symbol(tree):
            nonlocal at
            n = 1
            while bits[at : at + n] not in tree:
                n += 1
            s = tree[bits[at : at + n]]
            at += n
            return s

        def value(size):
            nonlocal at
            raw = bits[at : at + size]
            at += size
            return 0 if not size else int(raw, 2) if raw[0] == "1" else int(raw, 2) - (1 << size) + 1

        for _ in range(min(interval or len(places), len(places) - mcu)):
            for number, place in zip(of, places[mcu]):
                c = chosen[number]
                pred[number] += value(symbol(trees[c.dc]))
                row = out[id(c)][place]
                row[0], k = pred[number], 1
                while k < 64:
                    s = symbol(trees[16 | c.ac])
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15:
                        row[k] = value(s & 15)
                    k += 1
            mcu += 1
    return [out[id(c)] for c in chosen]


def colour_file(seed):
    """A 4:2:0 file of 3 components with runs, long zero runs, ends of block and restarts, written bit by bit."""
    r = random.Random(seed)
    symbols = [(run << 4) | s for run in range(16) for s in range(1, 6)] + [0, 0xF0]
    table = jpeg.codes(dict.fromkeys(symbols, 8))
    dc = jpeg.codes(dict.fromkeys(range(9), 4))
    width, height, interval = 40, 24, 2
    mcus = 3 * 2
    data, bits, blocks = b"", "", []

    def put(v, size):
        nonlocal bits
        if size:
            bits += format(v if v >= 0 else v + (1 << size) - 1, f"0{size}b")

    for m in range(mcus):
        if m % interval == 0:
            if m:
                bits += "1" * (-len(bits) % 8)
                raw = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
                data, bits = data + raw + bytes([0xFF, 0xD0 + (m // interval - 1) % 8]), ""
            pred = [0, 0, 0]
        for c in (0, 0, 0, 0, 1, 2):
            row = [r.randint(-100, 100)] + [r.choice([0] * r.choice([1, 30]) + [r.randint(-31, 31)]) for _ in range(63)]
            blocks.append((c, row))
            d = row[0] - pred[c]
            pred[c] = row[0]
            size = abs(d).bit_length()
            bits += format(dc[size][0], "04b")
            put(d, size)
            run = 0
            last = max([k for k in range(1, 64) if row[k]], default=0)
            for k in range(1, last + 1):
                if not row[k]:
                    run += 1
                    continue
                while run > 15:
                    bits += format(table[0xF0][0], "08b")
                    run -= 16
                size = abs(row[k]).bit_length()
                bits += format(table[run << 4 | size][0], "08b")
                put(row[k], size)
                run = 0
            if last < 63:
                bits += format(table[0][0], "08b")
    bits += "1" * (-len(bits) % 8)
    data += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    head = jpeg._segment(0xDB, b"\0" + bytes([8] * 64)) + jpeg._huffman_segment(0, dict.fromkeys(range(9), 4)) + jpeg._huffman_segment(16, dict.fromkeys(symbols, 8))
    frame = b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03\x01\x22\0\x02\x11\0\x03\x11\0"
    scan = jpeg._segment(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0")
    return b"\xff\xd8" + head + jpeg._segment(0xC0, frame) + jpeg._segment(0xDD, interval.to_bytes(2, "big")) + scan + data + b"\xff\xd9"


def test_reader_agrees_bit_by_bit():
    files = [colour_file(s) for s in range(4)] + [jpeg.encode(bytes(random.Random(n).randbytes(64 * n))) for n in (1, 2, 9, 50)]
    for image, file in zip(jpeg.decode(files), files):
        slow = jpeg.parse(file)
        jpeg._place(slow)
        for fast, want in zip(image.components, slow_blocks(slow)):
            assert (fast.coefficients == want).all()
    assert (jpeg.decode(files)[0].width, jpeg.decode(files)[0].thumbnail.shape) == (40, (4, 6))


def test_media_of_bad_and_missing_files(spark):
    rows = [(1, b"no image"), (2, None), (3, jpeg.encode(b"x" * 64)), (4, jpeg.encode(b"x" * 64)[:60])]
    got = {r.k: r.media for r in media.with_media(spark.createDataFrame(rows, "k int, image binary")).collect()}
    assert got[1].error and got[2] is None and got[3].payload == b"x" * 64 and got[4].error and got[4].payload is None


def test_rarest_token_is_the_index(spark):
    rules = url_filters.rule_table(spark, (("block", "rare.example.com", "/"),), (("block", "pills"),))
    urls = spark.createDataFrame([("a.example.com/x",), ("b.example.com/",), ("rare.example.com/",)], "target string")
    assert {(r.rule, r.token) for r in url_filters.index(rules, urls).collect()} == {("rare.example.com/", "rare"), ("pills", "pills")}


def test_judged_keeps_columns(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a", "mine"), (1, "http://x.org/a", "mine")], "page_id long, url string, verdict string")
    out = url_filters.judged(pages)
    assert [(r.verdict, r.host) for r in out.collect()] == [("allow", "x.org")] * 2 and "page_id" in out.columns
