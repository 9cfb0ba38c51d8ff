"""Sharding, fill-in-the-middle and conversation repair against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from conftest import TURNS
from pyspark.sql import functions as F

from millrace.llm import conversations, fill_middle, sharding
from millrace.llm.queries import ORACLE_SQL, QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(row):
    return tuple((v is None, v) for v in row)


# Sharding


def held(spark, rows, schema="id long, size long, group long", **options):
    return sharding.sharded(spark.createDataFrame(rows, schema), **options).collect()


def check_law(rows, shards=8, group_limit=sharding.TOGETHER):
    """Slots are gapless, shards near equal up to a cut on each side, small groups whole; the number of shards that have rows."""
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in part) == list(range(len(part))) for part in by_shard.values())
    total = sum(max(r["size"] or 0, 0) for r in rows)
    slack = max((r["size"] or 0) for r in rows) + group_limit * total / shards + 1
    for k in range(shards):
        assert abs(sum(max(r["size"] or 0, 0) for r in by_shard[k]) - total / shards) <= slack
    groups = defaultdict(list)
    for r in rows:
        groups[r["group"]].append(r)
    for members in groups.values():
        if sum(r["size"] or 0 for r in members) <= group_limit * total / shards:
            assert len({r["shard"] for r in members}) == 1
    return len(by_shard)


def test_shards_are_near_equal_with_one_huge_group_and_one_huge_row(spark):
    random.seed(3)
    rows = [(i, random.randint(1, 400), i // 3) for i in range(6000)]
    rows += [(10_000 + i, 100, -1) for i in range(5000)]  # a third and more of the rows
    rows += [(20_000, 90_000, -2), (20_001, 0, -3), (20_002, -5, -3), (20_003, None, None), (None, 7, None)]
    assert check_law(held(spark, rows)) == 8


def test_ranges_stay_small_where_one_group_is_hot(spark):
    rows = [(i, 50, 1 if i % 2 else i) for i in range(40_000)]
    base = spark.createDataFrame(rows, "id long, size long, group long").select("size", F.concat(*(sharding._ordered(F.xxhash64(c)) for c in ("group", "id", "size"))).alias("key"))
    bounds, counts, total = sharding._ranges(base, 8)
    mean = len(rows) / (sharding.RANGES * 8)
    assert total == 2_000_000 and sum(n for _, n in counts.values()) == len(rows)
    assert max(n for _, n in counts.values()) <= sharding.OVERFULL * mean + 1
    assert len(counts) == len(bounds) + 1


def test_shards_of_repeated_rows_ties_and_few_rows(spark):
    rows = [(1, 10, 5)] * 3000 + [(2, 10, 6)] * 200
    assert check_law(held(spark, rows)) == 8
    assert [(r["shard"], r["slot"]) for r in held(spark, [(1, 5, 1)])] == [(4, 0)]
    assert {r["shard"] for r in held(spark, [(i, 0, i) for i in range(5)])} <= set(range(8))
    assert held(spark, []) == []


def test_shards_keep_columns_of_any_name_and_do_not_depend_on_partitions(spark):
    rows = [(i, i % 50, i // 2, i, "r", 0.5, 7) for i in range(500)]
    docs = spark.createDataFrame(rows, "key long, size long, group long, middle long, row string, before double, slot int")
    once = sharding.sharded(docs.repartition(1), shards=3)
    assert once.columns == ["key", "size", "group", "middle", "row", "before", "shard", "slot"]
    again = sharding.sharded(docs.repartition(7), shards=3)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, 10, i) for i in range(300)], "id long, size long, group long")
    sharding.written(sharding.sharded(docs, shards=4), str(tmp_path / "out"), 8)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 300 and sorted(r[0] for r in found.select("shard").distinct().collect()) == [0, 1, 2, 3]
    for k in range(4):
        for file in (tmp_path / "out" / f"shard={k}").glob("*.parquet"):
            slots = [r[0] for r in spark.read.parquet(str(file)).select("slot").collect()]
            assert slots == sorted(slots)


def test_op11(spark, sf_dir, texts):
    rows = QUERIES["op11_sharding"](spark, sf_dir).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    renamed = [{"size": r["size"], "group": r["text_crc32"], "shard": r["shard"], "slot": r["slot"]} for r in rows]
    assert check_law(renamed) >= 7  # the longest text is more than a shard


# Fill in the middle


def brute_fim(doc, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = sha(f"42:{'' if doc is None else doc}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return (doc, n, form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text))


def test_op12(spark, sf_dir, texts):
    rows = [tuple(r) for r in QUERIES["op12_fill_in_middle"](spark, sf_dir).collect()]
    assert sorted(rows, key=key) == sorted((brute_fim(i, t) for i, t in texts), key=key)
    assert {r[2] for r in rows} == {"plain", "spm", "psm"}


def test_fim_over_many_texts_and_its_inverse(spark):
    random.seed(2)
    pieces = ["a", "é", "😀", " ", "\n", "\u2003", "\x00", "<", "P>", "<P>", "<M", ">", "word"]
    rows = [(i, "".join(random.choices(pieces, [9, 3, 3, 6, 2, 1, 1, 2, 2, 0.1, 2, 2, 5], k=random.randint(0, 30)))) for i in range(2000)]
    rows += [(5000 + i, " " * i) for i in range(20)] + [(6000, "x " * 200_000), (6003, "y" * 300_000 + " " * 100_000)]
    docs = spark.createDataFrame([(i, t, "kept", 1) for i, t in rows], "doc_id long, text string, n string, output int")
    made = fill_middle.with_fim(docs)
    assert made.columns == ["doc_id", "text", "n", "output", "fim"]
    fim = F.col("fim")
    got = made.select("doc_id", "text", "fim.*", fill_middle.restored(fim).alias("back")).collect()
    assert all(r["back"] == r["text"] for r in got)
    assert sorted((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], sha(r["output"]), sha(r["back"])) for r in got) == sorted(brute_fim(i, t) for i, t in rows)


def test_fim_rates_and_seeds(spark):
    docs = spark.createDataFrame([(i, "one two three four") for i in range(400)], "doc_id long, text string")
    forms = lambda **o: Counter(r[0] for r in fill_middle.with_fim(docs, **o).select("fim.form").collect())
    assert forms(rate=0) == {"plain": 400} and forms(rate=100, spm=100) == {"spm": 400} and forms(rate=100, spm=0) == {"psm": 400}
    outputs = lambda **o: [r[0] for r in fill_middle.with_fim(docs, **o).orderBy("doc_id").select("fim.output").collect()]
    assert outputs() == outputs() != outputs(seed=7)


# Conversation repair


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """Best first over whole edit strings; rows (role, text) are in order. Prices a string as the contract does, and knows no layers."""
    blank = [not re.search(r"[^\x20\x09-\x0D]", t) for _, t in rows]
    again = [r in rows[:k] for k, r in enumerate(rows)]
    cut = [not b and t.strip(" \t\n\v\f\r")[-1] not in ".!?" for b, (_, t) in zip(blank, rows)]
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, k, given, lines = heapq.heappop(queue)
        if (k, given) in seen:
            continue
        seen.add((k, given))
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", given):
            return cost, audit, sha("\n".join(lines)), sum(blank), sum(a and not b for a, b in zip(again, blank)), sum(c and not a for c, a in zip(cut, again))
        if len(given) < len(rows) + 3:
            for role in ("user", "assistant"):
                if re.fullmatch("s?(ua)*u?", given + role[0]):
                    heapq.heappush(queue, (cost + 2, audit + "I", k, given + role[0], (*lines, f"{role}:")))
        if k < len(rows):
            role, text = rows[k]
            heapq.heappush(queue, (cost + 3, audit + "D", k + 1, given, lines))
            if not blank[k] and not again[k]:
                for new, edit, price in ((role, "K", 0), ("user", "R", 2), ("assistant", "R", 2)):
                    if re.fullmatch("s?(ua)*u?", given + new[:1]) and new[:1]:
                        heapq.heappush(queue, (cost + price + cut[k], audit + edit, k + 1, given + new[0], (*lines, f"{new}:{text}")))


def brute_summaries(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, sha(sha(r[2]) + "\n" + r[3]))
    hurt, want = defaultdict(list), []
    for r in brute_damage(rows):
        hurt[r[0]].append(r)
    for conv in {r[0] for r in rows}:
        mine = sorted(hurt[conv], key=order)
        cost, audit, digest, blank, duplicate, truncated = brute_repair([r[2:] for r in mine])
        turns = {r[1] for r in mine} - {None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        want.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank, duplicate, truncated, illegal, cost, audit, digest))
    return sorted(want, key=key)


def test_op13(spark, sf_dir):
    rows = sorted((tuple(r) for r in QUERIES["op13_conversation_repair"](spark, sf_dir).collect()), key=key)
    assert rows == brute_summaries(TURNS)


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_conversation_repair"])
def test_sql_twins(spark, sf_dir, name):
    ours = QUERIES[name](spark, sf_dir)
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet/*.parquet'")
    sql = db.sql(ORACLE_SQL[name])
    assert sorted(sql.select(*ours.columns).fetchall(), key=key) == sorted(map(tuple, ours.collect()), key=key)


def test_segments_of_any_size_give_the_same_repair(spark, monkeypatch):
    """One conversation in many segments and partitions: matrices, their product and the way back against whole conversations."""
    random.seed(9)
    said = ["Yes.", "No", "", "Fine!", "So?", *(f"Word {i}." for i in range(8))]
    rows = [(c, t, random.choice(["user", "assistant", "system", "tool"]), random.choice(said)) for c in range(12) for t in range(random.choice([3, 9, 14]))]
    # The same turns as ids of another type, with columns that are not of ours.
    frame = spark.createDataFrame([(f"{c}", t, r, x, "said", 1) for c, t, r, x in rows], "conv_id string, turn long, role string, text string, said string, nth int")
    want = [(f"{r[0]}", *r[1:]) for r in brute_summaries(rows)]
    hurt = conversations.damaged(frame)
    marked = conversations.marked(hurt).withColumn("drop", F.col("blank") | F.col("seen")).orderBy("conv_id", "turn", "said").collect()
    for size in (1, 2, 5):
        got = {}
        for conv in {r["conv_id"] for r in marked}:
            mine = [(r["role"], r["text"], r["times"], r["drop"], r["truncated"]) for r in marked if r["conv_id"] == conv]
            layer = {0: (0, "")}
            for k in range(0, len(mine), size):
                reached = {}
                for e in conversations._segment(mine[k : k + size], k, (0, 1, 2, 3))["edges"]:
                    if e["source"] in layer:
                        cost, audit = layer[e["source"]]
                        conversations._better(reached, e["target"], cost + e["cost"], audit + e["audit"])
                layer = reached
            got[conv] = min(layer[s] for s in (0, 3) if s in layer)
        assert got == {r[0]: (r[6], r[7]) for r in want if r[0] in got}
    assert sorted((tuple(r) for r in conversations.summaries(frame).collect()), key=key) == sorted(want, key=key)


def test_one_long_conversation_over_many_partitions(spark):
    """More rows than a segment has, most of them in one conversation, in as many ranges as there are partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one partition
    try:
        _one_long_conversation(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _one_long_conversation(spark):
    n = 3 * conversations.ROWS
    frame = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('Turn ', id, '.') AS text")
    frame = frame.unionByName(spark.range(50).selectExpr("id + 2 AS conv_id", "0L AS turn", "'user' AS role", "'Hello.' AS text"))
    repair = conversations.Repair(conversations.damaged(frame))
    assert repair.segments.where("conv_id = 1").count() >= 4
    assert repair.segments.where("conv_id = 1").select(F.shiftright("nth", 32)).distinct().count() > 1
    found = {r["conv_id"]: r for r in conversations.summaries(frame).collect()}
    rows = [r[2:] for r in brute_damage([(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(n)])]
    layer = {(0): (0, "")}
    layer = conversations.closed(layer)
    seen = set()
    for role, text in rows:
        blank = not text.strip()
        layer = conversations.stepped(layer, role[0], blank or (role, text) in seen, not text.endswith("."))
        seen.add((role, text))
    cost, audit = min(layer[s] for s in (0, 3) if s in layer)
    assert (found[1]["cost"], found[1]["audit"]) == (cost, audit)
    assert found[1]["repaired_sha256"] == sha("\n".join(conversations.repaired([(r, t, 1) for r, t in rows], 0, audit)))
