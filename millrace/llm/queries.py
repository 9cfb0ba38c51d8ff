"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.lineage import stored
from millrace.llm import conversations, fill_middle, media, mixing, pii, sentencepiece_ops, sharding, simhash, suffix_dedup, syncmers, token_counts, toxicity, url_filters

#: Texts with more tokens than this do not fit one training window.
WINDOW = 1024
SHARDS = 8


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the whole text, null as the empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.with_token_counts(_texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > WINDOW).alias("over_limit"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = _texts(spark, sf_dir).withColumn("n_bytes", F.octet_length("text"))
    pieces = sentencepiece_ops.with_pieces(texts, path, keep=["doc_id", "n_bytes"], decoded="decoded")
    return pieces.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        # The spans of a text's pieces reach from its first byte to its last.
        (F.col("n_bytes") == F.coalesce(F.array_max("ends"), F.lit(0))).alias("spans_cover"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_texts(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), simhash.as_hex("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.without_repeats(_texts(spark, sf_dir))
    return cut.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir).withColumn("tie", F.xxhash64("text"))
    led = syncmers.with_next(docs, "doc_id", ["text"], "tie")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    sized = led.withColumn("n_chars", F.char_length("text").cast("long"))
    marked = sized.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substr("next_text", F.lit(1), third)))
    for text in ("text", "edited", "next_text"):
        marked = syncmers.with_marks(marked, text, f"{text}_marks")
    return marked.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.as_text("text_marks").alias("fingerprint"),
        syncmers.as_text("edited_marks").alias("edited_fingerprint"),
        syncmers.likeness("text_marks", "edited_marks").alias("near_edited"),
        syncmers.likeness("text_marks", "next_text_marks").alias("near_next"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = stored(docs.select("doc_id", "source", mixing.words("text").alias("size"), mixing.random_key("doc_id", "text").alias("key")))
    return mixing.mixed(sized).select("doc_id", "size", "source_size", "target", "taken")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = media.with_payload_image(_texts(spark, sf_dir), "text")
    seen = media.with_media(images.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "image"))
    payload = F.col("media.payload")
    return seen.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substr(payload, F.lit(-64), F.lit(64))).alias("tail_crc32"),
        F.octet_length("image").cast("long").alias("media_bytes"),
        F.sha2("image", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "media.width", "media.height"), "media.thumbnail_hash").alias("feature"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(_texts(spark, sf_dir)).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.as_text(base), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filters.judged(pages).select("page_id", "host", "path", "rule", "verdict")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.with_score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    sized = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("group"))
    dealt = sharding.sharded(sized, shards=SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fim = F.col("fim")
    made = fill_middle.with_fim(docs)
    return made.select("doc_id", fim["n"].alias("n"), fim["form"].alias("form"), fim["prefix_chars"].alias("prefix_chars"), fim["middle_chars"].alias("middle_chars"), F.sha2(fim["output"], 256).alias("output_sha256"), F.sha2(fill_middle.restored(fim), 256).alias("restored_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.summaries(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_syncmers": op5_syncmers,
    "op6_mixing": op6_mixing,
    "op7_media": op7_media,
    "op8_pii": op8_pii,
    "op9_url_filters": op9_url_filters,
    "op10_toxicity": op10_toxicity,
    "op11_sharding": op11_sharding,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_conversation_repair": op13_conversation_repair,
}

_WORDS = "|".join(word for _, word in url_filters.WORD_RULES)
ORACLE_SQL: dict[str, str] = {
    "op9_url_filters": f"""
        WITH parts AS (
            SELECT page_id,
                translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        ruled AS (
            SELECT *, CASE
                WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
                WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
                WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
                WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
            FROM parts)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host || path, '(?i)(^|[^a-z0-9])({_WORDS})([^a-z0-9]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
        FROM ruled""",
    "op12_fill_in_middle": r"""
        WITH units AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
                regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
            FROM documents),
        ranks AS (
            SELECT doc_id, text, u, len(u) AS n,
                least(('0x' || h[1:8])::BIGINT % (len(u) + 1), ('0x' || h[9:16])::BIGINT % (len(u) + 1)) AS a,
                greatest(('0x' || h[1:8])::BIGINT % (len(u) + 1), ('0x' || h[9:16])::BIGINT % (len(u) + 1)) AS b,
                CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                    WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM units),
        parts AS (
            SELECT doc_id, text, n, form, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m, array_to_string(list_slice(u, b + 1, n), '') AS s
            FROM ranks)
        SELECT doc_id, n, form,
            CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM parts""",
    "op13_conversation_repair": r"""
        WITH RECURSIVE named AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        hashed AS (
            SELECT *, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, 1 + length(k)), lambda i: ascii(substr(k, i, 1))::BIGINT),
                lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind FROM named),
        hurt AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
            FROM hashed WHERE kind <> 0),
        ordered AS (
            SELECT conv_id, turn, role, text, left(role, 1) AS initial, row_number() OVER w AS nth, lag(left(role, 1)) OVER w AS before,
                NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
                NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
            FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(sha256(role) || chr(10) || text))),
        told AS (SELECT *, min(nth) OVER (PARTITION BY conv_id, role, text) < nth AS again FROM ordered),
        edits(a, edit, initial, b) AS (VALUES (0, 'D', '', 0), (1, 'D', '', 1), (2, 'D', '', 2), (3, 'D', '', 3), (0, 'R', '', 2), (1, 'R', '', 2), (2, 'R', '', 3), (3, 'R', '', 2),
            (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2)),
        inserts(a, more, b) AS (VALUES (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3), (0, 'I', 2), (0, 'II', 3), (1, 'I', 2), (1, 'II', 3), (2, 'I', 3), (3, 'I', 2)),
        layers AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS nth, b AS state, {'cost': 2 * length(more), 'audit': more} AS best FROM told, inserts WHERE a = 0
            UNION ALL
            SELECT l.conv_id, t.nth, i.b, min({'cost': l.best.cost + CASE e.edit WHEN 'K' THEN 0 WHEN 'R' THEN 2 ELSE 3 END + CASE WHEN t.cut AND e.edit <> 'D' THEN 1 ELSE 0 END + 2 * length(i.more), 'audit': l.best.audit || e.edit || i.more})
            FROM layers l JOIN told t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.nth = l.nth + 1
            JOIN edits e ON e.a = l.state AND (e.edit = 'D' OR NOT t.blank AND NOT t.again AND (e.edit = 'R' OR e.initial = t.initial)) JOIN inserts i ON i.a = e.b
            GROUP BY l.conv_id, t.nth, i.b),
        ends AS (SELECT conv_id, max(nth) AS n FROM told GROUP BY conv_id),
        done AS (SELECT l.conv_id, min(l.best) AS best FROM layers l JOIN ends ON ends.conv_id IS NOT DISTINCT FROM l.conv_id AND ends.n = l.nth WHERE l.state IN (0, 3) GROUP BY l.conv_id),
        letters AS (SELECT conv_id, unnest(range(1, 1 + length(best.audit))) AS i, substr(best.audit, i, 1) AS edit FROM done),
        placed AS (SELECT conv_id, i, edit, sum((edit <> 'I')::INT) OVER w AS nth, sum((edit <> 'D')::INT) OVER w AS given FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
        left_over AS (
            SELECT p.conv_id, p.i, p.edit, t.role, CASE WHEN p.edit = 'I' THEN '' ELSE t.text END AS text, p.given - max((p.given = 1 AND p.edit = 'K' AND t.initial = 's')::INT) OVER (PARTITION BY p.conv_id) AS place
            FROM placed p LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.nth = p.nth WHERE p.edit <> 'D'),
        texts AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS text FROM left_over GROUP BY conv_id),
        faults AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
                count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM told GROUP BY conv_id),
        ids AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(texts.text, '')) AS repaired_sha256
        FROM ids LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM ids.conv_id""",
}
