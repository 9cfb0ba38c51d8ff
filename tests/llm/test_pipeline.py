"""Each stage of the pipeline against a plain computation on what it was given."""

import re
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from millrace.llm import pii, toxicity
from test_llm_queries import brute_targets
from test_near_copies import brute


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = rows(docs) if name != "toxicity" else None
        out = stage(spark, docs, sf_dir)
        if name != "sentencepiece":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = rows(docs)
        if name == "simhash":
            ranked = sorted(before, key=lambda r: (r[0] is None, r[0] or 0))
            assert Counter(r[0] for r in kept[name]) == Counter(ranked[i][0] for i in brute([(i, r[1]) for i, r in enumerate(ranked)]))
            assert all(r in before for r in kept[name])
        if name == "pii":
            assert Counter(r[1] for r in kept[name]) == Counter(None if r[1] is None else pii.redact(r[1]) for r in before)
        if name == "mixing":
            count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            sizes, taken, most = Counter(), Counter(), Counter()
            for r in before:
                sizes[r[3]] += count(r[1])
                most[r[3]] = max(most[r[3]], count(r[1]))
            for r in kept[name]:
                taken[r[3]] += count(r[1])
            for s, want in brute_targets(dict(sizes)).items():
                assert -1 <= taken[s] - want <= most[s]
            assert set(kept[name]) <= set(before)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = Counter(len(library.encode(r[1] or "")) for r in kept["mixing"])
    assert Counter(r.n_tokens for r in docs.collect()) == texts


def test_toxic_rows_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.with_score(docs, toxicity.train(docs, labels)).collect()
    want = Counter(r.text for r in scored if r.score < toxicity.TOXIC)
    assert Counter(r.text for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).collect()) == want


def test_whole_run_and_empty_tables(spark, sf_dir, empty_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
