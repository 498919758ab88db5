"""The pipeline against plain Python, stage by stage."""

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tests.llm import brute

import corpus_pipeline
from sightline.llm import bpe_fold, line_rules

SF = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = line_rules.clean(docs).select("doc_id", "quality.kept", "quality.clean_text").where("kept").collect()
    texts = {r.doc_id: r.clean_text for r in judged}
    texts = {i: t for i, t in texts.items() if brute.near(texts, corpus_pipeline.SHINGLE)[i][1] == i}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    leaks = brute.leaks(texts, items)
    texts = {i: t for i, t in texts.items() if not leaks[i][1]}
    ranks = bpe_fold.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        found = brute.secrets(texts[i])
        if not found:
            assert r.text == texts[i]
        else:
            at = found[0][0]
            assert r.text.startswith(texts[i][:at] + "[" + found[0][2].split(":")[0] + "]")
        assert r.token_ids == coder.encode_ordinary(r.text) and r.n_tokens == len(r.token_ids) and r.decodes
        assert r.n_chars == len(r.text)


def test_stages_take_odd_rows(spark):
    rows = [(1, None, "x"), (None, "short", "x"), (2, "", "x"), (3, "a " * 80, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found_secrets string").withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        kept = {"quality": 0, "near_dedup": 4, "decontaminate": 4, "redact": 4, "encode": 4}[name]
        assert out.count() == kept, name
        if name != "encode":
            assert out.columns == docs.columns
