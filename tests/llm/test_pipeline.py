"""The pipeline on the smallest tables against brute force, stage by stage."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from tests_llm_brute import base_kept, plain_personal_data, plain_roots

from tidemark.llm import sentencepiece


def test_pipeline_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    staged = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        staged = stage(spark, staged, small)
        if name != "token_ids":
            assert staged.columns == docs.columns
        staged = staged.cache()
        seen[name] = {r["doc_id"]: r for r in staged.collect()}

    kept = {i for i, t in texts.items() if base_kept(t)}
    assert set(seen["quality"]) == kept  # no line of these tables is above its host's limit
    # the stage's own rule: five words, a similarity of 0.8 or more (op5's four bits are the rule of its query only)
    order = sorted(kept)
    roots = plain_roots([texts[i] for i in order])
    assert set(seen["near_duplicates"]) == {order[k] for k in roots}
    for i, r in seen["pii"].items():
        assert not plain_personal_data(r["text"]) and r["n_chars"] == len(r["text"])
        if not re.search(r"[0-9@=]", texts[i]):
            assert r["text"] == texts[i]
    assert {i: r["text"] for i, r in seen["mixing"].items()} == {i: r["text"] for i, r in seen["pii"].items()}

    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=sentencepiece.MODEL)
    for i, r in seen["token_ids"].items():
        assert r["ids"] == library.encode(seen["mixing"][i]["text"]) and r["round_trip"]


def test_run_returns_the_last_stage(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.filter(F.col("round_trip")).count() == got.count() > 100
