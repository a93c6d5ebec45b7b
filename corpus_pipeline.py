"""A training-corpus pipeline over ``documents``: quality, near duplicates, personal data, mixing, token ids.

Each stage is written as Parquet in the shared folder and read again by the next. All but the last return the columns of ``documents``.
Quality drops documents that break its rules and removes boilerplate lines from the others (``n_chars`` follows); near duplicates leave one
document of each group of texts linked by a five-word Jaccard similarity of at least 0.8 (SimHash and Golay keys, verified links, then an exact check of what shares no key); personal data is masked in the
texts (``n_chars`` follows); mixing keeps every document and stores them in mixed order; the last stage gives each document's token ids
and its position and slot in the mixed order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, pii, quality, sentencepiece, similar, simhash
from tidemark.llm.common import cut, ensure_checkpoint_dir, fresh_names
from tidemark.llm.queries import WEIGHTS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op5's method with five words: SimHash, Golay keys, links verified by similarity, components; an exact check adds the similar texts that share no key."""
    return simhash.keep_least(docs, similar.classes(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs, WEIGHTS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets its place and, cut, as the encoder reads it twice, its text."""
    kind = docs.schema["doc_id"].dataType
    position, slot = fresh_names(docs, "position", "slot")
    at = mixing.placed(docs, WEIGHTS, [position, slot])  # the order that the mixing stage stored
    placed = cut(at.select(F.concat_ws(":", position, slot, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("doc_id"), "text"))
    tokens = sentencepiece.round_trip(placed)
    part = F.split("doc_id", ":", 3)
    own = F.when(part[2] != "", part[2]).cast(kind)
    return tokens.select(own.alias("doc_id"), part[0].cast("long").alias("position"), part[1].cast("long").alias("slot"), "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: SQL has no XXH64 fingerprints, pattern bootstrapping or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's token ids for ``documents``, with the place of each document in the mixed order."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
