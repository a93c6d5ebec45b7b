"""Near copies by exact similarity against brute force."""

import itertools
import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tests_llm_brute import plain_roots

from tidemark.llm import graph, similar, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "a", len(t or "")) for i, t in rows], DOCS)


def test_pairs_equal_brute_force(spark):
    pick = random.Random(11)
    words = lambda n: [f"w{pick.randint(0, 5000)}" for _ in range(n)]
    shared, texts = " ".join(words(40)), []
    for g in (words(pick.choice((9, 60, 150, 300))) for _ in range(14)):
        for edits in (0, 1, 2, 3, 4, 5, 6, 8):
            copy = list(g)
            for _ in range(edits * max(1, len(g) // 150)):
                copy[pick.randrange(len(g))] = f"edit{pick.random()}"
            texts.append(" ".join(copy))
    texts += [f"{' '.join(words(60))} {shared}" for _ in range(25)] + [texts[3].upper(), "", None, " ", "one two", "one two", "two one"]
    expected = plain_roots(texts)
    kept = corpus_pipeline.near_duplicate_stage(spark, frame(spark, enumerate(texts)), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected))


def test_stage_on_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").dropDuplicates(["doc_id"])
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    expected = {rows[i][0] for i in plain_roots([t for _, t in rows])}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, small).collect()} == expected


def test_sketches_lose_no_similar_pair():
    pick = np.random.default_rng(3)
    far = 0
    for n in (1, 4, 40, 300, 2_000):
        a = np.unique(pick.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0, 0.05, 0.1, 0.2, 0.4, 1):
            keep = a[pick.random(len(a)) >= share]
            b = np.unique(np.concatenate([keep, pick.integers(0, 1 << 63, len(a) - len(keep)).astype(np.uint64)]))
            bits = sum(int(x).bit_count() for x in (similar.sketch(a) ^ similar.sketch(b)).view(np.uint64))
            assert bits <= len(np.setxor1d(a, b))
            far += share >= 0.4 and bits > (len(a) + len(b)) / 9
    assert far >= 6  # sketches tell sets apart


def test_fingerprints_of_sets_equal_plain_loops():
    pick = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 40_000):
        h = np.unique(pick.integers(0, 1 << 63, n).astype(np.uint64))
        got = simhash.set_prints(h, 3).view(np.uint64)
        assert int(got[0]) == sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
        assert n < 7 or len(set(got.tolist())) == 3  # each of its own bits


def test_golay_keys_link_near_fingerprints_and_links_are_similar(spark):
    pick = random.Random(5)
    texts = []
    for _ in range(12):
        g = [f"w{pick.randint(0, 5000)}" for _ in range(200)]
        for edits in (0, 1, 1, 2, 3, 5, 7, 12):
            copy = list(g)
            for _ in range(edits):
                copy[pick.randrange(len(g))] = f"edit{pick.random()}"
            texts.append(" ".join(copy))
    docs = frame(spark, enumerate(texts))
    rows = docs.select("doc_id", F.xxhash64("text").alias("content"), "text").mapInArrow(similar._nodes(5), "doc_id long, content long, node long, size int, sketch array<long>, prints array<long>").cache()
    found = [tuple(r) for r in similar.key_links(docs, rows.drop("doc_id").dropDuplicates(["node"])).collect()]
    own = {r["node"]: (set(similar.shingles(texts[r["doc_id"]]).tolist()), [p & (1 << 64) - 1 for p in r["prints"]]) for r in rows.collect()}
    alike = lambda u, v: 5 * len(own[u][0] & own[v][0]) >= 4 * len(own[u][0] | own[v][0])
    assert found and all(alike(u, v) for u, v in found)
    root = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(found, "u long, v long")).collect()}
    reached = [(u, v) for u, v in itertools.combinations(own, 2) if alike(u, v) and any((a ^ b).bit_count() <= simhash.MOST_BITS for a, b in zip(own[u][1], own[v][1], strict=True))]
    assert len(reached) > 20 and all(root.get(u, u) == root.get(v, v) for u, v in reached)


def test_the_stage_links_by_golay_keys_first(spark, monkeypatch):
    g = [f"w{i}" for i in range(300)]
    docs = frame(spark, enumerate([" ".join(g), " ".join([*g[:-1], "x"]), " ".join(g[::-1])]))
    monkeypatch.setattr(similar, "_prefixes", lambda *_: lambda batches: iter(()))  # without the exact check
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [0, 2]
