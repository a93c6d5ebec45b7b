"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams (3 to 6 characters, word ends marked) of its distinct lower-case words, counted by
words. With p and q the smoothed document counts of a feature among toxic and other training rows, its ratio is
``log((p / |p|) / (q / |q|))``; features that tell little - an absolute ratio under ``MIN_RATIO``, or under ``LEAST_COUNT`` rows with both
smoothings - have weight 0, the rest are scaled by their ratio, and a logistic regression with an L2 penalty gives their weights.

Training uses a bounded sample of the labelled rows: about ``SAMPLE_ROWS`` of them, chosen by a hash of doc_id, so a driver that fits weights
handles the same size for any corpus. The sample's ids and labels (at most that many small rows) are broadcast to find their texts; features
and counts are made on the executors, from whole texts. A row sends each telling feature once with its count, so at most SAMPLE_ROWS x 2^BITS
numbers reach the driver (a few different texts of an id at most, TEXTS_OF_ID, and each text once), whatever the texts' lengths; rows are put in order there, so the weights do not hang on how they came. Scoring is one pass
over the documents in Arrow batches, without a shuffle.

Defined results: null and empty texts have no features and get the score of the bias alone; ids with several labels count as toxic if
one says so; null labels and null doc_ids are not learned from; with no labelled rows of both classes every score is 0; repeated rows get equal
results; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drawn

SAMPLE_ROWS = 12_000
#: Different texts of one id that are learned from.
TEXTS_OF_ID = 4
BITS = 20
LENGTHS = (3, 4, 5, 6)
MIN_RATIO, LEAST_COUNT = 1.5, 5
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Byte classes: letters and bytes of other scripts stay, digits become 0, all else parts words.
_CLASSES = bytes(c if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> np.ndarray:
    """Hashed n-grams of the distinct words of a text; an n-gram of several words comes several times."""
    found = set((text or "").lower().encode("utf-8", "ignore").translate(_CLASSES).split())
    if not found:
        return np.empty(0, np.int64)
    line = b" " + b" ".join(found) + b" "
    a = np.frombuffer(line.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.concatenate([[0], np.cumsum(a == 32)])
    out = []
    h = a
    for n in range(2, max(LENGTHS) + 1):
        m = len(a) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + a[n - 1 :]
        if n in LENGTHS:
            inner = ends[n - 1 : n - 1 + m] - ends[1 : m + 1] == 0  # a space may only come first or last
            out.append((h[inner] * _STEP + np.uint64(n)) * _STEP >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def sample(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id and label (0 or 1) of about ``rows`` labelled rows outside the held-out fold."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    return one.filter(drawn(F.xxhash64("doc_id", F.lit("toxic")), rows, one.count()))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for pdf in batches:
        for label, text in zip(pdf["label"], pdf["text"], strict=True):
            counts[label, np.unique(features(text))] += 1
    at = np.flatnonzero(counts.sum(axis=0))
    yield pd.DataFrame({"f": at, "other": counts[0, at], "toxic": counts[1, at]})


def log_ratios(train: DataFrame, n_toxic: int, n_other: int) -> np.ndarray:
    """Log-count ratio of each feature, 0 where it is small. At most 2^BITS rows reach the driver."""
    counts = train.mapInPandas(_counted, "f long, other long, toxic long").groupBy("f").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toPandas()
    p = np.ones(1 << BITS)
    q = np.ones(1 << BITS)
    p[counts["f"]] += counts["toxic"]
    q[counts["f"]] += counts["other"]
    r = np.log(p / (n_toxic + 2)) - np.log(q / (n_other + 2))
    r[(np.abs(r) < MIN_RATIO) | (p + q < LEAST_COUNT)] = 0
    return r


def fit_weights(rows: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, r: np.ndarray, rounds: int = 80, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights (ratio included) and bias of the logistic regression, by Adam on all sampled rows (features of a row, and how often it has each)."""
    at = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    used, at = np.unique(at, return_inverse=True)
    ratio = r[used]
    scale = ratio[at] * np.concatenate([*counts, np.empty(0, np.int64)])
    w, b = np.zeros(len(used)), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[at] * scale, len(rows)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        g = np.bincount(at, err[row] * scale, len(used)) + penalty / len(rows) * w
        gb = err.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.03 * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= 0.03 * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    full = np.zeros(1 << BITS, np.float32)
    full[used] = w * ratio
    return full, b


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float] | None:
    """Weights and bias learned from a bounded sample; None without rows of both classes."""
    # about that many ids; 20 standard deviations above are never reached, and would be cut off
    chosen = sample(labels, rows).orderBy(F.xxhash64("doc_id", F.lit("toxic"))).limit(rows + 20 * int(rows**0.5) + 20)
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("_content", F.xxhash64(F.coalesce("text", F.lit(""))))
    # an id may have any number of rows: its first few different texts are learned from, so the sample keeps its bound
    nth = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_content"))
    train = cut(own.dropDuplicates(["doc_id", "_content"]).withColumn("_nth", nth).filter(F.col("_nth") <= TEXTS_OF_ID).select("label", "text"))
    size = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if not size.get(0) or not size.get(1):
        return None
    ratios = log_ratios(train, size[1], size[0])
    sent = docs.sparkSession.sparkContext.broadcast(ratios != 0)

    def selected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [np.unique(x[sent.value[x]], return_counts=True) for x in map(features, pdf["text"])]
            yield pd.DataFrame({"label": pdf["label"], "f": [f.astype(np.int32) for f, _ in own], "n": [n.astype(np.int32) for _, n in own]})

    got = train.mapInPandas(selected, "label int, f array<int>, n array<int>").toPandas()
    order = sorted(range(len(got)), key=lambda i: (int(got["label"].iloc[i]), np.asarray(got["f"].iloc[i], np.int32).tobytes(), np.asarray(got["n"].iloc[i], np.int32).tobytes()))
    got = got.iloc[order]
    return fit_weights([np.asarray(x, np.int64) for x in got["f"]], [np.asarray(x, np.int64) for x in got["n"]], got["label"].to_numpy(float), ratios)


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    if model is None:
        value = F.lit(0.0)
    else:
        weights = docs.sparkSession.sparkContext.broadcast(model[0])
        bias = model[1]

        def scored(texts: pd.Series) -> pd.Series:
            w = weights.value
            z = np.array([w[features(t)].sum(dtype=np.float64) + bias for t in texts], float)
            return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        value = F.pandas_udf(scored, "double")("text")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score"))
    return rows.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
