"""Language of words and documents by a linear-chain conditional random field.

Each word has hashed features: affixes and character n-grams of its bytes, and, in a table of their own, whole words (the lexicon). Their weights and learned transitions
between languages label the words of a text, which may switch languages, by forward-backward; a document takes the language with
the largest sum of word posteriors.

Forward-backward is exact on whole texts and still short: a text falls into blocks of ``BLOCK`` words, each block gives its transfer matrix, the
matrices are combined in order, and then the blocks' posteriors are found side by side. All of it is in numpy over many texts at once.

Training uses a bounded sample: about ``SAMPLE_ROWS`` rows with a language outside the held-out fold (never over twice that and 1,000), chosen by a hash of doc_id and text, with
``MOST_WINDOWS`` windows of ``WINDOW`` words at most, which lie all over a longer text. Windows of different rows are put together, so switches occur and transitions are learned. The model holds one row
of weights for each language that the rows name.

Defined results: a text without a letter, empty or null, gets ``und`` and score 0; rows with a null language or doc_id are not learned from; with nothing
to learn from every text is ``und``; repeated rows get equal results; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drawn

SAMPLE_ROWS = 600
WINDOW, JOINED = 32, 3
#: Windows of one text that are learned from.
MOST_WINDOWS = 512
FOLDS, HELD_OUT = 3, 1
BITS, BLOCK = 17, 64
#: Words that are labelled together.
WORDS_AT_ONCE = 200_000
_CLASSES = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "ignore").translate(_CLASSES).split()


def word_features(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs: all 2- to 4-byte runs with word ends marked - those at an end are the affixes - and, from 2^BITS on, whole words."""
    a = np.frombuffer(b" " + b" ".join(ws) + b" ", np.uint8)
    lens = np.fromiter(map(len, ws), np.int64, len(ws))
    starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    owner = np.repeat(np.arange(len(ws)), lens + 1)
    ends = np.concatenate([[0], np.cumsum(a == 32)])
    who, what = [], []
    h = a.astype(np.uint64)
    for n in (2, 3, 4):
        m = len(a) - n + 1
        h = h[:m] * np.uint64(263) + a[n - 1 :]
        inner = np.flatnonzero(ends[n - 1 : n - 1 + m] - ends[1 : m + 1] == 0)
        inner = inner[inner < len(owner)]
        who.append(owner[inner])
        what.append((h[inner] * _STEP + np.uint64(n)) * _STEP >> np.uint64(64 - BITS))
    codes = (a.astype(np.uint64) + np.uint64(1)) * (np.arange(len(a), dtype=np.uint64) - np.repeat(starts, np.append(lens[:-1] + 1, lens[-1] + 2)).astype(np.uint64) + np.uint64(7)) * _STEP
    codes ^= codes >> np.uint64(29)
    whole = np.add.reduceat(codes, starts)
    who.append(np.arange(len(ws)))
    what.append((whole * _STEP >> np.uint64(64 - BITS)) + np.uint64(1 << BITS))
    return np.concatenate(who), np.concatenate(what).astype(np.int64)


def emissions(ws: list[bytes], weights: np.ndarray) -> np.ndarray:
    """(word, language) scores."""
    who, what = word_features(ws)
    return np.stack([np.bincount(who, weights[what, k], len(ws)) for k in range(weights.shape[1])], axis=1)


def _blocks(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks per text, and for each block its text and its place in the text."""
    per = -(-lens // BLOCK)
    text = np.repeat(np.arange(len(lens)), per)
    return per, text, np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)


def posteriors(e: np.ndarray, lens: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word posteriors of texts given one after the other in ``e``; with ``pairs`` also the summed posteriors of neighbouring labels."""
    n_lang = e.shape[1]
    T = np.exp(trans)
    per, text, place = _blocks(lens)
    n = len(text)
    first = (np.cumsum(lens) - lens)[text] + place * BLOCK
    at = first[:, None] + np.arange(BLOCK)
    live = at < (np.cumsum(lens))[text][:, None]
    p = np.exp(e - e.max(axis=1, keepdims=True))
    p = p[np.where(live, at, 0)]  # (blocks, BLOCK, languages)
    M = np.broadcast_to(np.eye(n_lang), (n, n_lang, n_lang)).copy()
    for t in range(BLOCK):
        on = live[:, t]
        step = (M[on] @ T) * p[on, t][:, None, :]
        M[on] = step / step.max(axis=(1, 2), keepdims=True)
    # combine blocks in order: what comes into each block from the left and from the right
    left, right = np.ones((n, n_lang)) / n_lang, np.ones((n, n_lang))
    start = np.cumsum(per) - per
    for k in range(1, int(per.max(initial=0))):
        b = (start + k)[per > k]
        v = np.einsum("ni,nij->nj", left[b - 1], M[b - 1])
        left[b] = v / v.sum(axis=1, keepdims=True)
        b = (start + per - 1 - k)[per > k]
        v = np.einsum("nij,nj->ni", M[b + 1], right[b + 1])
        right[b] = v / v.max(axis=1, keepdims=True)
    alpha = np.empty((BLOCK, n, n_lang))
    before = np.empty((BLOCK, n, n_lang)) if pairs else None
    v = left
    for t in range(BLOCK):
        if pairs:
            before[t] = v
        s = (v @ T) * p[:, t]
        v = np.where(live[:, t][:, None], s / s.sum(axis=1, keepdims=True), v)
        alpha[t] = v
    out = np.empty_like(e)
    seen = np.zeros((n_lang, n_lang))
    v = right
    for t in range(BLOCK - 1, -1, -1):
        on = live[:, t]
        g = alpha[t][on] * v[on]
        out[at[on, t]] = g / g.sum(axis=1, keepdims=True)
        pv = p[:, t] * v
        if pairs:
            x = before[t][on][:, :, None] * T * pv[on][:, None, :]
            seen += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        s = pv @ T.T
        v = np.where(on[:, None], s / s.max(axis=1, keepdims=True), v)
    return out, seen


def train(windows: list[tuple[int, list[bytes]]], n_lang: int, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Weights (2 x 2^BITS, languages) and transitions by Adam on the likelihood of the windows, joined JOINED at a time in turn of language."""
    random = np.random.default_rng(7)
    by = [[w for k, w in windows if k == lang] for lang in range(n_lang)]
    most = max(map(len, by))
    order = [(lang, by[lang][i % len(by[lang])]) for lang in range(n_lang) for i in range(min(most, 3 * len(by[lang])))]
    order = [order[i] for i in random.permutation(len(order))]
    seqs = [order[i : i + JOINED] for i in range(0, len(order), JOINED)]
    lens = np.array([sum(len(w) for _, w in s) for s in seqs])
    flat = [w for s in seqs for _, ws in s for w in ws]
    gold = np.array([k for s in seqs for k, ws in s for _ in ws])
    ids, vocabulary = pd.factorize(np.array(flat, dtype=object))
    who, what = word_features(list(vocabulary))
    W, T = np.zeros((2 << BITS, n_lang)), np.zeros((n_lang, n_lang))
    used, what = np.unique(what, return_inverse=True)
    U = np.zeros((len(used), n_lang))
    m, v, mT, vT = np.zeros_like(U), np.zeros_like(U), np.zeros_like(T), np.zeros_like(T)
    onehot = np.eye(n_lang)[gold]
    firsts = np.zeros(len(gold), bool)
    firsts[np.cumsum(lens) - lens] = True
    same = np.zeros((n_lang, n_lang))
    np.add.at(same, (gold[:-1][~firsts[1:]], gold[1:][~firsts[1:]]), 1)
    for t in range(1, rounds + 1):
        ew = np.stack([np.bincount(who, U[what, k], len(vocabulary)) for k in range(n_lang)], axis=1)
        post, seen = posteriors(ew[ids], lens, T, pairs=True)
        d = (post - onehot) / len(gold)
        dw = np.stack([np.bincount(ids, d[:, k], len(vocabulary)) for k in range(n_lang)], axis=1)
        g = np.stack([np.bincount(what, dw[who, k], len(used)) for k in range(n_lang)], axis=1) + 1e-7 * U
        gT = (seen - same) / len(gold) + 1e-4 * T
        m, v, mT, vT = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mT + 0.1 * gT, 0.99 * vT + 0.01 * gT * gT
        c, q = 1 - 0.9**t, 1 - 0.99**t
        U -= 0.1 * (m / c) / (np.sqrt(v / q) + 1e-10)
        T -= 0.1 * (mT / c) / (np.sqrt(vT / q) + 1e-10)
    W[used] = U
    return W.astype(np.float32), T


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        langs, parts = [], []
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            ws = words_of(text)
            step = WINDOW * max(1, -(-len(ws) // (WINDOW * MOST_WINDOWS)))  # of a very long text, windows all over it
            for at in range(0, len(ws), step):
                langs.append(lang)
                parts.append(b" ".join(ws[at : at + WINDOW]))
        yield pd.DataFrame({"lang": langs, "part": parts})


Model = tuple[list[str], np.ndarray, np.ndarray]


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    # drawn by id and text, so a repeated id gives no more rows than others; equal rows count once
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    draw = F.xxhash64(F.col("doc_id").cast("string"), content, F.lit("lang"))
    each = -(-rows // len(sizes))
    taken = F.coalesce(*[F.when(F.col("lang") == lang, drawn(draw, each, n)) for lang, n in sizes.items()])
    few = known.filter(taken).withColumns({"_content": content, "_draw": draw}).dropDuplicates(["doc_id", "lang", "_content"])
    got = few.orderBy("_draw").limit(2 * rows + 1_000).select("lang", "text").mapInPandas(_windows, "lang string, part binary").toPandas()
    langs = sorted(got["lang"].unique())
    if not langs:
        return None
    got = got.sort_values(["lang", "part"])
    return langs, *train([(langs.index(k), bytes(p).split()) for k, p in zip(got["lang"], got["part"], strict=True)], len(langs))


def label(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    """Language and score of each text."""
    langs, weights, trans = model
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    todo: list[int] = []
    flat: list[bytes] = []
    lens: list[int] = []

    def flush() -> None:
        if not todo:
            return
        ids, vocabulary = pd.factorize(np.array(flat, dtype=object))
        post, _ = posteriors(emissions(list(vocabulary), weights)[ids], np.array(lens), trans)
        sums = np.add.reduceat(post, np.cumsum(lens) - lens, axis=0)
        sums /= sums.sum(axis=1, keepdims=True)
        for i, s in zip(todo, sums, strict=True):
            out[i] = (langs[int(s.argmax())], float(s.max()))
        todo.clear()
        flat.clear()
        lens.clear()

    for i, text in enumerate(texts):
        if text and _LETTER.search(text) and (ws := words_of(text)):
            todo.append(i)
            flat += ws
            lens.append(len(ws))
            if len(flat) >= WORDS_AT_ONCE:
                flush()
    flush()
    return out


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = fit(docs)
    if model is None:
        found = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def labelled(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(label(list(texts), sent.value), columns=["lang_pred", "score"])

        found = F.pandas_udf(labelled, "lang_pred string, score double")("text")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("_x"))
    return rows.select("doc_id", "held_out", "_x.lang_pred", "_x.score")
