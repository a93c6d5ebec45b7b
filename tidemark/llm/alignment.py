"""Alignment of two tokenizers over the same bytes, by galloping intersection of their token ends.

Each document is encoded by both; the ends of its tokens are two rising lists. The shorter one drives: each of its ends is looked for in the longer
list by steps that double from where an earlier end was found, then by halving between the last two steps. Ends that both have cut the document into groups,
and the ranks give the rest: the tokens of the longer list that overlap a token of the shorter one lie from the rank of its start to the rank of its end. The
searches of all documents of a batch run side by side.

Scale: the first pass encodes each text once, writes a document's row with its distinct linked id pairs and their counts (compressed), and is cut by a checkpoint.
Counts of pairs are added up in each task and then over the corpus. The ``HOT`` pairs of largest count and one best count for each id of the second tokenizer
(no more than its vocabulary) go to all tasks; every other pair of a document is joined to its count. No pair left for the join has a count above that of any hot
one, so none is hot there, and only pairs that are rare beside the corpus travel.

Defined results: null and empty texts, and those that a tokenizer does not give back byte by byte, have no tokens: zeros and an empty hash. Equal texts give equal rows, each
counts in the corpus; rows that share an id or have none are told apart by a number of their own; an empty table gives no rows; extra columns are left out;
a very long text is aligned whole, in memory in proportion to its tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.tokens import ByteTokens, PieceTokens, batches

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs whose counts go to all tasks: 16 bytes each.
HOT = 1 << 18
#: Ends of the shorter list that start from one end found before them.
STRIDE = 8
#: Distinct pairs that a task adds up at a time.
PAIRS_AT_ONCE = 2_000_000


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each number of a rising list, how many of a longer rising list are smaller."""
    n, m = len(short), len(long)
    at = np.zeros(n, np.int64)
    if n > STRIDE:
        at = np.repeat(gallop(short[::STRIDE], long), STRIDE)[:n]
    # all before ``at`` are smaller; double the step while what it reaches is smaller too
    out = at.copy()
    live = np.flatnonzero(at < m)
    live = live[long[at[live]] < short[live]]
    low, step, found, lows, highs = at[live], 1, [], [], []
    while len(live):
        probe = np.minimum(low + step, m)
        smaller = (probe < m) & (long[np.minimum(probe, m - 1)] < short[live])
        found.append(live[~smaller])
        lows.append(low[~smaller])
        highs.append(probe[~smaller])
        live, low, step = live[smaller], probe[smaller], step * 2
    if not found:
        return out
    live, low, high = np.concatenate(found), np.concatenate(lows), np.concatenate(highs)  # long[low] is smaller, long[high] is not
    while True:
        open_ = high - low > 1
        out[live[~open_]] = high[~open_]
        live, low, high = live[open_], low[open_], high[open_]
        if not len(live):
            return out
        middle = (low + high) >> 1
        smaller = long[middle] < short[live]
        low, high = np.where(smaller, middle, low), np.where(smaller, high, middle)


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the ends that both have, and the ranks of the shorter list's ends in the longer one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    rank = gallop(short, long)
    both = np.flatnonzero(long[np.minimum(rank, len(long) - 1)] == short) if len(long) else np.empty(0, np.int64)
    return (both, rank[both], rank) if len(a) <= len(b) else (rank[both], both, rank)


def overlaps(rank: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (short, long) of tokens that overlap, from the ranks of the shorter list's ends and its common ones."""
    shared = np.zeros(len(rank), np.int64)
    shared[both] = 1
    first = np.zeros(len(rank), np.int64)
    first[1:] = rank[:-1] + shared[:-1]
    n = rank - first + 1
    short = np.repeat(np.arange(len(rank)), n)
    before = np.cumsum(n) - n
    return short, np.arange(len(short)) - before[short] + first[short]


class Aligner:
    """Both tokenizers with the byte lengths of their ids."""

    #: What follows an id in the groups' text.
    MARKS = (",", "|", ";")

    def __init__(self, a_file: str, b_file: str):
        self.a, self.b = ByteTokens(a_file, special=False), PieceTokens(b_file)
        self.sizes = [np.array([len(x) for x in t.bytes_of], np.int64) for t in (self.a, self.b)]
        self.names = [f"{i}{m}" for i in range(max(map(len, self.sizes))) for m in self.MARKS]

    def encoded(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both tokenizers for each text, or None where one does not give its bytes."""
        led = [f" {t}" for t in texts]
        out = []
        for text, x, y in zip(led, self.a.encode(led), self.b.encode(texts), strict=True):
            raw = text.encode()
            same = len(raw) > 1 and b"".join(map(self.a.bytes_of.__getitem__, x)) == raw == b"".join(map(self.b.bytes_of.__getitem__, y))
            out.append((x, y) if same else None)
        return out

    def aligned(self, texts: list[str]) -> list[tuple[int, int, int, int, str, np.ndarray] | None]:
        """n_a, n_b, n_groups, n_links, groups' hash and the linked id pairs (a * size of b + b) of each text."""
        found = self.encoded(texts)
        out: list = [None] * len(texts)
        for by_a in (True, False):  # documents whose shorter list is the first one's, and the others
            own = [i for i, f in enumerate(found) if f is not None and (len(f[0]) <= len(f[1])) == by_a]
            if own:
                for i, row in zip(own, self._batch([found[i] for i in own], by_a), strict=True):
                    out[i] = row
        return out

    def _batch(self, pairs: list[tuple[list[int], list[int]]], by_a: bool) -> Iterator[tuple]:
        n = np.array([[len(x), len(y)] for x, y in pairs], np.int64).T
        ids = [np.array([i for p in pairs for i in p[side]], np.int64) for side in (0, 1)]
        # documents lie one behind the other, so the last ends of one are common and nothing overlaps the next
        ends = [np.cumsum(size[i]) for size, i in zip(self.sizes, ids, strict=True)]
        lead, other = (0, 1) if by_a else (1, 0)
        rank = gallop(ends[lead], ends[other])
        both = np.flatnonzero(ends[other][rank] == ends[lead])
        at = [both, rank[both]] if by_a else [rank[both], both]
        short, long = overlaps(rank, both)
        a, b = (short, long) if by_a else (long, short)
        codes = ids[0][a] * len(self.sizes[1]) + ids[1][b]
        until = np.cumsum(n, axis=1)
        groups = np.searchsorted(at[0], until[0] - 1, side="right")
        links = np.searchsorted(short, until[lead] - 1, side="right")
        shown = self._shown(ids, at)
        stop = until[0] + until[1]
        g = k = s = 0
        for d in range(len(pairs)):
            text = "".join(map(self.names.__getitem__, shown[s : stop[d]].tolist()))[:-1]
            yield int(n[0, d]), int(n[1, d]), int(groups[d] - g), int(links[d] - k), hashlib.sha256(text.encode()).hexdigest(), codes[k : links[d]]
            g, k, s = groups[d], links[d], stop[d]

    def _shown(self, ids: list[np.ndarray], at: list[np.ndarray]) -> np.ndarray:
        """Names of the ids with what follows them, in the order of the groups' text: a group's ids of the first tokenizer, then those of the second."""
        out = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for side in (0, 1):
            last = at[side]
            mark = np.zeros(len(ids[side]), np.int64)
            mark[last] = 1 + side
            sizes = np.diff(last, prepend=-1)
            other = np.concatenate([[0], at[1][:-1] + 1]) if side == 0 else at[0] + 1  # ids of the other one that come before a group's own
            out[np.arange(len(mark)) + np.repeat(other, sizes)] = ids[side] * len(self.MARKS) + mark
        return out


@lru_cache(1)
def _aligner(a_file: str, b_file: str) -> Aligner:
    return Aligner(a_file, b_file)


def _pressed(codes: np.ndarray) -> bytes:
    """Distinct pairs, as steps, and their counts."""
    keys, n = np.unique(codes, return_counts=True)
    return pa.compress(np.diff(keys, prepend=0).astype(np.int64).tobytes() + n.astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def _opened(size: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(data, decompressed_size=12 * size, codec="zstd")
    return np.cumsum(np.frombuffer(raw, np.int64, size)), np.frombuffer(raw, np.int32, size, 8 * size).astype(np.int64)


_ROW = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long, pairs binary"


def _first(a_file: str, b_file: str, name: str):
    def run(columns: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_file, b_file)
        for batch in columns:
            ids, at = batch.column(0), 0
            for few in batches(t or "" for t in batch.column(1).to_pylist()):
                rows = []
                for r in aligner.aligned(few):
                    if r is None:
                        rows.append((0, 0, 0, 0, "", 0, b""))
                    else:
                        rows.append((*r[:5], len(np.unique(r[5])), _pressed(r[5])))
                kinds = (pa.int64(),) * 4 + (pa.string(), pa.int64(), pa.binary())
                cells = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(few)), *cells], [name, *[x.split()[0] for x in _ROW.split(", ")]])
                at += len(few)

    return run


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, counts = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(every, kind="stable")
    every = every[order]
    start = np.flatnonzero(np.diff(every, prepend=-1))
    return every[start], np.add.reduceat(counts[order], start) if len(start) else counts


def _count(columns: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs of a task's documents."""
    keys: list[np.ndarray] = []
    n: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        k, c = _summed(keys, n)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["pair", "n"])

    for batch in columns:
        for pairs, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if pairs:
                k, c = _opened(pairs, data.as_py())
                keys.append(k)
                n.append(c)
                size += pairs
            if size > 2 * PAIRS_AT_ONCE:
                k, c = _summed(keys, n)
                keys, n, size = [k], [c], len(k)
                if size > PAIRS_AT_ONCE:
                    yield out()
                    keys, n, size = [], [], 0
    if keys:
        yield out()


def _second(sent, b_size: int):
    """row, n_best and count_sum over a document's hot pairs, and its other pairs with their counts in it."""
    def run(columns: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, counts, best = sent.value
        for batch in columns:
            rows, best_sum, count_sum, cold, times = batch.column(0), [], [], [], []
            for pairs, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                k, c = _opened(pairs, data.as_py()) if pairs else (np.empty(0, np.int64), np.empty(0, np.int64))
                at = np.minimum(np.searchsorted(hot, k), max(0, len(hot) - 1))
                known = hot[at] == k
                total = counts[at[known]]
                best_sum.append(int(c[known][total == best[k[known] % b_size]].sum()))
                count_sum.append(int((c[known] * total).sum()))
                cold.append(k[~known])
                times.append(c[~known])
            lists = lambda x: pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum([len(y) for y in x])]).astype(np.int64), pa.array(np.concatenate([*x, np.empty(0, np.int64)]))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(best_sum, pa.int64()), pa.array(count_sum, pa.int64()), lists(cold), lists(times)], ["row", "n_best", "count_sum", "pair", "times"])

    return run


def align(docs: DataFrame, *, id: str = "doc_id", text: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, hot: int = HOT) -> DataFrame:  # noqa: A002
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    A link is a pair of overlapping tokens; a pair of ids counts as often as links of the corpus have it. n_best: links whose pair has the largest count of its
    second id; count_sum: the sum of the counts of all links' pairs.
    """
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()
    rows = cut(docs.select(id, text).mapInArrow(_first(a_file, b_file, id), f"`{id}` {kind}, {_ROW}").withColumn("_row", F.monotonically_increasing_id()))
    counts = cut(rows.select("n_pairs", "pairs").filter("n_pairs > 0").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b_size = PieceTokens(b_file).library.get_piece_size()
    top = counts.orderBy(F.desc("n"), "pair").limit(hot).toPandas().sort_values("pair")
    most = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("n")).toPandas()  # one row for each id of the second tokenizer
    best = np.zeros(b_size, np.int64)
    best[most["b"].to_numpy(np.int64)] = most["n"].to_numpy(np.int64)
    # an empty table of hot pairs still needs a place to look at
    sent = spark.sparkContext.broadcast((np.append(top["pair"].to_numpy(np.int64), [-1] if top.empty else []).astype(np.int64), np.append(top["n"].to_numpy(np.int64), [0] if top.empty else []).astype(np.int64), best))
    part = rows.select(F.col("_row").alias("row"), "n_pairs", "pairs").mapInArrow(_second(sent, b_size), "row long, n_best long, count_sum long, pair array<long>, times array<long>")
    part = cut(part)
    cold = part.filter(F.size("pair") > 0).select("row", F.inline(F.arrays_zip("pair", "times")))
    bests = spark.createDataFrame([], "b long, most long") if most.empty else spark.createDataFrame([(int(b), int(n)) for b, n in zip(most["b"], most["n"], strict=True)], "b long, most long")
    found = cold.join(counts, "pair").withColumn("b", F.col("pair") % b_size).join(F.broadcast(bests), "b")
    more = found.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    own = part.select(F.col("row").alias("_row"), "n_best", "count_sum").join(more.withColumnRenamed("row", "_row"), "_row", "left")
    out = rows.drop("n_pairs", "pairs").join(own, "_row")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return out.select(id, "n_a", "n_b", "n_groups", "n_links", plus("n_best", "_best"), plus("count_sum", "_sum"), "groups_sha256")
