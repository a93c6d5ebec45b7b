"""SimHash near-duplicates with Golay-code fuzzy hashing.

Fingerprints of 64 bits are linked when they differ in at most 4 bits. The bits form three segments (22, 22 and 20 bits) of two
halves each. Each segment, padded to 23 bits, is decoded with the perfect binary Golay code (23, 12): the keys of a word are the codeword
indices of the 24 words within one bit of it (1 or 6 different ones), so any two words within two bits share a key.

Pigeonhole: of 4 errors in three segments, either some segment is free of errors and one of the other two has at most 2, or each has an
error and so two segments have exactly one, hence a half free of errors each, and the third has at most 2. Thus one of 18 combinations of two exact
halves (20 to 22 bits) and the Golay key (12 bits) of a third segment agrees. So any two fingerprints within 4 bits share a key.

The fingerprints of a key are first compared with one of them, its hub. The verified links give components; then those of a key that lie in
different components are compared, so each pair of a key is either compared or linked already, and a family of near copies makes about as many
links as it has members, not all pairs. The second links join components, which gives the result.

Scale: only distinct fingerprints are keyed (copies were merged by a map-side combined aggregation), about 96 keys each; a third part of
one fingerprint costs one row. Links then give connected components by star contraction with checkpoints. Hot fingerprints, keys and components
are joined by ``join_hot``.

Defined results: null and blank texts have fingerprint 0 and are linked like any other; null doc_ids never name a component unless all
its ids are null; repeated rows get equal results; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, cut, fresh_names, if_small, join_hot, text_of
from tidemark.llm.graph import components

#: Words to a shingle of the registered query and its XXH64 seed.
SHINGLE, SEED = 4, 42
MOST_BITS = 4
#: (first bit, bits) of each segment's two halves.
HALVES = (((0, 11), (11, 11)), ((22, 11), (33, 11)), ((44, 10), (54, 10)))
#: Combinations: the exact halves (segment, half) and the segment that gives the Golay key.
COMBOS = [(((j, 0), (j, 1)), i) for j in range(3) for i in range(3) if i != j] + [
    (((i, p), (j, q)), 3 - i - j) for i, j in ((0, 1), (0, 2), (1, 2)) for p in (0, 1) for q in (0, 1)
]
GENERATOR = 0b110001110101
#: Room for the bits of two exact halves; a key is the combination, these bits and 12 bits of codeword index.
EXACT_BITS = 22
#: Bits of a key: 5 for the combination, the exact bits, and 12; the fingerprint's number stands above them.
KEY_BITS = 5 + EXACT_BITS + 12


def simhash(text: str | None, n: int = SHINGLE) -> int:
    """Fingerprint of one text: ASCII letters lower-cased, words between ASCII white space, n-word shingles."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    line = b" ".join(ws)
    ends = list(accumulate((len(w) + 1 for w in ws)))
    starts = [0, *ends[:-1]]
    last = max(1, len(ws) - n + 1)
    width = min(n, len(ws)) - 1
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, last, 1 << 15):
        h = np.array([digest(line[starts[i] : ends[i + width] - 1], SEED) for i in range(at, min(last, at + (1 << 15)))], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > last, bitorder="little").view("<i8")[0])


def set_prints(hashes: np.ndarray, n: int) -> np.ndarray:
    """n fingerprints, as longs, of a set of 64-bit shingle hashes: SimHash over the set, each with its own bits of every hash."""
    out, h = np.zeros(n, np.int64), hashes
    for k in range(n):
        if k:  # a bijection, so as good as another seed
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            h = h ^ (h >> np.uint64(29))
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 15):
            counts += np.unpackbits(h[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0]
    return out


def _simhash_column(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every document."""
    return docs.select("doc_id", F.pandas_udf(_simhash_column, "long")("text").alias("fp"))


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 23 single bits, and the error pattern of weight at most 3 of each of the 2048 syndromes."""
    bit = []
    for k in range(23):
        r = 1 << k
        for j in range(22, 10, -1):
            if r >> j & 1:
                r ^= GENERATOR << (j - 11)
        bit.append(r)
    leader = np.zeros(2048, np.int64)
    for a in range(23):
        leader[bit[a]] = 1 << a
        for b in range(a):
            leader[bit[a] ^ bit[b]] = 1 << a | 1 << b
            for c in range(b):
                leader[bit[a] ^ bit[b] ^ bit[c]] = 1 << a | 1 << b | 1 << c
    return np.array(bit, np.int64), leader


def golay_keys(segment: np.ndarray) -> np.ndarray:
    """(n, 24) codeword indices of the words within one bit of each 23-bit word; column 0 is the word itself."""
    bit, leader = _golay()
    syndrome = np.zeros_like(segment)
    for k in range(23):
        syndrome ^= np.where(segment >> k & 1, bit[k], 0)
    flips = np.concatenate([[0], 1 << np.arange(23)])
    shifts = np.concatenate([[0], bit])
    near = segment[:, None] ^ flips[None, :]
    return (near ^ leader[syndrome[:, None] ^ shifts[None, :]]) >> 11


def _bits(fp: np.ndarray, first: int, n: int) -> np.ndarray:
    return (fp >> np.uint64(first) & np.uint64((1 << n) - 1)).astype(np.int64)


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of unsigned fingerprints: the row is the fingerprint's place in ``fp``."""
    golay = []
    for (a, n), (_, m) in HALVES:
        keys = golay_keys(_bits(fp, a, n + m))
        keys.sort(axis=1)
        fresh = np.ones(keys.shape, bool)
        fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
        row, col = np.nonzero(fresh)
        golay.append((row, keys[row, col]))
    out = []
    for c, (exact, segment) in enumerate(COMBOS):
        head = np.zeros(len(fp), np.int64)
        for s, half in exact:
            first, n = HALVES[s][half]
            head = head << n | _bits(fp, first, n)
        head |= c << EXACT_BITS
        row, index = golay[segment]
        out.append((head[row] << 12 | index, row))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def key_rows(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fp) of unsigned fingerprints."""
    key, row = keys_of(fp)
    return key, fp[row].view(np.int64)


def _emit_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            few = batch.slice(at, 1000)
            node = few.column(0).to_numpy(zero_copy_only=False)
            fp = few.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(node), -1)
            for k in range(fp.shape[1]):
                key, row = keys_of(np.ascontiguousarray(fp[:, k]))
                yield pa.RecordBatch.from_arrays([pa.array(key | k << KEY_BITS), pa.array(node[row])], ["token", "node"])


def shared_keys(nodes: DataFrame) -> DataFrame:
    """token, node and hub for the Golay keys that two or more of ``nodes`` (node, prints: arrays of fingerprints) have.

    Of P fingerprints that differ in 5 P - 1 bits at most, one pair differs in MOST_BITS at most and so shares a key; most pairs some bits further apart share one too.
    A key's hub is the node of least hash, the same for most keys of a family.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = nodes.select("node", "prints").repartition(parts, "node").mapInArrow(_emit_nodes, "token long, node long").repartition(parts, "token")
    near = Window.partitionBy("token")
    held = keys.withColumns({"_hub": F.min(F.struct(F.xxhash64("node").alias("h"), "node")).over(near), "_n": F.count("*").over(near)}).filter("_n > 1")
    return cut(held.select("token", "node", F.col("_hub.node").alias("hub")))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for at in range(0, len(fp), 2000):
            key, own = key_rows(fp[at : at + 2000])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own)], ["key", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """Edges u, v that connect just those distinct fingerprints (column fp, no repeats) that chains of pairs within MOST_BITS bits connect."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = fps.select("fp").repartition(parts, "fp")  # else few fingerprints would be keyed by one task
    keys = spread.mapInArrow(_emit, "key long, fp long")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MOST_BITS
    shared = cut(keys.groupBy("key").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1"))
    size = shared.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    # most keys are those of one fingerprint and leave here
    held = keys.join(if_small(shared, size["keys"]), "key") if size["keys"] <= BROADCAST_ROWS else join_hot(keys, shared, "key", size["rows"], F.col("fp")).filter("hub is not null")
    bucket = cut(held.select("key", "fp", "hub"))
    star = cut(bucket.filter((F.col("fp") != F.col("hub")) & near("fp", "hub")).select(F.col("hub").alias("u"), F.col("fp").alias("v")).distinct())
    roots = components(star)
    known = bucket.join(roots.withColumnRenamed("node", "_node"), F.col("fp") == F.col("_node"), "left").select("key", "fp", F.coalesce("root", "fp").alias("part"))
    mixed = known.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("key")
    left = cut(known.join(mixed, "key"))
    a, b = left.select("key", F.col("fp").alias("u"), F.col("part").alias("pu")), left.select("key", F.col("fp").alias("v"), F.col("part").alias("pv"))
    rest = a.join(b, "key").filter((F.col("pu") < F.col("pv")) & near("u", "v"))
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(cut(rest.select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct()))


def _rooted(fps: DataFrame) -> DataFrame:
    """``fps`` (fp and more, no repeated fp) with root, the least fingerprint of the component."""
    roots = components(links(fps)).withColumnRenamed("node", "_node")
    return fps.join(roots, F.col("fp") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("_node")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (least doc_id reachable by links) of every document."""
    rows = cut(fingerprints(docs))
    total = rows.count()
    member = cut(_rooted(cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("rows")))))
    least = member.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("n"))
    named = join_hot(member, least, "root", total, F.col("fp")).select("fp", "component_id", F.col("rows").alias("n"))
    return join_hot(rows, named, "fp", total, F.col("doc_id")).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_least(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One document of each component, with all columns: the one of least doc_id (nulls last), then of least text hash.

    ``rows`` has doc_id, content (``xxhash64`` of the text) and root (any name of the component) of every row. Rows of other
    texts stay apart though they share a doc_id or have none. Helper columns have names that ``docs`` lacks.
    """
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")
    least = rows.groupBy("root").agg(F.min(own).alias("least"))
    key = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("\u0000null"))
    id_, content = fresh_names(docs, "id", "content")
    kept = least.select(key("least.doc_id").alias(id_), F.col("least.content").alias(content)).distinct()
    keyed = docs.withColumns({id_: key("doc_id"), content: F.xxhash64(text_of())})
    return keyed.join(kept, [id_, content], "left_semi").dropDuplicates([id_, content]).select(*docs.columns)


def keep_one(docs: DataFrame) -> DataFrame:
    """The document of least (doc_id, text hash) of each component, with all columns."""
    rows = cut(docs.select("doc_id", F.xxhash64(text_of()).alias("content"), F.pandas_udf(_simhash_column, "long")("text").alias("fp")))
    named = _rooted(cut(rows.groupBy("fp").agg(F.count("*").alias("n"))))
    return keep_least(docs, join_hot(rows, named, "fp", rows.count(), F.col("content")).select("doc_id", "content", "root"))
