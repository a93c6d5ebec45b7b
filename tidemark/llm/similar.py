"""Near copies by SimHash and Golay keys, verified: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates come from op5's keys (``simhash.shared_keys``) of PRINTS fingerprints of 64 bits of each set. No limit of bits follows: all texts that share a key
are candidates, which reaches further than the 4 bits of each fingerprint that the keys guarantee. A key's texts are first compared with its hub; the verified links give components,
and then those of a key that lie in different components are compared. Links are pairs verified on whole sets, never fingerprints alone.

An exact check follows, as texts of a similarity near 0.8 differ by some 10 of 64 bits and may share no key: texts in different components are also compared by their
rarest shingles. In any one order of all shingles, two sets of similarity ``t`` share a shingle among the first
``n - ceil(t n) + 1`` of each (prefix filter), so no similar pair is left out. The order puts shingles that
many texts hold last; it rests on counts in a table of fixed size, which only affect the cost.

Large groups: each pair of a key or shingle is either compared or linked already, so a group of g near copies makes at most one pair for each key of a member, not g x g; later
steps get its component as g - 1 edges. A group whose
members are mostly just under the similarity is not held together by links; its pairs are told apart where they are joined, by sketches: a set's sketch is a bitmap of the
parities of its hashes' cells, and two sketches differ in at most as many bits as their sets in shingles, so no similar pair is lost and few others leave the join.

Scale: texts with equal sets are merged first. Shingles travel as 64-bit hashes; a text sends about a fifth of its own, and 96 keys for each fingerprint. Sets are
built again from the texts for the texts of candidate pairs only.

Defined results: null and blank texts have the empty set and are linked with each other only; a text under five words is one shingle; rows
that share a doc_id or have none are told apart by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, if_small, text_of
from tidemark.llm.graph import components
from tidemark.llm.simhash import set_prints, shared_keys

SHINGLE, SIMILARITY = 5, 0.8
#: Cells of the table of counts that orders the shingles; a bound for what the driver holds.
CELLS = 1 << 18
#: Cells of the bitmap of texts whose sets are wanted; it only spares the others the way through a shuffle.
WANTED = 1 << 22
#: SimHash fingerprints of 64 bits of each set.
PRINTS = 3
#: Bits of a sketch, as longs; texts of up to some 2,000 words are told apart by it, longer ones by whole sets alone.
SKETCH = 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles: ASCII letters lower-cased, words between ASCII white space."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in ws], dtype=np.uint64)
    width = min(n, len(ws))
    out = np.full(len(ws) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mixed(out * _STEP + h[i : i + len(out)])
    return np.unique(out)


def prefix_length(n: int, similarity: float) -> int:
    """Shingles of a set of n of which a set of that similarity holds at least one."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity of a set's hashes in each of 64 * SKETCH cells, as longs."""
    # the low bits order and partition elsewhere; the high ones are as good
    cells = np.bincount((s >> np.uint64(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH)
    return np.packbits(cells & 1, bitorder="little").view("<i8")


def _count(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts += 0 if (s := shingles(text.as_py(), n)).size == 0 else np.bincount((s % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["cell", "n"])

    return run


def _nodes(n: int):
    """doc_id, content (hash of the text), node (hash of the shingle set), size, sketch and fingerprints of the set of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            node, size, bits, prints = np.empty(rows, np.uint64), np.empty(rows, np.int32), np.empty((rows, SKETCH), np.int64), np.empty((rows, PRINTS), np.int64)
            for i, t in enumerate(batch.column(2)):
                s = shingles(t.as_py(), n)
                node[i], size[i], bits[i], prints[i] = xxhash.xxh64_intdigest(s.tobytes()), len(s), sketch(s), set_prints(s, PRINTS)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (bits, prints)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node.view(np.int64)), pa.array(size), *lists], ["doc_id", "content", "node", "size", "sketch", "prints"])

    return run


def _prefixes(n: int, similarity: float, order: np.ndarray):
    """token, node, size and place of each shingle in the prefix of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # copies in one task send their rows once
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                tokens, sizes, places, nodes = [], [], [], []
                for text in batch.column(0)[at : at + 500]:
                    s = shingles(text.as_py(), n)
                    k = prefix_length(len(s), similarity)
                    node = xxhash.xxh64_intdigest(s.tobytes())
                    if k and node not in seen:
                        seen.add(node)
                        first = s[np.argsort(order[(s % np.uint64(CELLS)).astype(np.int64)], kind="stable")][:k]
                        tokens.append(first.view(np.int64))
                        sizes.append(np.full(k, len(s), np.int32))
                        places.append(np.arange(k, dtype=np.int32))
                        nodes.append(np.full(k, node, np.uint64).view(np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, nodes, sizes, places)], ["token", "node", "size", "place"])

    return run


def _sets(n: int, wanted: bytes):
    """content and hashes (the set) of texts whose cell is among the wanted; a task gives each text once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bits = set(), np.frombuffer(wanted, np.uint8)
        for batch in batches:
            content = batch.column(0).to_numpy(zero_copy_only=False)
            cell = content % WANTED
            at = [i for i in np.flatnonzero(bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).tolist() if not (content[i] in seen or seen.add(content[i]))]
            for k in range(0, len(at), 500):
                few = at[k : k + 500]
                yield pa.RecordBatch.from_arrays([pa.array(content[few]), pa.array([shingles(batch.column(1)[i].as_py(), n).tobytes() for i in few], pa.binary())], ["content", "hashes"])

    return run


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    return run


def _possible(similarity: float):
    """Whether sizes, and what may follow the shared shingle, still allow the similarity; true for a similar pair's first shared shingle."""
    small, large = F.least("size_u", "size_v"), F.greatest("size_u", "size_v")
    rest = F.least(F.col("size_u") - F.col("place_u"), F.col("size_v") - F.col("place_v"))
    total = F.col("size_u") + F.col("size_v")
    return (small >= similarity * large - 1e-6) & (rest >= similarity / (1 + similarity) * total - 1e-6)


def _may_differ_by(similarity: float):
    """Whether the sketches, which differ in no more bits than the sets do in shingles, still allow the similarity."""
    apart = sum((F.bit_count(F.col("sketch_u")[i].bitwiseXOR(F.col("sketch_v")[i])) for i in range(1, SKETCH)), F.bit_count(F.col("sketch_u")[0].bitwiseXOR(F.col("sketch_v")[0])))
    return apart <= (1 - similarity) / (1 + similarity) * (F.col("size_u") + F.col("size_v")) + 1e-6


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, n: int, similarity: float) -> DataFrame:
    """Those of the pairs u, v of nodes whose sets have the similarity."""
    pairs = cut(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    own = cut(reps.select("node", "content").join(wanted, "node"))
    bits = np.zeros(WANTED // 8, np.uint8)
    cells = own.select(F.pmod("content", F.lit(WANTED)).cast("int").alias("cell")).distinct().toPandas()["cell"].to_numpy()
    np.bitwise_or.at(bits, cells >> 3, (1 << (cells & 7)).astype(np.uint8))
    texts = docs.select(F.xxhash64(text_of()).alias("content"), F.coalesce("text", F.lit("")).alias("text"))
    # sets are dealt by node once, for both joins
    sets = texts.mapInArrow(_sets(n, bits.tobytes()), "content long, hashes binary").join(if_small(own, own.count()), "content").dropDuplicates(["node"]).select("node", "hashes")
    a, b = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    return cut(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(_similar(similarity), "u long, v long"))


def _linked(bucket: DataFrame, roots: DataFrame) -> DataFrame:
    """``bucket`` with the component of each node."""
    return bucket.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").withColumn("part", F.coalesce("root", "node")).drop("_node", "root")


def _grown(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more links u, v: a component comes as one edge for each node, whatever number of links made it."""
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links))


def _across(bucket: DataFrame, roots: DataFrame, docs: DataFrame, reps: DataFrame, n: int, similarity: float) -> DataFrame:
    """Verified pairs of nodes that share a token of ``bucket`` (token, node, size, place) and lie in different components, of which ``roots`` gives the roots."""
    known = _linked(bucket, roots)
    mixed = known.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("token")
    left = cut(known.join(mixed, "token").join(reps.select("node", "sketch"), "node"))
    side = lambda s: left.select("token", F.col("part").alias(f"part_{s}"), F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("size", "place", "sketch")])
    rest = side("u").join(side("v"), "token").filter((F.col("part_u") < F.col("part_v")) & _possible(similarity) & _may_differ_by(similarity)).select("u", "v")
    return _verified(rest, docs, reps, n, similarity)


def _by_keys(docs: DataFrame, reps: DataFrame, n: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified pairs of nodes and hubs, the roots of their components, and the verified pairs across these."""
    bucket = shared_keys(reps)
    ends = bucket.filter("node <> hub").select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
    for s in "uv":
        ends = ends.join(reps.select(F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.lit(0).alias(f"place_{s}"), F.col("sketch").alias(f"sketch_{s}")), s)
    found = _verified(ends.filter(_possible(similarity) & _may_differ_by(similarity)), docs, reps, n, similarity)
    sized = bucket.select("token", "node").join(reps.select("node", "size", F.lit(0).alias("place")), "node")
    roots = components(found)
    return found, roots, _across(sized, roots, docs, reps, n, similarity)


def key_links(docs: DataFrame, reps: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Verified pairs u, v of nodes that connect all similar nodes of ``reps`` (node, size, sketch, prints, content) that share a Golay key."""
    found, _, more = _by_keys(docs, reps, n, similarity)
    return found.unionByName(more)


def all_roots(docs: DataFrame, rows: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """node, root of the components of all similar nodes, roots left out: by verified pairs of the keys, then by those that the exact check adds."""
    reps = cut(rows.groupBy("node").agg(F.min("content").alias("content"), *[F.first(c).alias(c) for c in ("size", "sketch", "prints")]))
    _, roots, more = _by_keys(docs, reps, n, similarity)
    roots = _grown(roots, more)
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = text.mapInArrow(_count(n), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    order = np.zeros(CELLS, np.int64)
    order[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = text.mapInArrow(_prefixes(n, similarity, order), "token long, node long, size int, place int").repartition(parts, "token")
    own = own.groupBy("token", "node").agg(F.first("size").alias("size"), F.first("place").alias("place"))
    bucket = cut(own.withColumn("_n", F.count("*").over(Window.partitionBy("token"))).filter("_n > 1").drop("_n"))
    return _grown(roots, _across(bucket, roots, docs, reps, n, similarity))


def classes(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, content and root (a node of the component) of every row."""
    rows = cut(docs.select("doc_id", F.xxhash64(text_of()).alias("content"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_nodes(n), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, content long, node long, size int, sketch array<long>, prints array<long>"))
    return _linked(rows, all_roots(docs, rows, n, similarity)).select("doc_id", "content", F.col("part").alias("root"))
