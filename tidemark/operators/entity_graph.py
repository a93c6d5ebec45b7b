"""Entity graph: one latest edge per unordered pair of nodes, neighbourhoods, exposure and contagion.

Edges: a, b (a < b), src, dst, edge_type, detail. Nodes: node_id, node_type; a node without a row has no type and is no company.
Every operator answers for all nodes at once with equi-joins on node ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.store import cut

#: Companies from which on a node is a hub: its companies are one class, listed once.
HUB = 256
#: Companies of an executive that one task pairs with the others.
BUSY = 256
#: Sources of a block, which the companies of a neighbour are sent to together.
BLOCK = 512
#: How many times a hub's companies a giant has: lists of companies do not pass through it.
GIANT = 16


def latest_edges(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """The last written edge of each unordered pair."""
    rows = events.filter("src <> dst").withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    last = F.max_by(F.struct("src", "dst", "edge_type", "detail"), F.struct(*order, "edge_type", "detail"))
    return rows.groupBy("a", "b").agg(last.alias("e")).select("a", "b", "e.*")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "edge_type", "detail").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "edge_type", "detail"))


def connected_companies(nodes: DataFrame, edges: DataFrame, sources: DataFrame, depth: int = 2) -> DataFrame:
    """company, other, hops for the companies within ``depth`` hops of each company of ``sources`` (column company)."""
    steps = both_ways(edges).select(F.col("node").alias("_at"), F.col("other").alias("_to"))
    seen = sources.select("company", F.col("company").alias("other"), F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.join(steps, F.col("other") == F.col("_at")).select("company", F.col("_to").alias("other")).distinct()
        frontier = reached.join(seen.select("company", "other"), ["company", "other"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(frontier)
    companies = nodes.filter("node_type = 'company'").select(F.col("node_id").alias("other"))
    return seen.filter("hops > 0").join(companies, "other", "left_semi")


def near_companies(nodes: DataFrame, edges: DataFrame, sources: DataFrame, hub: int = HUB) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The companies within two hops of each company of ``sources``, without a pair for each two companies of a hub.

    Three tables: pairs (company, other, hops), all but those that only a hub gives; holds (company, hub) of sources and their hubs; members (hub, member).
    A source is within two hops of all members of its hubs. A node is a hub with ``hub`` or more companies as neighbours.

    Pairs are made behind the last exchange: sources lie in blocks by name, and the list of a neighbour's companies goes once to each block, whichever of its sources it is near.
    Only sources with ``GIANT`` times ``hub`` neighbours or more, whose pairs one task may not hold, are paired by a join.
    """
    companies = nodes.filter("node_type = 'company'").select("node_id")
    steps = both_ways(edges).select("node", "other")
    to_company = steps.join(companies, F.col("other") == F.col("node_id"), "left_semi")
    hubs = cut(to_company.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") >= hub).select(F.col("node").alias("hub")))
    named = cut(sources.select("company").orderBy("company")).withColumn("_block", F.floor(F.monotonically_increasing_id() / BLOCK))
    first = steps.join(named, F.col("node") == F.col("company")).select("company", F.col("other").alias("mid"), "_block")
    holds = first.join(hubs, F.col("mid") == F.col("hub")).select("company", "hub")
    members = to_company.join(hubs, F.col("node") == F.col("hub")).select("hub", F.col("other").alias("member"))
    lists = to_company.join(hubs, F.col("node") == F.col("hub"), "left_anti").groupBy(F.col("node").alias("mid")).agg(F.array_sort(F.collect_list("other")).alias("two"))
    wide = cut(first.groupBy("company").agg(F.count("*").alias("n")).filter(F.col("n") >= hub * GIANT).select("company"))
    every = first.join(hubs, F.col("mid") == F.col("hub"), "left_anti")
    beside = first.join(companies, F.col("mid") == F.col("node_id"), "left_semi")
    far = every.join(wide, "company", "left_semi").join(lists, "mid").select("company", F.explode("two").alias("other"), F.lit(2).alias("hops"))
    far = far.unionByName(beside.join(wide, "company", "left_semi").select("company", F.col("mid").alias("other"), F.lit(1).alias("hops")))
    far = far.filter("company <> other").groupBy("company", "other").agg(F.min("hops").alias("hops"))
    none = F.array().cast("array<string>")
    small = every.join(wide, "company", "left_anti").groupBy("_block", "mid").agg(F.collect_list("company").alias("companies"))
    two = small.join(lists, "mid").select("_block", "companies", none.alias("one"), "two")
    one = beside.join(wide, "company", "left_anti").select("_block", F.array("company").alias("companies"), F.array("mid").alias("one"), none.alias("two"))
    rows = two.unionByName(one).repartition("_block").select("_block", F.explode("companies").alias("company"), "one", "two")
    # grouped where they lie: the block is one of the keys
    by = rows.groupBy("_block", "company").agg(F.array_distinct(F.flatten(F.collect_list("one"))).alias("one"), F.flatten(F.collect_list("two")).alias("two"))
    beyond = F.array_except("two", F.concat("one", F.array("company")))
    at = F.concat(F.transform(F.array_except("one", F.array("company")), lambda o: F.struct(o.alias("other"), F.lit(1).alias("hops"))), F.transform(beyond, lambda o: F.struct(o.alias("other"), F.lit(2).alias("hops"))))
    return by.select("company", F.inline(at)).unionByName(far), holds, members


#: Bits of one bitmap: company numbers fall into buckets of so many.
_BITS = 32_768
#: Company numbers that a union holds before it drops repeats.
_HELD = 1 << 20
#: Sources of a class that are counted against one copy of its bitmaps.
_SALT = 1_024


def _numbered(nodes: DataFrame) -> DataFrame:
    """node_id and number of each company, in order of the names: the first of some names are those of the least numbers."""
    companies = cut(nodes.filter("node_type = 'company'").select("node_id").distinct().orderBy("node_id"))
    return companies.withColumn("number", F.monotonically_increasing_id())


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, members (sorted, each once) of rows (node, members) sorted by node."""
    node, held, size, done = None, [], 0, []
    for batch in batches:
        for key, members in zip(batch.column("node").to_pylist(), _lists(batch, "members"), strict=True):
            if key != node:
                if node is not None:
                    done.append((node, np.unique(np.concatenate(held))))
                node, held, size = key, [], 0
            held.append(members)
            size += len(members)
            if size > _HELD:
                held = [np.unique(np.concatenate(held))]
                size = len(held[0]) // 2
        yield _rows_of(done)
        done = []
    if node is not None:
        yield _rows_of([(node, np.unique(np.concatenate(held)))])


def _rows_of(done: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(m) for _, m in done])]).astype(np.int32)
    values = np.concatenate([m for _, m in done]) if done else np.zeros(0, np.int64)
    return pa.record_batch([pa.array([n for n, _ in done], pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))], names=["node", "members"])


def _unions(rows: DataFrame) -> DataFrame:
    """node and the union of its members; the lists of a node pass one task in a stream, of which only the union is held."""
    return rows.select("node", "members").repartition("node").sortWithinPartitions("node").mapInArrow(_united, "node string, members array<bigint>")


def _ored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, bucket, bits of rows (key, members in order of their buckets, bucket, bits) sorted by key; a row has members or a bitmap."""
    key, found = None, {}

    def told() -> pa.RecordBatch:
        names = sorted(found)
        packed = [np.packbits(found[n], bitorder="little").tobytes() for n in names]
        return pa.record_batch([pa.array([key] * len(names), pa.string()), pa.array(names, pa.int64()), pa.array(packed, pa.binary())], names=["key", "bucket", "bits"])

    def flags(bucket: int) -> np.ndarray:
        if bucket not in found:
            found[bucket] = np.zeros(_BITS, bool)
        return found[bucket]

    for batch in batches:
        rows = zip(batch.column("key").to_pylist(), _lists(batch, "members"), batch.column("bucket").to_pylist(), batch.column("bits").to_pylist(), strict=True)
        for name, members, bucket, bits in rows:
            if name != key:
                if found:
                    yield told()
                key, found = name, {}
            if bucket is not None:
                flags(bucket)[:] |= np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").view(bool)
            if len(members):
                at = members // _BITS
                for part in np.split(members, np.flatnonzero(np.diff(at)) + 1):
                    flags(int(part[0]) // _BITS)[part % _BITS] = True
    if found:
        yield told()


def _bitmaps(rows: DataFrame) -> DataFrame:
    """key, bucket and the bitmap of what the rows of a key (members, or bucket and bits) hold; only the bitmaps of one key are in memory."""
    return rows.select("key", F.coalesce("members", F.array().cast("array<bigint>")).alias("members"), "bucket", "bits").repartition("key").sortWithinPartitions("key").mapInArrow(_ored, "key string, bucket bigint, bits binary")


def _explore(steps: DataFrame, starts: DataFrame, hubs: DataFrame, depth: int) -> DataFrame:
    """start, node, hops for the nodes within ``depth`` hops of each start that paths reach without passing through a hub other than the start; hubs are reached, not passed.

    Each level is cut by a reliable checkpoint.
    """
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, depth + 1):
        go = frontier if hop == 1 else frontier.join(hubs, F.col("node") == F.col("hub"), "left_anti")
        reached = go.join(steps, F.col("node") == F.col("_at")).select("start", F.col("_to").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def _balls(steps: DataFrame, companies: DataFrame, hubs: DataFrame, lists: DataFrame, depth: int) -> DataFrame:
    """hub, radius, bucket, bits of the companies within each radius up to ``depth`` of each hub.

    What paths reach from the hub without passing another one is listed once, but for the last hop, which takes the lists of the nodes before it; beyond another hub lies that
    hub's own ball of what is left of the radius.
    """
    found = _explore(steps, hubs.select(F.col("hub").alias("start")), hubs, max(depth - 1, 1))
    own = found.join(companies, F.col("node") == F.col("node_id")).select(F.col("start").alias("hub"), "number", "hops")
    others = found.filter("hops > 0").join(hubs.select(F.col("hub").alias("_hub")), F.col("node") == F.col("_hub")).select(F.col("start").alias("hub"), F.col("node").alias("via"), "hops")
    none = {"bucket": F.lit(None).cast("bigint"), "bits": F.lit(None).cast("binary")}
    balls = None
    for radius in range(1, depth + 1):
        within = own.filter(F.col("hops") <= radius).groupBy(F.col("hub").alias("key"), F.floor(F.col("number") / _BITS).alias("_b"))
        rows = within.agg(F.collect_list("number").alias("members")).select("key", "members").withColumns(none)
        if radius == depth > 1:
            ends = found.filter(F.col("hops") == depth - 1).join(hubs, F.col("node") == F.col("hub"), "left_anti")
            rows = rows.unionByName(ends.join(lists.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).select(F.col("start").alias("key"), "members").withColumns(none))
        if radius > 1:
            left = others.withColumn("_left", radius - F.col("hops")).filter("_left > 0")
            beyond = left.join(balls.withColumnRenamed("hub", "via").withColumnRenamed("radius", "_left"), ["via", "_left"])
            rows = rows.unionByName(beyond.select(F.col("hub").alias("key"), F.lit(None).cast("array<bigint>").alias("members"), "bucket", "bits"))
        now = cut(_bitmaps(rows).select(F.col("key").alias("hub"), F.lit(radius).alias("radius"), "bucket", "bits"))
        balls = now if balls is None else balls.unionByName(now)
    return balls


def _counter(names: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """company, connected and the least ``names`` numbers of rows sorted by class and salt; first a class's bitmaps (kind 0, by bucket), then the lists of its sources (kind 1, by company)."""

    def first(bits: list[np.ndarray], buckets: list[int]) -> np.ndarray:
        out: list[int] = []
        for bucket, row in zip(buckets, bits, strict=True):
            out += (np.flatnonzero(np.unpackbits(row, bitorder="little"))[: names + 1] + bucket * _BITS).tolist()
            if len(out) > names:
                break
        return np.array(out[: names + 1], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, buckets, bits, table, total, least = None, [], [], None, 0, None
        company, number, held, size = None, None, [], 0
        done: list[tuple[str, int, list[int]]] = []

        def finish() -> None:
            if company is None:
                return
            members = np.unique(np.concatenate(held))
            me = np.array([] if number is None else [number], np.int64)
            outside = np.setdiff1d(members[~_has(table, members)], me, assume_unique=True)
            n = total - int(_has(table, me).sum()) + len(outside)
            if n:
                done.append((company, n, np.union1d(np.setdiff1d(least, me), outside[:names])[:names].tolist()))

        for batch in batches:
            keys = zip(batch.column("cls").to_pylist(), batch.column("salt").to_pylist(), strict=True)
            rows = zip(keys, batch.column("bucket").to_pylist(), batch.column("bits").to_pylist(), batch.column("company").to_pylist(), batch.column("number").to_pylist(), _lists(batch, "members"), strict=True)
            for at, bucket, row, name, its, members in rows:
                if at != key or name != company:
                    finish()
                    company, number, held, size = name, its, [], 0
                if at != key:
                    key, buckets, bits, table = at, [], [], None
                if bucket is not None:
                    buckets.append(bucket)
                    bits.append(np.frombuffer(row, np.uint8))
                    continue
                if table is None:
                    table = np.array(buckets, np.int64), np.stack(bits) if bits else None
                    least, total = first(bits, buckets), sum(int(np.bitwise_count(b).sum()) for b in bits)
                held.append(members)
                size += len(members)
                if size > _HELD:
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0]) // 2
            yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.list_(pa.int64()))], names=["company", "connected", "numbers"])
            done = []
        finish()
        yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.list_(pa.int64()))], names=["company", "connected", "numbers"])

    return count


def _has(table: tuple[np.ndarray, np.ndarray], numbers: np.ndarray) -> np.ndarray:
    """Whether the bitmaps (buckets in order, bits) hold each number."""
    buckets, bits = table
    if not len(buckets):
        return np.zeros(len(numbers), bool)
    bucket, place = numbers // _BITS, numbers % _BITS
    row = np.minimum(np.searchsorted(buckets, bucket), len(buckets) - 1)
    return (buckets[row] == bucket) & ((bits[row, place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1)


def reach(nodes: DataFrame, edges: DataFrame, sources: DataFrame, hub: int = HUB, names: int = 10, depth: int = 2) -> DataFrame:
    """company, connected (how many companies are within ``depth`` hops) and second_order (the first of their names).

    No pair of a source and a company is ever a row. What lies behind a neighbour that is no hub is a list of company numbers, made hop by hop and united for each source in a stream.
    The companies near a hub are bitmaps for each radius; sources with the same hubs at the same distances share a class, whose bitmaps are joined by OR and counted once. Lists
    pass through a hub behind the first hop unless it has ``GIANT`` times ``hub`` companies; such hubs count for the class at any distance. A source's list is counted against its class's bitmaps.
    """
    steps = cut(both_ways(edges).select(F.col("node").alias("_at"), F.col("other").alias("_to")))
    companies = _numbered(nodes)
    degree = steps.join(companies.select("node_id"), F.col("_to") == F.col("node_id"), "left_semi").groupBy("_at").agg(F.count("*").alias("n"))
    hubs_of = cut(degree.filter(F.col("n") >= hub).select(F.col("_at").alias("hub"), (F.col("n") >= hub * GIANT).alias("giant")))
    hubs, giants = hubs_of.select("hub"), hubs_of.filter("giant").select("hub")
    sources = sources.select("company").distinct()
    without = lambda rows, some, column="via": rows.join(some, F.col(column) == F.col("hub"), "left_anti")
    through = lambda rows, sets: rows.join(sets.withColumnRenamed("node", "via"), "via")
    first = cut(without(sources, hubs, "company").join(steps, F.col("company") == F.col("_at")).select("company", F.col("_to").alias("via")))
    onward = without(first, hubs)
    # the companies within one hop of the nodes that are no giants, within two and so on; of more than one hop, of those that are asked for
    near = without(steps, giants, "_at").join(companies, F.col("_to") == F.col("node_id")).groupBy(F.col("_at").alias("node")).agg(F.array_sort(F.collect_list("number")).alias("members"))
    near = cut(near)
    ways = without(without(steps.select(F.col("_at").alias("node"), F.col("_to").alias("via")), giants), giants, "node")
    asked, wanted = onward.select(F.col("via").alias("node")).distinct(), []
    for _ in range(2, depth):
        wanted.append(cut(ways.join(asked, "node", "left_semi")))
        asked = wanted[-1].select(F.col("via").alias("node")).distinct()
    lists = near
    for some in reversed(wanted):
        of = near.join(some.select("node").distinct(), "node", "left_semi")
        lists = cut(_unions(of.unionByName(through(some, lists).select("node", "members"))))
    # giants that lie behind other nodes, with their hops
    beside = cut(steps.join(giants, F.col("_to") == F.col("hub")).select(F.col("_at").alias("node"), "hub", F.lit(1).alias("hops")))
    gates = beside
    for _ in range(3, depth):
        more = through(ways, gates).select("node", "hub", (F.col("hops") + 1).alias("hops"))
        gates = cut(beside.unionByName(more).groupBy("node", "hub").agg(F.min("hops").alias("hops")))
    # the hubs of a source make its class
    left = sources.join(hubs, F.col("company") == F.col("hub")).select("company", "hub", F.lit(depth).alias("radius"))
    left = left.unionByName(first.join(hubs, F.col("via") == F.col("hub")).select("company", "hub", F.lit(depth - 1).alias("radius")))
    left = left.unionByName(through(onward, gates).select("company", "hub", (depth - 1 - F.col("hops")).alias("radius"))).filter("radius > 0")
    held = left.groupBy("company", "hub").agg(F.max("radius").alias("radius")).groupBy("company").agg(F.array_sort(F.collect_list(F.struct("hub", "radius"))).alias("hubs"))
    held = cut(held.withColumn("cls", F.sha2(F.to_json("hubs"), 256)))
    kinds = held.groupBy("cls").agg(F.first("hubs").alias("hubs"), F.ceil(F.count("*") / _SALT).cast("int").alias("salts"))
    balls = _balls(steps, companies, hubs, near, depth)
    union = _bitmaps(kinds.select("cls", F.inline("hubs")).join(balls, ["hub", "radius"]).select(F.col("cls").alias("key"), F.lit(None).cast("array<bigint>").alias("members"), "bucket", "bits"))
    # each list goes once to where its source is counted against the class's bitmaps
    null, no_list = (lambda t: F.lit(None).cast(t)), F.array().cast("array<bigint>")
    salts = kinds.select("cls", "salts")
    maps = union.withColumnRenamed("key", "cls").join(salts, "cls").select(
        "cls", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "bucket", "bits", null("string").alias("company"), null("bigint").alias("number"), no_list.alias("members"))
    who = sources.join(held.select("company", "cls"), "company", "left").join(salts, "cls", "left").join(companies, F.col("company") == F.col("node_id"), "left")
    who = cut(who.select("company", F.coalesce("cls", F.lit("")).alias("cls"), F.pmod(F.xxhash64("company"), F.coalesce("salts", F.lit(1_024))).cast("int").alias("salt"), "number"))
    direct = first.join(companies.select("node_id", F.col("number").alias("_n")), F.col("via") == F.col("node_id")).select("company", F.array("_n").alias("members"))
    own = direct if depth == 1 else direct.unionByName(through(onward, lists).select("company", "members"))
    rows = who.withColumn("members", no_list).unionByName(who.join(own, "company")).withColumns({"bucket": null("bigint"), "bits": null("binary")})
    every = maps.unionByName(rows).repartition("cls", "salt").sortWithinPartitions("cls", "salt", F.col("company").asc_nulls_first(), "bucket")
    counted = cut(every.mapInArrow(_counter(names), "company string, connected bigint, numbers array<bigint>"))
    shown = counted.select("company", F.explode("numbers").alias("number")).join(companies, "number").groupBy("company").agg(F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("second_order"))
    return counted.join(shown, "company").select("company", "connected", "second_order")


def nodes_from_briefs(nodes: DataFrame, briefs: DataFrame, prefix: str = "c") -> DataFrame:
    """The nodes with those of the briefs' companies added or refreshed: node_id, node_type, last_severity, last_alpha."""
    seen = briefs.select(F.concat(F.lit(prefix), F.col("company_id").cast("string")).alias("node_id"), F.lit("company").alias("_type"), F.col("overall_severity").alias("last_severity"), F.coalesce("top_alpha", F.lit(0.0)).alias("last_alpha"))
    return nodes.join(seen, "node_id", "full_outer").select("node_id", F.coalesce("_type", "node_type").alias("node_type"), "last_severity", "last_alpha")


def shared_executives(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of companies (company_a < company_b) with the number and names of the executives they share."""
    return _sharing(_held(nodes, edges))


def shared_executive_classes(nodes: DataFrame, edges: DataFrame, busy: int = BUSY) -> tuple[DataFrame, DataFrame]:
    """``shared_executives`` without a row for each two companies of an executive of many: the pairs that executives of under ``busy`` companies give, and the members
    (executive, company) of the others. Two companies share what their pair says and every executive that both are members of; rows grow with the edges."""
    held = cut(_held(nodes, edges))
    many = held.groupBy("executive").agg(F.count("*").alias("n")).filter(F.col("n") >= busy).select("executive")
    return _sharing(held.join(many, "executive", "left_anti")), held.join(many, "executive", "left_semi")


def _held(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    executives = nodes.filter("node_type = 'executive'").select("node_id")
    return both_ways(edges).join(executives, F.col("node") == F.col("node_id"), "left_semi").select(F.col("node").alias("executive"), F.col("other").alias("company"))


def _sharing(held: DataFrame) -> DataFrame:
    # an executive of one company shares it with none; the others meet by degree, so that no task holds all pairs of a busy one
    busy = held.groupBy("executive").agg(F.count("*").alias("n")).filter("n > 1")
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / BUSY)).cast("int")
    held = held.join(busy.select("executive", salts.alias("salts")), "executive")
    left = held.withColumn("salt", F.pmod(F.xxhash64("company"), F.col("salts")).cast("int")).withColumnRenamed("company", "company_a").drop("salts")
    right = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumnRenamed("company", "company_b").drop("salts")
    pairs = left.join(right, ["executive", "salt"]).filter("company_a < company_b")
    return pairs.groupBy("company_a", "company_b").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("executive")), ",").alias("executives"))


def lender_exposure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    lenders = nodes.filter("node_type = 'lender'").select("node_id")
    loans = both_ways(edges).filter("edge_type = 'lends_to'").join(lenders, F.col("node") == F.col("node_id"), "left_semi")
    return loans.select(F.col("node").alias("lender"), F.col("other").alias("company"), F.coalesce("detail", F.lit("unknown")).alias("facility"))


def acquisitions(edges: DataFrame) -> DataFrame:
    return both_ways(edges).filter("edge_type = 'acquired'").select(F.col("node").alias("company"), "other", F.col("detail").alias("status"))


def acquisition_chains(edges: DataFrame) -> DataFrame:
    """company, other, hops for all companies that a company acquired, or that these acquired, and so on; a cycle leads back to none but the others in it.

    Paths double in length each round - what is known to lie within n hops, joined to itself, gives all within 2n - so the rounds grow with the logarithm of
    the longest chain; each is cut by a reliable checkpoint and the loop ends when nothing is added or gets nearer.
    """
    known = cut(edges.filter("edge_type = 'acquired'").select(F.col("src").alias("company"), F.col("dst").alias("other"), F.lit(1).alias("hops")).distinct())
    while True:
        on = known.select(F.col("company").alias("_via"), F.col("other").alias("_to"), F.col("hops").alias("_more"))
        longer = known.join(on, F.col("other") == F.col("_via")).filter(F.col("company") != F.col("_to")).select("company", F.col("_to").alias("other"), (F.col("hops") + F.col("_more")).alias("hops"), F.lit(0).alias("_old"))
        both = known.select("company", "other", "hops", F.lit(1).alias("_old")).unionByName(longer)
        now = cut(both.groupBy("company", "other").agg(F.min("hops").alias("hops"), F.min(F.when(F.col("_old") == 1, F.col("hops"))).alias("_was")))
        done = now.filter("_was is null or hops < _was").isEmpty()
        known = now.drop("_was")
        if done:
            return known


def contagion(nodes: DataFrame, edges: DataFrame, distressed: DataFrame, depth: int = 2) -> DataFrame:
    """Lenders, board links, regulators and second-order companies of each distressed company, and the level of risk.

    Level: isolated; contained with a lender or a board link; systemic with more than 5 connected companies or 2 lenders; unknown outside the graph.
    """
    types = nodes.select(F.col("node_id").alias("other"), "node_type")
    near = both_ways(edges).join(distressed.select(F.col("company").alias("node")), "node").join(types, "other", "left")
    lender = (F.col("edge_type") == "lends_to") | (F.col("node_type") == "lender")
    by = near.groupBy(F.col("node").alias("company")).agg(
        F.count_if(F.coalesce(lender, F.lit(False))).alias("lenders"), F.count_if(F.col("edge_type") == "board_overlap").alias("board_links"), F.count_if(F.coalesce(F.col("node_type") == "regulator", F.lit(False))).alias("regulators"),
    )
    near_ones = reach(nodes, edges, distressed, depth=depth)
    out = distressed.join(by, "company", "left").join(near_ones, "company", "left").join(nodes.select(F.col("node_id").alias("company"), F.lit(True).alias("_in")), "company", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    level = F.when(F.col("_in").isNull() & F.col("lenders").isNull(), "unknown").when((zero("connected") > 5) | (zero("lenders") > 2), "systemic").when((zero("lenders") > 0) | (zero("board_links") > 0), "contained").otherwise("isolated")
    return out.select("company", level.alias("risk_level"), *[zero(c).alias(c) for c in ("lenders", "board_links", "regulators", "connected")], F.coalesce("second_order", F.lit("")).alias("second_order"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what ('node' or 'edge'), type and count; nodes only known from edges have the type ``unknown``."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node_id")).distinct()
    every = nodes.join(ends, "node_id", "full_outer").select(F.coalesce("node_type", F.lit("unknown")).alias("type"))
    by_node = every.groupBy("type").agg(F.count("*").alias("n")).withColumn("what", F.lit("node"))
    by_edge = edges.groupBy(F.col("edge_type").alias("type")).agg(F.count("*").alias("n")).withColumn("what", F.lit("edge"))
    return by_node.unionByName(by_edge).select("what", "type", "n")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, components and whether the graph is connected.

    Least labels spread over edges and then jump to their own label's label; each round is cut by a reliable checkpoint in the shared folder
    and the loop ends when no label changes.
    """
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    labels = cut(nodes.select(F.col("node_id").alias("node")).unionByName(ends).distinct().withColumn("label", F.col("node")))
    steps = cut(both_ways(edges).select("node", "other"))
    changed = True
    while changed:
        near = steps.join(labels.select(F.col("node").alias("other"), F.col("label").alias("_l")), "other").groupBy("node").agg(F.min("_l").alias("_l"))
        least = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("_l", "label")).alias("label"))
        jump = least.select(F.col("node").alias("_n"), F.col("label").alias("_j"))
        now = cut(least.join(jump, F.col("label") == F.col("_n"), "left").select("node", "old", F.least("label", F.coalesce("_j", "label")).alias("label")))
        changed = not now.filter("label <> old").isEmpty()
        labels = now.select("node", "label")
    return labels.groupBy().agg(F.count("*").alias("nodes"), F.count_distinct("label").alias("components")).withColumn("is_connected", F.col("components") == 1)
