"""Mixing sources to target weights with Pfair scheduling.

Each source's rows, in a hashed order, form blocks. With integer weights, unit ``tau`` of fluid time gives source s exactly
``weight[s]`` blocks until it runs out; ``slots(tau)`` is the number of blocks that all sources have been given by ``tau``.
Block k (from 0) of a source with weight w may run from slot ``floor(slots(k / w))`` (its release) and must have run by slot
``ceil(slots((k + 1) / w))`` (its deadline). Earliest deadline first over the released blocks meets all deadlines, as the fluid schedule
fits every window, so after any number of slots each source is within one block of its fluid share. When a source ends, the rest share
its slots by their weights; nothing is dropped or repeated.

At whole ``tau`` no block is under way, so each unit of tau is scheduled alone, and units in which no source ends have the same
schedule. At most 2 x sources + 1 different units exist; each is scheduled by one fold over its slots in Spark. A row finds its slot by its
block's unit and place in it. The schedule has at most (2 x sources + 1) x sum(weights) rows, whatever the data's size, so it is broadcast.

Rows of a source are numbered in hashed parts of doc_id and the columns carried, whose number grows with the rows; equal rows are counted first and
numbered as one run, so no key and no number of equal rows meets in one part.

Defined results: rows of sources without a weight (null too) form the source ``other``; repeated rows each get a position; an empty
table gives no rows; extra columns are left out but by ``placed`` and ``in_order``, which keep all, whatever their names (their types must be ones that rows can be grouped
by). The sum of the weights is at most MOST_SLOTS: weights are shares, to be scaled to integers of such a sum. Very long texts are only carried.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fresh_names, let

OTHER = "other"
BLOCK_ROWS = 16
#: Largest sum of the weights, and so the longest schedule of a unit.
MOST_SLOTS = 1024
#: Rows to a part that is numbered alone, and equal rows that one task writes out.
PART_ROWS, RUN_ROWS = 50_000, 4_096


def numbered(docs: DataFrame, weights: Mapping[str, int], carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, source, mix_source, n: place in the source from 0, copies: its equal rows, run: where its run of RUN_ROWS of them begins, and the columns to carry) and the row counts
    of the sources.

    The order in a source is that of a hash of doc_id, then of the row; parts are ranges of the hash, so they are numbered side by side and
    shifted by the counts of the parts before.
    """
    mix = F.when(F.col("source").isin(*weights), F.col("source")).otherwise(F.lit(OTHER))
    cols = ["doc_id", "source", *carry]
    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\u0000null")), F.lit("mix"), *carry)
    parts = max(1, docs.count() // PART_ROWS)
    part = F.floor(F.shiftrightunsigned(draw, 32) / F.lit((1 << 32) / parts)).cast("int")
    rows = docs.groupBy(*cols).agg(F.count("*").alias("_copies")).withColumns({"mix_source": mix, "_draw": draw, "_part": part})
    counts = rows.groupBy("mix_source", "_part").agg(F.sum("_copies").alias("_rows"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col("mix_source").alias("_mix"), F.col("_part").alias("_own"), F.coalesce(F.sum("_rows").over(before.partitionBy("mix_source").orderBy("_part")), F.lit(0)).alias("_before"))
    order = F.shiftrightunsigned("_draw", 1)
    place = F.coalesce(F.sum("_copies").over(before.partitionBy("mix_source", "_part").orderBy(order, "_draw", *cols)), F.lit(0))
    rows = rows.withColumn("_place", place).join(shifts, (F.col("mix_source") == F.col("_mix")) & (F.col("_part") == F.col("_own")))
    rows = rows.select(*cols, "mix_source", "_copies", (F.col("_before") + F.col("_place")).alias("n"))
    one = rows.filter("_copies = 1").select(*cols, "mix_source", "n", F.lit(0).cast("long").alias("run"), F.col("_copies").alias("copies"))
    runs = rows.filter("_copies > 1").withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(RUN_ROWS).cast("long")))).repartition("doc_id", "mix_source", "_run")
    last = F.least(F.col("_run") + RUN_ROWS, F.col("_copies")) - 1
    more = runs.withColumn("_i", F.explode(F.sequence("_run", last))).select(*cols, "mix_source", (F.col("n") + F.col("_i")).alias("n"), F.col("_run").alias("run"), F.col("_copies").alias("copies")).select(*one.columns)
    totals = counts.groupBy("mix_source").agg(F.sum("_rows").alias("rows"))
    return one.unionByName(more), totals


def _weights(weights: Mapping[str, int], other: int) -> dict[str, int]:
    full = dict(weights) | {OTHER: other}
    if min(full.values()) < 1 or sum(full.values()) > MOST_SLOTS:
        raise ValueError(f"weights must be positive integers of sum at most {MOST_SLOTS}")
    return full


def _slots_at(sources: Column, tau: Column) -> Column:
    """Blocks that all sources have been given by whole fluid time ``tau``."""
    return F.aggregate(sources, F.lit(0).cast("long"), lambda a, s: a + F.least(s["weight"] * tau, s["blocks"]))


def _slots_within(live: Column, x: Column) -> Column:
    """Blocks given in the first ``x`` (0 to 1) of a unit; small numbers, so exact enough at any place in the schedule."""
    return F.aggregate(live, F.lit(0.0), lambda a, s: a + F.least(s["weight"] * x, s["left"].cast("double")))


def _earliest_deadline_first(jobs: Column) -> Column:
    """Jobs (release, deadline, ord, source, j) in slot order 0, 1, ...: each slot takes the released job of least deadline."""
    def step(state: Column, t: Column) -> Column:
        ready = F.filter(state["left"], lambda x: x["release"] <= t)
        pick = F.array_min(F.transform(ready, lambda x: F.struct(x["deadline"].alias("deadline"), x["ord"].alias("ord"), x["j"].alias("j"))))
        return let(pick, lambda p: F.struct(
            F.filter(state["left"], lambda x: ~((x["ord"] == p["ord"]) & (x["j"] == p["j"]))).alias("left"),
            F.concat(state["done"], F.array(F.struct(p["ord"].alias("ord"), p["j"].alias("j"), p["deadline"].alias("deadline")))).alias("done"),
        ))

    done = F.array().cast("array<struct<ord:int,j:int,deadline:bigint>>")
    start = F.struct(jobs.alias("left"), done.alias("done"))
    return F.aggregate(F.sequence(F.lit(0), F.size(jobs) - 1), start, step)["done"]


def schedule(totals: DataFrame, weights: Mapping[str, int], other: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The unit schedules: mix_source, weight, j (block in the unit), tau_from, tau_to, slot_from, unit_slots, at, unit_deadline.

    Block ``k`` of the source lies in unit ``k div weight`` at ``j = k mod weight``; its slot is
    ``slot_from + (unit - tau_from) * unit_slots + at``.
    """
    full = _weights(weights, other)
    spark = totals.sparkSession
    names = spark.createDataFrame([(s, w, i) for i, (s, w) in enumerate(full.items())], "mix_source string, weight int, ord int")
    blocks = F.ceil(F.col("rows") / F.lit(block_rows)).cast("long")
    one = totals.join(F.broadcast(names), "mix_source").groupBy().agg(F.array_sort(F.collect_list(F.struct("ord", "mix_source", "weight", blocks.alias("blocks")))).alias("sources"))
    # Units in which a source ends stand alone; between them all units are alike.
    ends = F.transform("sources", lambda s: F.floor(s["blocks"] / s["weight"]).cast("long"))
    marks = F.array_distinct(F.array_sort(F.flatten(F.array(F.array(F.lit(0).cast("long")), ends, F.transform(ends, lambda e: e + 1)))))
    units = one.select("sources", marks.alias("marks")).select("sources", F.posexplode(F.transform("marks", lambda m, i: F.struct(m.alias("tau_from"), F.get("marks", i + 1).alias("tau_to")))).alias("u", "span"))
    units = units.select("sources", "span.tau_from", "span.tau_to").filter("tau_to is not null")
    units = units.withColumn("slot_from", _slots_at(F.col("sources"), F.col("tau_from")))
    left = F.transform("sources", lambda s: F.struct(s["ord"].alias("ord"), s["weight"].alias("weight"), (s["blocks"] - s["weight"] * F.col("tau_from")).alias("left")))
    units = units.withColumn("live", F.filter(left, lambda s: s["left"] > 0))

    def windows(s: Column) -> Column:
        n = F.least(s["weight"].cast("long"), s["left"]).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(
            F.floor(_slots_within(F.col("live"), j / s["weight"]) + 1e-6).cast("long").alias("release"),
            F.ceil(_slots_within(F.col("live"), (j + 1) / s["weight"]) - 1e-6).cast("long").alias("deadline"),
            s["ord"].alias("ord"), j.alias("j"),
        ))

    units = units.withColumn("jobs", F.flatten(F.transform("live", windows))).filter(F.size("jobs") > 0)
    units = units.withColumn("done", _earliest_deadline_first(F.col("jobs")))
    rows = units.select("tau_from", "tau_to", "slot_from", F.size("done").alias("unit_slots"), F.posexplode("done").alias("at", "job"))
    return rows.join(F.broadcast(names), F.col("job.ord") == F.col("ord")).select("mix_source", "weight", F.col("job.j").alias("j"), "tau_from", "tau_to", "slot_from", "unit_slots", "at", F.col("job.deadline").alias("unit_deadline"))


def mix(docs: DataFrame, weights: Mapping[str, int], other: int = 1, block_rows: int = BLOCK_ROWS, carry: Sequence[str] = (), runs: bool = False) -> DataFrame:
    """doc_id, source, mix_source, block, slot, deadline and position (gapless from 0) of every row, and the columns to carry.

    Rows of one doc_id are told apart, and so ordered, by the columns carried.
    """
    rows, totals = numbered(docs, weights, carry)
    plan = schedule(totals, weights, other, block_rows)
    full = _weights(weights, other)
    weight_of = F.create_map(*[x for s, w in full.items() for x in (F.lit(s), F.lit(w))])
    block = F.floor(F.col("n") / block_rows).cast("long")
    rows = rows.withColumn("block", block).withColumn("_w", weight_of[F.col("mix_source")])
    rows = rows.withColumn("tau", F.floor(F.col("block") / F.col("_w")).cast("long")).withColumn("_j", F.pmod(F.col("block"), F.col("_w")).cast("int"))
    p = F.broadcast(plan.withColumnRenamed("mix_source", "_s"))
    found = rows.join(p, (F.col("mix_source") == F.col("_s")) & (F.col("_j") == F.col("j")) & (F.col("tau") >= F.col("tau_from")) & (F.col("tau") < F.col("tau_to")))
    base = F.col("slot_from") + (F.col("tau") - F.col("tau_from")) * F.col("unit_slots")
    found = found.withColumn("slot", base + F.col("at")).withColumn("deadline", base + F.col("unit_deadline"))
    # The last block of a source may be short; later positions move up by what it lacks. One row per source.
    last = totals.select("mix_source", (F.ceil(F.col("rows") / block_rows) - 1).cast("long").alias("_last"), (F.lit(block_rows) - (F.col("rows") - (F.ceil(F.col("rows") / block_rows) - 1) * block_rows)).cast("long").alias("lack"))
    w = weight_of[F.col("mix_source")]
    tau = F.floor(F.col("_last") / w).cast("long")
    last = last.join(p, (F.col("mix_source") == F.col("_s")) & (F.pmod(F.col("_last"), w).cast("int") == F.col("j")) & (tau >= F.col("tau_from")) & (tau < F.col("tau_to")))
    last = last.select("mix_source", F.struct((F.col("slot_from") + (tau - F.col("tau_from")) * F.col("unit_slots") + F.col("at")).alias("slot"), "lack").alias("x"))
    lacks = last.groupBy().agg(F.collect_list("mix_source").alias("names"), F.collect_list("x").alias("lacks")).select(F.explode("names").alias("_m"), "lacks")
    found = found.join(F.broadcast(lacks), F.col("mix_source") == F.col("_m"))  # sources x sources entries
    lacking = F.aggregate(F.filter("lacks", lambda x: x["slot"] < F.col("slot")), F.lit(0).cast("long"), lambda a, x: a + x["lack"])
    position = F.col("slot") * block_rows + F.pmod(F.col("n"), F.lit(block_rows)) - lacking
    return found.select("doc_id", "source", "mix_source", "block", "slot", "deadline", position.cast("long").alias("position"), *carry, *(["run", "copies"] if runs else []))


def placed(docs: DataFrame, weights: Mapping[str, int], names: Sequence[str], other: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All documents with all columns and, under the two ``names``, their position and slot in the mixed order; each row has its own.

    Places are found without the texts, by a key of doc_id, source and 128-bit hashes of the text and of the other columns. Rows of one key are counted before they
    travel, and each key's columns are dealt once. Where a key has more than RUN_ROWS rows, each run of them gets the columns apart, so no number of
    equal rows meets in one task.
    """
    key, row, copies, run = fresh_names(docs, "key", "row", "copies", "run")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    none = F.lit("\u0000null")
    name = lambda c: F.coalesce(c.cast("string"), none)
    rest = [name(c) for c, n in zip(columns, docs.columns, strict=True) if n not in ("doc_id", "source", "text")]
    own = docs.withColumn(key, F.concat_ws("\u0001", name(F.col("doc_id")), name(F.col("source")), F.md5(name(F.col("text"))), F.md5(F.concat_ws("\u0001", *rest, F.lit("")))))
    at = mix(own.select("doc_id", "source", F.col(key)), weights, other, block_rows, carry=[key], runs=True)
    at = cut(at.select(F.col(key), F.col("run").alias(run), F.col("copies").alias("_many"), F.col("position").alias(names[0]), F.col("slot").alias(names[1])))
    whole = own.groupBy(key).agg(F.first(F.struct(*columns)).alias(row), F.count("*").alias(copies))
    few = whole.filter(F.col(copies) <= RUN_ROWS).join(at.filter(F.col("_many") <= RUN_ROWS), key)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(RUN_ROWS).cast("long"))).alias(run)
    many = whole.filter(F.col(copies) > RUN_ROWS).select(key, row, starts).join(at.filter(F.col("_many") > RUN_ROWS), [key, run])
    shown = lambda rows: rows.select(*[F.col(row)[c].alias(c) for c in docs.columns], *names)
    return shown(few).unionByName(shown(many))


def in_order(docs: DataFrame, weights: Mapping[str, int], other: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All documents with all columns, dealt over ranges of their mixed positions and sorted in each, so that files hold the mixed order."""
    names = fresh_names(docs, "position", "slot")
    return placed(docs, weights, names, other, block_rows).repartitionByRange(names[0]).sortWithinPartitions(names[0]).select(*[F.col(f"`{c}`") for c in docs.columns])
