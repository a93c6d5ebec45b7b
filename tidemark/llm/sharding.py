"""Weighted rendezvous (highest random weight) hashing of stable record keys.

Every shard draws a pseudo-random number from (key, shard); with weight ``w`` the record goes to the
shard with the least ``-ln(u) / w``. A new shard only ever wins records for itself, so growing from n to
n + 1 shards moves about ``w_new / sum(w)`` of the records and none between old shards.

Slots are numbered in parts of a shard, whose number grows with the rows. Equal rows are counted first and numbered as one run, so neither a hot key
nor very many equal rows meet in one part.

Defined results: a null key is a key of its own; rows that share a key share a shard and get slots of
their own, in order of their content's hash; null and empty texts have 0 bytes; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that a record takes besides its text.
RECORD_OVERHEAD = 16
#: Rows to a part that is numbered alone, and equal rows that one task writes out.
PART_ROWS, RUN_ROWS = 50_000, 4_096
#: Weights of the shards of the registered query: each fourth has a quarter more room.
WEIGHTS = [1.25 if i % 4 == 3 else 1.0 for i in range(40)]


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key: the position in ``weights`` that wins."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    name = F.coalesce(key.cast("string"), F.lit("\u0000null"))

    def draw(shard: int) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(name, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.ln(u) / F.lit(float(weights[shard]))).alias("cost"), F.lit(shard).alias("shard"))

    return F.array_min(F.array(*map(draw, range(len(weights)))))["shard"]


def assign(df: DataFrame, key: str, weights: Sequence[float], grown_weights: Sequence[float] | None = None) -> DataFrame:
    """Add ``shard``, and ``grown_shard`` if ``grown_weights`` (the same weights and more) is given."""
    out = df.withColumn("shard", rendezvous(F.col(key), weights))
    if grown_weights is not None:
        if list(grown_weights[: len(weights)]) != list(weights):
            raise ValueError("grown_weights must begin with weights")
        out = out.withColumn("grown_shard", rendezvous(F.col(key), grown_weights))
    return out


def number(df: DataFrame, shard: str, total: int) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard, without bringing a whole shard into one task. ``total`` is about the number of rows.

    Each shard falls into hashed parts of the whole row; equal rows are one row with a count. Parts are summed (map-side combined), their offsets
    summed over the parts, and rows numbered per part by running sums. A row of many equal ones is written out in runs that are dealt
    over the cluster.
    """
    cols = df.columns
    part = F.pmod(F.xxhash64(*cols, F.lit("part")), F.lit(max(1, total // PART_ROWS)))
    rows = df.groupBy(*cols).agg(F.count("*").alias("_copies")).withColumn("_part", part)
    to_here = Window.rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col(shard).alias("_shard"), F.col("_part").alias("_own")).agg(F.sum("_copies").alias("_n"))
    offsets = sizes.select("_shard", "_own", F.coalesce(F.sum("_n").over(to_here.partitionBy("_shard").orderBy("_own")), F.lit(0)).alias("_offset"))
    place = F.coalesce(F.sum("_copies").over(to_here.partitionBy(shard, "_part").orderBy(F.xxhash64(*cols), *cols)), F.lit(0))
    placed = rows.withColumn("_place", place).join(offsets, (F.col(shard) == F.col("_shard")) & (F.col("_part") == F.col("_own")))
    placed = placed.select(*cols, "_copies", (F.col("_offset") + F.col("_place")).cast("long").alias("slot"))
    one = placed.filter("_copies = 1").select(*cols, "slot")
    runs = placed.filter("_copies > 1").withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(RUN_ROWS).cast("long")))).repartition(*cols, "_run")
    last = F.least(F.col("_run") + RUN_ROWS, F.col("_copies")) - 1
    return one.unionByName(runs.withColumn("_i", F.explode(F.sequence("_run", last))).select(*cols, (F.col("slot") + F.col("_i")).alias("slot")))


def shard_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, grown: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard with one more of weight ``grown`` for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(RECORD_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = assign(rows, "doc_id", weights, [*weights, grown])
    return number(rows, "shard", docs.count()).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int")
    )
