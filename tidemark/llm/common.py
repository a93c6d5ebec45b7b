"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of the six ASCII white-space characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain reference to a column made in an earlier projection may be inlined into a lambda and
    computed again for each element; a lambda variable never is.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(values: Column, zero: Column, add, block: int = 64, levels: int = 3) -> Column:
    """Running results of an associative ``add`` over an array, each with its own element, in about n x block steps.

    A plain fold cannot list its steps without copying the list each time. Here the values fall into blocks, the totals of the blocks are scanned
    the same way, and each element adds up its own block only.
    """
    def fold(a: Column) -> Column:
        return F.aggregate(a, zero, add)

    def short(a: Column) -> Column:
        return F.transform(a, lambda x, i: fold(F.slice(a, 1, i + 1)))

    def long(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(block)), lambda at: F.slice(a, at + 1, F.lit(block)))
        return let(blocks, lambda bs: let(scan(F.transform(bs, fold), zero, add, block, levels - 1), lambda before: F.flatten(F.transform(
            bs, lambda b, k: let(F.coalesce(F.get(before, k - 1), zero), lambda start: F.transform(b, lambda x, i: F.aggregate(F.slice(b, 1, i + 1), start, add)))))))

    if levels == 1:
        return let(values, short)
    return let(values, lambda a: F.when(F.size(a) <= block, short(a)).otherwise(long(a)))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while (name := f"_{name}") in taken:
            pass
        out.append(name)
    return out


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is named and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows from which a key may count as hot, and the most keys that can: ``join_hot`` sends at most this many rows to all tasks.
HOT_ROWS, MOST_HOT = 1_000, 1_000
#: Rows up to which a counted table is broadcast.
BROADCAST_ROWS = 200_000


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of ``rows`` narrow rows, to be broadcast if these are few; else the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_hot(rows: DataFrame, side: DataFrame, key: str, total: int, spread: Column) -> DataFrame:
    """``rows`` with the columns of ``side``, null where it lacks the key; no key's rows meet in one task.

    ``side`` has one row for each key with ``n``, the number of its rows, which must add up to ``total`` at most. Keys with a share of 1 / MOST_HOT or
    more - so at most MOST_HOT of them - come by a broadcast; their rows then go through the join of the others dealt by ``spread``.
    """
    more = [c for c in side.columns if c not in (key, "n")]
    if total < HOT_ROWS:
        own = side.select(F.col(key).alias("_side_key"), *[F.col(c).alias(f"_side_{c}") for c in more])
        return rows.join(own, F.col(key) == F.col("_side_key"), "left").select(*rows.columns, *[F.col(f"_side_{c}").alias(c) for c in more])
    side = cut(side)  # it is read twice
    cells = F.struct(*more)
    least = max(HOT_ROWS, -(-total // MOST_HOT))
    hot = side.filter(F.col("n") >= least).select(F.col(key).alias("_hot_key"), cells.alias("_hot"))
    cold = side.filter(F.col("n") < least).select(F.col(key).alias("_cold_key"), cells.alias("_cold"), F.lit(0).alias("_cold_salt"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    marked = marked.withColumn("_salt", F.when(F.col("_hot_key").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(997))).cast("int"))
    found = marked.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    own = F.coalesce("_hot", "_cold")
    return found.select(*rows.columns, *[own[c].alias(c) for c in more])


def drawn(draw: Column, rows: int, of: int) -> Column:
    """Whether a 64-bit hash is among the least ``rows`` of ``of`` evenly spread ones; all where there are no more. Exact to 62 bits, so no share is lost at any size."""
    return F.shiftrightunsigned(draw, 2) < min(1 << 62, (rows << 62) // max(1, of))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
