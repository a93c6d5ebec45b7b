"""Winnowing fingerprints of documents.

A text becomes lower-case words; every run of K words (the whole text if it has fewer) gets a polynomial hash over its word hashes, rolled
from one run to the next in blocks of ``ROLL`` runs: the word that leaves is taken out, the rest moved up, the word that comes added. Of each W
consecutive hashes the least is chosen, the rightmost of equal ones, and kept with its position. Two texts that share a passage of at least
``K + W - 1`` words therefore share a chosen hash, and the positions say where.

Hash and position travel in one 64-bit number, ``hash << 31 | (2^31 - 1 - position)``, so that the plain minimum takes the
least hash and the rightmost of ties. The minimum of 8 comes from three doubling steps, not from 8 comparisons.

The neighbour that the document query needs is found without a global sort: documents are dealt over ranges of ``doc_id`` of about RANGE_ROWS
rows each, and the first row of each range is also given to the range before it, so one ``lead`` per range sees every neighbour. Ranges have two
levels, at most 256 coarse ones and as many in each as the data needs; their bounds are quantiles, kept in tables. Texts are shuffled once.

Defined results: null texts are empty and have an empty fingerprint; the likeness of two empty fingerprints is 1; a doc_id of any type is ordered as a
number where it is one, else as text; rows that share a doc_id are ordered by a hash of their text; null ids come last; an empty table gives no rows; extra columns
are left out.
"""

from __future__ import annotations

from decimal import Decimal
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm.common import cut, if_small, let, words

K, W = 5, 8
#: Multiplier and modulus of the rolling hash; products stay below 2^62.
BASE, PRIME = 1_000_003, 2_147_483_647
_LOW = (1 << 31) - 1
#: Runs to a block in which the hash rolls.
ROLL = 32
#: Documents to a range, and coarse ranges.
RANGE_ROWS, COARSE = 512, 256


def kgrams(ws: Column, k: int = K) -> Column:
    """Rolling hashes (0 to PRIME - 1) of all runs of k words; of the whole sequence if it is shorter."""
    codes = F.transform(ws, lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(PRIME)))
    top = pow(BASE, k - 1, PRIME)

    def full(c: Column, i: Column) -> Column:
        h = F.get(c, i)
        for j in range(1, k):
            h = (h * BASE + F.get(c, i + j)) % PRIME
        return h

    def block(c: Column, first: Column, runs: Column) -> Column:
        def roll(state: Column, i: Column) -> Column:
            out = F.get(c, i - 1) * top % PRIME
            return let((state["h"] + PRIME - out) % PRIME * BASE, lambda moved: let((moved + F.get(c, i + k - 1)) % PRIME, lambda h: F.struct(h.alias("h"), F.concat(state["all"], F.array(h)).alias("all"))))

        return let(full(c, first), lambda h: F.when(runs - first <= 1, F.array(h)).otherwise(
            F.aggregate(F.sequence(first + 1, F.least(first + ROLL, runs) - 1), F.struct(h.alias("h"), F.array(h).alias("all")), roll, lambda s: s["all"])))

    def all_runs(c: Column) -> Column:
        short = F.array(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: (a * BASE + x) % PRIME))
        rolled = let(F.size(c) - (k - 1), lambda runs: F.flatten(F.transform(F.sequence(F.lit(0), runs - 1, F.lit(ROLL)), lambda first: block(c, first, runs))))
        return F.when(F.size(c) == 0, F.array().cast("array<bigint>")).when(F.size(c) < k, short).otherwise(rolled)

    return let(codes, all_runs)


def winnow(ws: Column, k: int = K, w: int = W) -> Column:
    """array<struct<hash,pos>> of the chosen k-grams, in text order. ``w`` is a power of two."""
    if w < 1 or w & (w - 1):
        raise ValueError("w must be a power of two")
    marked = F.transform(kgrams(ws, k), lambda h, i: F.shiftleft(h, 31) + (F.lit(_LOW) - i))

    def doubled(m: Column, step: int) -> Column:
        if step >= w:
            return m
        return let(F.transform(F.slice(m, 1, F.size(m) - step), lambda x, i: F.least(x, F.get(m, i + step))), lambda n: doubled(n, 2 * step))

    def chosen(m: Column) -> Column:
        least = F.when(F.size(m) == 0, m).when(F.size(m) < w, F.array(F.array_min(m))).otherwise(doubled(m, 1))
        return F.transform(F.array_distinct(least), lambda x: F.struct(F.shiftright(x, 31).cast("int").alias("hash"), (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).cast("int").alias("pos")))

    return let(marked, chosen)


def hash_set(chosen: Column) -> Column:
    """Distinct hashes of chosen (hash, pos) pairs, in text order."""
    return F.array_distinct(F.transform(chosen, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    return let(shared, lambda n: F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def digest(hashes: Column) -> Column:
    """The set as text: 8 hex digits a hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def _ranges(keys: DataFrame, ranges: int) -> tuple[list[int], DataFrame] | None:
    """Bounds of the coarse ranges, and a table of coarse, bounds and heads (each 64th bound) of the fine ranges in each; None for a single range."""
    if ranges <= 1:
        return None
    coarse = min(COARSE, ranges)
    at = keys.agg(F.percentile_approx("_at", [i / coarse for i in range(1, coarse)], 8 * coarse).alias("q")).first()["q"] if coarse > 1 else []
    edges = sorted(set(at))  # at most 255 numbers
    fine = -(-ranges // coarse)
    steps = F.array(*[F.lit(x) for x in edges]).cast("array<double>")
    own = keys.select("_at", F.size(F.filter(steps, lambda b: b <= F.col("_at"))).alias("_coarse"))
    q = F.array_sort(F.array_distinct(F.percentile_approx("_at", [i / fine for i in range(1, fine)], 8 * fine))) if fine > 1 else F.array().cast("array<double>")
    found = own.groupBy("_coarse").agg(q.alias("_bounds"))
    return edges, cut(found.withColumn("_heads", F.filter("_bounds", lambda b, i: i % 64 == 63)))


def with_next(docs: DataFrame, derived: dict[str, Column] | None = None) -> DataFrame:
    """Add ``next_text``: the text of the next document in descending doc_id, of the first after the last.

    ``derived`` columns are computed from ``text`` once, after the shuffle, and also get a ``next_`` twin.
    """
    derived = derived or {}
    low = F.lit(-(1 << 63))
    number = F.col("doc_id").try_cast("long")
    name = F.col("doc_id").cast("string")
    facts = docs.agg(F.count("*").alias("n"), F.min(number).alias("low"), F.min(F.when(number.isNull(), name)).alias("least"), F.max(F.when(number.isNull(), name)).alias("most")).first()
    n = facts["n"]
    # texts that are no number keep their order by the seven bytes behind what all of them begin with, above all numbers
    same = len(commonprefix([(facts["least"] or "").encode(), (facts["most"] or "").encode()]))
    word = F.conv(F.rpad(F.hex(F.substring(F.encode(name, "utf-8"), same + 1, 7)), 14, "0"), 16, 10).try_cast("long")
    key = F.coalesce(number, F.when(F.col("doc_id").isNotNull(), word + F.lit(1 << 62)), low)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("_key"), F.coalesce(name, F.lit("")).alias("_name"))
    rows = rows.withColumn("_content", F.shiftrightunsigned(F.xxhash64("text"), 24))
    # where a key is an id, rows of one id are dealt by a hash of their text too; a double keeps the order, and what it makes equal stays together
    at = F.col("_key").cast("double")
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        at = ((F.col("_key").cast("decimal(20,0)") - F.lit(Decimal(facts["low"] or 0))).cast("decimal(21,0)") * F.lit(Decimal(1 << 40)) + F.col("_content")).cast("double")
        at = F.when(F.col("doc_id").isNull(), F.col("_content") - F.lit(float(1 << 41))).otherwise(at)
    rows = rows.withColumn("_at", at)
    ranges = _ranges(rows.select("_at"), n // RANGE_ROWS)
    if ranges is None:
        rows = rows.withColumns({"_coarse": F.lit(0), "_fine": F.lit(0)})
    else:
        edges, bounds = ranges
        steps = F.array(*[F.lit(x) for x in edges]).cast("array<double>")
        rows = rows.withColumn("_coarse", F.size(F.filter(steps, lambda b: b <= F.col("_at"))))
        bounds = bounds.withColumnRenamed("_coarse", "_own")
        rows = rows.join(F.broadcast(bounds), F.abs("_coarse") == F.abs("_own")).drop("_own")  # at most 256 rows, 8 bytes for RANGE_ROWS documents
        block = F.size(F.filter("_heads", lambda b: b <= F.col("_at")))
        fine = let(block, lambda c: c * 64 + F.size(F.filter(F.slice("_bounds", c * 64 + 1, F.lit(64)), lambda b: b <= F.col("_at"))))
        rows = rows.withColumn("_fine", fine).drop("_bounds", "_heads")
    # the range that takes the greatest row of each: the next higher range that has rows, the lowest for the last
    tops = cut(rows.groupBy("_coarse", "_fine").agg(F.max(F.struct("_key", "_name", "_content")).alias("_top")))
    firsts = tops.groupBy("_coarse").agg(F.min("_fine").alias("_first"))  # at most 256 rows
    found = sorted(tuple(r) for r in firsts.collect())
    onward = docs.sparkSession.createDataFrame([(c, *after) for (c, _), after in zip(found, found[1:] + found[:1], strict=True)], "_c int, _next_coarse int, _next_fine int")
    # equality of a function of both: what the optimizer knows of a range's number from doc_id, it would else put on the other side, which has no doc_id
    same = lambda a, b: F.abs(a) == F.abs(b)
    fine_next = F.lead("_fine").over(Window.partitionBy("_coarse").orderBy("_fine"))
    given = tops.withColumn("_up", fine_next).join(F.broadcast(onward), same("_coarse", "_c"))
    given = given.select(
        F.col("_coarse").alias("_gc"), F.col("_fine").alias("_gf"), F.col("_top").alias("_gt"),
        F.when(F.col("_up").isNull(), F.struct(F.col("_next_coarse").alias("c"), F.col("_next_fine").alias("f"))).otherwise(F.struct(F.col("_coarse").alias("c"), F.col("_up").alias("f"))).alias("_to"))
    cell = lambda c, f, halo: F.struct(c.alias("_rc"), f.alias("_rf"), F.lit(halo).alias("_halo"))
    own = cell(F.col("_coarse"), F.col("_fine"), False)
    copies = F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, cell(F.col("_to.c"), F.col("_to.f"), True)))
    small = if_small(given, -(-n // RANGE_ROWS) + 1)
    dealt = rows.join(small, same("_coarse", "_gc") & same("_fine", "_gf") & (F.struct("_key", "_name", "_content") == F.col("_gt")), "left").select("doc_id", "text", "_key", "_name", "_content", F.inline(copies))
    follow = Window.partitionBy("_rc", "_rf").orderBy("_halo", F.desc("_key"), F.desc("_name"), F.desc("_content"), "text")
    seen = dealt.repartition("_rc", "_rf").withColumns(derived) if derived else dealt
    led = seen.withColumns({f"next_{c}": F.lead(c).over(follow) for c in ["text", *derived]})
    return led.filter(~F.col("_halo")).drop("_key", "_name", "_content", "_rc", "_rf", "_halo")


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars and the chosen (hash, pos) pairs of every text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), winnow(words(text), k, w).alias("chosen"))


def compare_edited(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness to it and to the next document's; ``positions`` are those of the text's chosen
    runs (word numbers from 0), in text order."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs, {"f": winnow(words(F.col("text")), k, w)})
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), hash_set(F.col("f")).alias("f"), F.transform("f", lambda x: x["pos"]).alias("positions"), hash_set(F.col("next_f")).alias("x"), edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "f", "positions", hash_set(winnow(words(F.col("edited")), k, w)).alias("e"), "x")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("f")).alias("fingerprint"), digest(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("x")).alias("near_next"), F.array_join("positions", ",").alias("positions"),
    )
