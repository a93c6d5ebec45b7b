"""Rule-based document quality with cross-document line frequency.

Base rules look at one document: word and symbol counts, repeated lines and repeated three-word windows.
The method then hashes normalised lines (lower case, digit runs as ``0``, single spaces), counts the distinct documents of
each host in which a line occurs, takes lines above a limit as boilerplate, removes them, and rejects documents
that are depleted, that is keep less than ``min_kept_share`` of their words.

The limit of a host is ``max(min_docs, max_share x its distinct documents)``. Documents are distinct by text, so a
group of exact copies counts once and its lines are no boilerplate for being copied.

Scale: no text is shuffled. Lines travel as 64-bit hashes; distinct counts are combined map-side on
(host, line, document) and then on (host, line), so neither a hot host nor a hot line is gathered anywhere. The frequent lines
come back by ``join_hot`` on a hash of host and line. Lines are made twice: to count them, and to find the frequent ones; what is found is written once
(a checkpoint) and gives both the counts and the cuts. Very long texts are held as the lines of one row.

Defined results: null texts are empty; a null host is the host ``''``; repeated rows get equal verdicts; an empty table gives
no rows; extra columns are left out by the reports and kept, whatever their names, by ``keep_good`` and ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fresh_names, join_hot, let, text_of, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate for a host from this many distinct documents and this share of its documents on.
MIN_DOCS, MAX_SHARE = 20, 0.05
MIN_KEPT_SHARE = 0.5


def repeat_words(ws: Column, n: int = 3) -> Column:
    """Words that lie in an n-word window found twice or more in the text, the first one included.

    Windows are compared by 64-bit hashes. Only texts with an equal pair of windows sort (hash, position) pairs.
    """
    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of_sorted(p: Column) -> Column:
            def twin(x: Column, k: Column) -> Column:
                return ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | ((k + 1 < F.size(p)) & (F.get(p, k + 1)["h"] == x["h"]))

            starts = F.sort_array(F.transform(F.filter(p, twin), lambda x: x["i"]))
            return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, k: F.when(k + 1 < F.size(s), F.least(F.lit(n), F.get(s, k + 1) - x)).otherwise(F.lit(n))), F.lit(0), lambda a, x: a + x))

        return let(pairs, of_sorted)

    def hashed(w: Column) -> Column:
        # sequence() would count down below n words, so short texts are handled first
        return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))

    return let(ws, lambda w: F.when(F.size(w) < n, F.lit(0)).otherwise(let(hashed(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))))


def base_rules(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Add the counts of the base rules to the columns ``keep``."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(
        *keep,
        words(F.col("text")).alias("_words"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    counts = let(
        F.col("_words"),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    rows = rows.select(*keep, counts.alias("_c"), "n_symbols", "n_dup_lines")
    failed = (F.col("_c.n_words") < MIN_WORDS) | (100 * F.col("_c.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_c.n_words"))
    return rows.select(*keep, "_c.n_words", "_c.word_chars", "n_symbols", "n_dup_lines", "_c.n_repeat_words", failed.alias("base_failed"))


def line_rows(docs: DataFrame, host: str) -> DataFrame:
    """One row per non-blank line: doc_id, host, content (hash of the text), pos, line (hash), n (its words)."""
    text = text_of()
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(x))
    cells = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("line"), F.when(x == "", F.lit(0)).otherwise(F.size(F.split(x, " "))).alias("n")))
    rows = docs.select("doc_id", F.coalesce(F.col(host), F.lit("")).alias("host"), F.xxhash64(text).alias("content"), cells.alias("_cells"))
    return rows.select("doc_id", "host", "content", F.inline(F.filter("_cells", lambda x: x["n"] > 0)))


def frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """host, line (hash), docs and rows (how often all documents have it, copies included) of the lines above their host's limit."""
    per_line = line_rows(docs, host).groupBy("host", "line", "content").agg(F.count("*").alias("rows")).groupBy("host", "line").agg(F.count("*").alias("docs"), F.sum("rows").alias("rows"))
    contents = docs.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.xxhash64(text_of()).alias("content"))
    per_host = contents.groupBy("host", "content").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_docs"))
    return (
        per_line.filter(F.col("docs") >= min_docs).join(per_host, "host")
        .filter(F.col("docs") >= F.greatest(F.lit(float(min_docs)), F.lit(max_share) * F.col("host_docs"))).select("host", "line", "docs", "rows")
    )


def hit_lines(docs: DataFrame, host: str, lines: DataFrame) -> DataFrame:
    """doc_id, host, content, pos and n of the lines of ``docs`` that are among ``lines`` of their host (from ``frequent_lines``)."""
    key = F.xxhash64("host", "line", F.lit("hit")).alias("hit")
    side = cut(lines.groupBy(key).agg(F.max("rows").alias("n"), F.lit(True).alias("is_hit")))
    total = side.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    every = line_rows(docs, host).withColumn("hit", key)
    if not total:  # no line is frequent, so the texts need not be read again
        return every.drop("hit", "line").limit(0)
    return join_hot(every, side, "hit", total, F.struct("content", "pos")).filter("is_hit").drop("hit", "is_hit", "line")


def boilerplate(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """The boilerplate lines of the documents, as ``hit_lines`` gives them: found once, for counts and cuts."""
    return cut(hit_lines(docs, host, frequent_lines(docs, host, min_docs, max_share)))


def _verdicts(docs: DataFrame, hit: DataFrame, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    rows = base_rules(docs.select("doc_id", "text", F.xxhash64(text_of()).alias("_content")), ["doc_id", "_content"])
    once = hit.groupBy("doc_id", "content", "pos").agg(F.max("n").alias("n"))  # repeated rows count once
    gone = once.groupBy(F.col("doc_id").alias("_id"), F.col("content").alias("_c")).agg(F.sum("n").alias("n_removed"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_content") == F.col("_c")), "left")
    left = F.col("n_words") - F.coalesce("n_removed", F.lit(0))
    return joined.select(
        "doc_id", "_content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        (~F.col("base_failed") & (left >= F.lit(min_kept_share) * F.col("n_words"))).alias("kept"),
    )


def quality(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """doc_id, the base counts, base_failed, n_removed (words in boilerplate lines) and kept of every document."""
    return _verdicts(docs, boilerplate(docs, host, min_docs, max_share), min_kept_share).drop("_content")


def strip_lines(docs: DataFrame, lines: DataFrame, host: str = "source") -> DataFrame:
    """doc_id and text without its boilerplate lines, for documents that lose any (``lines`` from ``frequent_lines``)."""
    hit = hit_lines(docs, host, lines).select("doc_id", "content", "pos").distinct()
    cuts = hit.groupBy("doc_id", "content").agg(F.collect_set("pos").alias("cuts"))  # at most the lines of one document
    own = docs.select("doc_id", "text", F.xxhash64(text_of()).alias("content"))
    both = own.join(cuts.withColumnRenamed("doc_id", "_id").withColumnRenamed("content", "_c"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_c")))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("cuts", i))
    return both.select("doc_id", F.array_join(kept, "\n").alias("text"))


def keep_good(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """The documents that ``quality`` keeps, with all columns. Rejected rows (doc_id and text) leave by an anti join, so Spark may broadcast them if they are few."""
    id_, content = fresh_names(docs, "gone", "c")
    gone = _verdicts(docs, boilerplate(docs, host, min_docs, max_share), min_kept_share).filter(~F.col("kept")).select(F.col("doc_id").alias(id_), F.col("_content").alias(content)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(text_of()) == F.col(content)), "left_anti")


def clean(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """The documents that ``quality`` keeps, with all columns, without their boilerplate lines; n_chars follows the text.

    Rejections and cuts come back in one join on doc_id and text hash, so texts are shuffled once. A row is cut only where
    its own host has the line.
    """
    hit = boilerplate(docs, host, min_docs, max_share)
    gone = _verdicts(docs, hit, min_kept_share).filter(~F.col("kept")).select("doc_id", F.col("_content").alias("content"), F.lit(True).alias("gone"), F.lit(None).cast("struct<host:string,pos:int>").alias("cut"))
    cuts = hit.select("doc_id", "content", F.lit(False).alias("gone"), F.struct("host", "pos").alias("cut"))
    id_, content, out, at_ = fresh_names(docs, "id", "content", "out", "cuts")
    fate = gone.unionByName(cuts).groupBy("doc_id", "content").agg(F.max("gone").alias(out), F.collect_set("cut").alias(at_))  # at most the lines of one document
    fate = fate.withColumnsRenamed({"doc_id": id_, "content": content})
    both = docs.join(fate, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(text_of()) == F.col(content)), "left").filter(~F.coalesce(out, F.lit(False)))
    at = F.transform(F.filter(at_, lambda x: x["host"] == F.coalesce(F.col(host), F.lit(""))), lambda x: x["pos"])
    text = let(at, lambda p: F.when(F.size(p) > 0, F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(p, i)), "\n")).otherwise(F.col("text")))
    changed = F.coalesce(F.size(at_) > 0, F.lit(False))
    both = both.withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    return both.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)
