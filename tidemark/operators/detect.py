"""From filings and news to signal candidates: rule hits, raw scores and corroboration.

Inputs: filings (company_id, doc_no, accession_number, filing_date, form_type, cik, description, raw_excerpt) and news (company_id, doc_no,
published_date, source, title, snippet, relevance_score). Blank texts have no hits. Every choice among equals follows the order filings
first (date, number), then news (relevance descending, date, number), so results do not depend on how rows are stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import values as V

KEY = ["company_id", "signal_type"]
#: Order of encounter: kind of source, then two keys within it.
ORDER = ["src_no", "rank_no", "doc_date", "doc_no"]


def filing_text():
    return F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("description", "raw_excerpt", "form_type")])


def filing_credibility():
    """Venue codes count before form types."""
    return (
        F.when(F.col("cik").isin("NGX", "JSE", "NSE-KE"), 0.95)
        .when(F.col("form_type").isin("8-K", "JSE SENS", "NGX Announcement", "NSE Kenya Disclosure"), 1.00)
        .otherwise(X.contained_credibility(F.col("form_type")))
    )


def filing_hits(filings: DataFrame, rules: Sequence = V.RULES) -> DataFrame:
    """One row per filing and signal type that its text holds; venue codes count before form types."""
    text = filing_text()
    credibility = filing_credibility()
    rows = filings.select(
        "company_id", F.lit(0).alias("src_no"), F.lit(0.0).alias("rank_no"), F.col("filing_date").alias("doc_date"), "doc_no",
        F.lit("filing").alias("source_type"), F.col("form_type").alias("source_name"), F.col("accession_number").alias("ref"), credibility.alias("credibility"), text.alias("text"),
    ).filter(F.length(F.trim("text")) > 0)
    rows = rows.withColumn("hit", F.explode(X.rule_hits("text", rules)))
    return _hit_columns(rows, F.least(F.col("hit.base_score") * F.col("credibility"), F.lit(1.0)))


def news_hits(news: DataFrame, rules: Sequence = V.RULES, weakest: float = V.WEAK_NEWS) -> DataFrame:
    """One row per news item and signal type whose raw score is at least ``weakest``."""
    rows = news.select(
        "company_id", F.lit(1).alias("src_no"), (-F.col("relevance_score")).alias("rank_no"), F.col("published_date").alias("doc_date"), "doc_no",
        F.lit("news").alias("source_type"), F.col("source").alias("source_name"), F.lit(None).cast("string").alias("ref"),
        X.contained_credibility(F.col("source")).alias("credibility"), F.concat_ws(" ", "title", "snippet").alias("text"), "relevance_score",
    ).filter(F.length(F.trim("text")) > 0)
    rows = rows.withColumn("hit", F.explode(X.rule_hits("text", rules)))
    scored = _hit_columns(rows, F.least(F.col("hit.base_score") * F.col("credibility") * F.col("relevance_score"), F.lit(1.0)))
    return scored.filter(F.col("raw_score") >= weakest)


def _hit_columns(rows: DataFrame, raw) -> DataFrame:
    return rows.select(
        "company_id", F.col("hit.signal_type").alias("signal_type"), *ORDER, "source_type", "source_name", "ref",
        F.col("hit.base_score").alias("base_score"), raw.alias("raw_score"), F.col("hit.patterns").alias("patterns"), F.left("text", F.lit(500)).alias("source_text"), "text",
    )


def merge_candidates(hits: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One candidate per company and type: the best hit, the distinct patterns in order of encounter, the count of distinct sources. ``extra`` columns are keys too.

    The texts are searched once. Hits are first reduced map-side to one row per company, type, source and pattern, so that what is
    listed for a company and type is bounded by its sources times the rule table, however many documents it has.
    """
    keys = [*extra, *KEY]
    best = F.struct("source_type", "source_name", "ref", "base_score", "raw_score", "doc_date", "doc_no", "text")
    at = F.struct((-F.col("raw_score")).alias("least"), *ORDER)
    rows = hits.select(*keys, best.alias("best"), at.alias("at"), *ORDER, "source_type", "source_name", F.posexplode("patterns").alias("pos", "pattern"))
    rows = rows.withColumns({c: F.when(F.col("pos") == 0, F.col(c)) for c in ("best", "at")})  # a hit's text travels with its first pattern only
    one = rows.groupBy(*keys, "source_type", "source_name", "pattern").agg(
        F.min(F.struct(*ORDER, "pos")).alias("first"), F.min_by("best", "at").alias("best"), F.min("at").alias("at"))
    merged = one.groupBy(*keys).agg(
        F.min_by("best", "at").alias("best"), F.size(F.collect_set(F.struct("source_type", "source_name"))).alias("corroboration"),
        F.array_sort(F.collect_list(F.struct("first", "pattern"))).alias("listed"),
    )
    patterns = F.array_distinct(F.transform("listed", lambda x: x["pattern"]))
    out = merged.select(*keys, "best.*", F.left("best.text", F.lit(500)).alias("source_text"), "corroboration", patterns.alias("patterns"))
    return out.withColumn("entities", X.entities(F.col("text"))).drop("text")


def detect(filings: DataFrame, news: DataFrame, rules: Sequence = V.RULES) -> DataFrame:
    """Candidates of all companies."""
    return merge_candidates(filing_hits(filings, rules).unionByName(news_hits(news, rules)))


def _rule_rows(spark: SparkSession, rules: Sequence) -> DataFrame:
    return spark.createDataFrame([(t, float(s), i, len(ps)) for i, (t, s, ps) in enumerate(rules)], "signal_type string, score double, tier int, patterns bigint")


def registry_tiers(hits: DataFrame, rules: Sequence = V.RULES) -> DataFrame:
    """Each rule (signal_type, score, tier, patterns) with the hits it gave."""
    given = hits.groupBy("signal_type", F.col("base_score").alias("score")).agg(F.count("*").alias("hits"))
    return _rule_rows(hits.sparkSession, rules).join(given, ["signal_type", "score"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def registry(hits: DataFrame, rules: Sequence = V.RULES) -> DataFrame:
    """Per signal type the patterns, tiers and scores of its rules with the hits in these documents: all, by companies, and by the best rule."""
    own = _rule_rows(hits.sparkSession, rules).groupBy("signal_type").agg(F.sum("patterns").alias("patterns"), F.max("score").alias("high"), F.min("score").alias("low"), F.count("*").alias("tiers"))
    top = {t: max(s for k, s, _ in rules if k == t) for t, _, _ in rules}
    best = F.count_if(F.col("base_score") == X.lookup(F.col("signal_type"), top, 0.0))
    given = hits.groupBy("signal_type").agg(F.count("*").alias("hits"), F.count_distinct("company_id").alias("companies"), best.alias("best"))
    return own.join(given, "signal_type", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("hits", "companies", "best")})
