"""Calibration, ranking score, interaction of signals and the brief. All operators work on all companies at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import values as V

KEY = ["company_id", "signal_type"]


def corroboration_multiplier(n: Column) -> Column:
    out = None
    for k, m in V.CORROBORATION_MULTIPLIER.items():
        out = F.when(n == k, F.lit(m)) if out is None else out.when(n == k, F.lit(m))
    return out.otherwise(F.lit(V.MOST_CORROBORATION_MULTIPLIER))


def band(kind: Column, score: Column) -> Column:
    """(severity, rate) of the band that holds a score; outside all bands low and 0.10."""
    def of(x: Column) -> Column:
        out = None
        for t, bands in V.BANDS.items():
            for lo, hi, rate, severity in bands:
                value = F.struct(F.lit(severity).alias("severity"), F.lit(rate).alias("rate"))
                hit = (x["kind"] == t) & (x["score"] >= lo) & (x["score"] < hi)
                out = F.when(hit, value) if out is None else out.when(hit, value)
        return out.otherwise(F.struct(F.lit("low").alias("severity"), F.lit(0.10).alias("rate")))

    return X.once(F.struct(kind.alias("kind"), score.alias("score")), of)


def _calibrated(rows: DataFrame, adjusted: Column, factor: Column) -> DataFrame:
    rows = rows.withColumn("adjusted_score", adjusted).withColumn("_band", band(F.col("signal_type"), F.col("adjusted_score")))
    lone = (F.col("_band.severity") == "critical") & (F.col("corroboration") < V.CRITICAL_SOURCES)
    rate = F.when(lone, F.least(F.col("_band.rate"), F.lit(V.UNCONFIRMED_RATE))).otherwise(F.col("_band.rate"))
    return (
        rows.withColumn("severity", F.when(lone, "high").otherwise(F.col("_band.severity"))).withColumn("_rate", rate)
        .withColumn("confidence", X.rounded(F.least(F.col("_rate") * corroboration_multiplier(F.col("corroboration")) * factor, F.lit(1.0)), 3))
        .withColumn("rate", F.round("_rate", 3)).drop("_band", "_rate")
    )


def calibrate(candidates: DataFrame) -> DataFrame:
    """Add adjusted_score, severity, confidence and rate from the base-rate bands; critical needs two sources."""
    adjusted = F.least(F.col("raw_score") * corroboration_multiplier(F.col("corroboration")), F.lit(1.0))
    return _calibrated(candidates, adjusted, F.lit(1.0))


def sector_factor(sector: Column, kind: Column) -> Column:
    out = None
    for key, by_type in V.SECTOR_PRECISION.items():
        value = X.lookup(kind, by_type, 1.0)
        hit = F.lower(sector).contains(key)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.lit(1.0))


def adaptive_calibrate(candidates: DataFrame, company: DataFrame, stats: DataFrame) -> DataFrame:
    """As ``calibrate``, with the precision (from 10 votes on) and the false-positive rate (from the first) of the type's feedback, and its sector."""
    rows = candidates.join(company.select("company_id", "sector"), "company_id", "left")
    known = stats.filter(F.col("signal_type").isin(*V.SIGNAL_TYPES)).select("signal_type", F.col("total").alias("_n"), F.col("precision").alias("_precision"), F.col("fp_rate").alias("_fp"))  # at most 8 rows
    rows = rows.join(F.broadcast(known), "signal_type", "left")
    precision = F.when(F.coalesce("_n", F.lit(0)) < 10, 1.0).otherwise(F.greatest(F.lit(0.7), F.least(F.lit(1.3), 0.5 + F.col("_precision"))))
    penalty = F.greatest(F.lit(0.60), 1.0 - F.coalesce("_fp", F.lit(0.0)) * 0.5)
    rows = rows.withColumn("precision_factor", precision).withColumn("fp_factor", penalty).withColumn("sector_factor", sector_factor(F.col("sector"), F.col("signal_type")))
    adjusted = F.least(F.col("raw_score") * F.col("precision_factor") * F.col("fp_factor") * F.col("sector_factor") * corroboration_multiplier(F.col("corroboration")), F.lit(1.0))
    return _calibrated(rows, adjusted, F.col("precision_factor")).drop("_n", "_precision", "_fp")


def signals(calibrated: DataFrame) -> DataFrame:
    """Detected signals: calibrated candidates with headline and evidence."""
    return calibrated.withColumn("headline", F.concat(X.title_case(F.col("signal_type")), F.lit(" -- deterministic detection"))).withColumn("evidence", F.left("source_text", F.lit(200)))


def decay(at: Column, as_of: dt.datetime | Column, half_life: float, floor: float) -> Column:
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))
    return F.greatest(F.pow(F.lit(0.5), seconds / 86400.0 / half_life), F.lit(floor))


def liquidity_tier(ticker: Column, exchange: Column) -> Column:
    ex = F.upper(exchange)
    return (
        F.when(F.coalesce(ticker, F.lit("")) == "", "private").when(F.upper(ticker).isin(*V.LARGE_CAPS), "large_cap")
        .when(ex.contains("NYSE") | ex.contains("NASDAQ") | ex.contains("JSE"), "mid_cap")
        .when(ex.contains("NGX") | ex.contains("NSE") | ex.contains("GSE"), "small_cap").otherwise("mid_cap")
    )


def expected_move(rows: DataFrame) -> DataFrame:
    """Add direction, low_pct, high_pct, comparable_n and move_confidence by type and severity."""
    fields = ("direction", "low_pct", "high_pct", "comparable_n", "move_confidence")
    table = rows.sparkSession.createDataFrame([(t, s, *m) for (t, s), m in V.MOVES.items()], "signal_type string, severity string, direction string, low_pct double, high_pct double, comparable_n int, move_confidence string")
    joined = rows.join(F.broadcast(table), ["signal_type", "severity"], "left")  # 30 rows
    return joined.withColumns({f: F.coalesce(f, F.lit(d)) for f, d in zip(fields, V.NO_MOVE, strict=True)})


def score(found: DataFrame, company: DataFrame, *, as_of: dt.datetime | Column, compliance: bool = False, ticker: Column | None = None) -> DataFrame:
    """Add alpha (0 to 100), its parts, the expected move and the review flag with its reason. ``ticker``: an expression in place of the company's own."""
    w = V.ALPHA_WEIGHTS
    rows = found.join(company.select("company_id", "ticker", "exchange"), "company_id", "left")
    if ticker is not None:
        rows = rows.withColumn("ticker", ticker)
    rows = rows.withColumn("liquidity", liquidity_tier(F.col("ticker"), F.col("exchange")))
    # a tenth more or less can decide on a review, so the sum is rounded as a decimal
    rows = rows.withColumns({
        "severity_part": X.lookup(F.col("severity"), V.SEVERITY_WEIGHT, 0.28), "credibility_part": X.lookup(F.col("source_name"), V.CREDIBILITY, V.DEFAULT_CREDIBILITY),
        "corroboration_part": 1.0 - 1.0 / (1.0 + 0.8 * F.col("corroboration")), "recency_part": decay(F.col("doc_date"), as_of, V.RECENCY_HALF_LIFE, V.RECENCY_FLOOR),
    })
    raw = (
        F.col("severity_part") * w["severity"] + F.col("credibility_part") * w["credibility"] + F.col("corroboration_part") * w["corroboration"] + F.col("recency_part") * w["recency"]
        + X.lookup(F.col("liquidity"), V.LIQUIDITY_WEIGHT, 0.2) * w["liquidity"]
    )
    rows = expected_move(rows.withColumn("alpha", X.rounded(raw * 100, 1)))
    low = F.lit(compliance) & (F.col("confidence") < V.REVIEW_CONFIDENCE)
    reason = (
        F.when(F.col("alpha") >= V.REVIEW_ALPHA, F.format_string(V.REVIEW_TEXT["alpha"], F.round("alpha", 0).cast("int")))
        .when(F.col("severity") == "critical", F.lit(V.REVIEW_TEXT["critical"]))
        .when(low, F.format_string(V.REVIEW_TEXT["confidence"], F.round(F.col("confidence") * 100, 0).cast("int")))
    )
    return rows.withColumn("review_reason", reason).withColumn("review", reason.isNotNull())


def score_all(found: DataFrame, candidates: DataFrame, company: DataFrame, *, as_of: dt.datetime, compliance: bool = False) -> DataFrame:
    """Scores of signals (company_id, signal_type, severity, confidence) by their candidates; a signal without one is kept, without a score or a review."""
    own = candidates.select(*KEY, "source_name", "corroboration", "doc_date", F.lit(True).alias("_has"))
    rows = score(found.select(*KEY, "severity", "confidence").join(own, KEY, "left"), company, as_of=as_of, compliance=compliance)
    has = F.col("_has").isNotNull()
    return rows.withColumns({"alpha": F.when(has, F.col("alpha")), "review_reason": F.when(has, F.col("review_reason"))}).withColumn("review", F.col("review_reason").isNotNull()).drop("_has")


def compliance_split(found: DataFrame, least: float = V.REVIEW_CONFIDENCE) -> DataFrame:
    """Per company how many signals stay and how many low-confidence ones are suppressed."""
    kept = F.col("confidence") >= least
    return found.groupBy("company_id").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("suppressed"))


def compounds(found: DataFrame, *, window_days: int | None = None) -> DataFrame:
    """Interaction rules whose types a company all has at medium severity or more.

    Rule types (33 rows) are broadcast and joined by type; a rule fires where all its types are there. ``window_days``
    also asks that the signals lie within that many days; off by default.
    """
    spark = found.sparkSession
    rules = spark.createDataFrame(
        [(i, t, len(types), kind, esc, risk, mult, why, " + ".join(types)) for i, (types, kind, esc, risk, mult, why) in enumerate(V.INTERACTIONS) for t in types],
        "rule_no int, signal_type string, need int, kind string, escalation double, systemic_risk string, multiplier double, reasoning string, types string",
    )
    good = found.filter(F.col("severity").isin(*V.INTERACTION_SEVERITIES))
    held = good.join(F.broadcast(rules), "signal_type").groupBy("company_id", "rule_no").agg(
        F.count("*").alias("n"), F.first("need").alias("need"), *[F.first(c).alias(c) for c in ("kind", "escalation", "systemic_risk", "multiplier", "reasoning", "types")],
        F.sqrt(F.avg(F.col("confidence") * F.col("confidence"))).alias("_rms"), F.avg("corroboration").alias("_corr"), F.datediff(F.max("doc_date"), F.min("doc_date")).alias("_days"),
    ).filter("n = need")
    if window_days is not None:
        held = held.filter(F.col("_days") <= window_days)
    base = F.least("_rms", F.lit(1.0))
    conf = F.when(F.col("_corr") >= 3, F.least(base * 1.1, F.lit(1.0))).otherwise(base)
    rank = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("escalation"), "rule_no"))
    return held.withColumn("confidence", F.round(conf, 3)).withColumn("rank", rank).select("company_id", "rule_no", "types", "kind", "escalation", "systemic_risk", "multiplier", "reasoning", "confidence", "rank")


def alpha_boost(scored: DataFrame, found: DataFrame) -> DataFrame:
    """Multiply alpha by the largest multiplier of the type's compounds, contradictory ones aside; at most 100. Ranks by the new alpha."""
    types = found.filter("kind <> 'contradictory'").select("company_id", F.explode(F.split("types", r" \+ ")).alias("signal_type"), "multiplier")
    best = types.groupBy(*KEY).agg(F.greatest(F.max("multiplier"), F.lit(1.0)).alias("boost"))
    rows = scored.join(best, KEY, "left").withColumn("boost", F.coalesce("boost", F.lit(1.0)))
    rows = rows.withColumn("boosted_alpha", F.when(F.col("boost") == 1.0, F.col("alpha")).otherwise(X.rounded(F.least(F.col("alpha") * F.col("boost"), F.lit(100.0)), 1)))
    rows = rows.withColumn("review_after_compound", F.col("review") | (F.col("boosted_alpha") >= V.REVIEW_ALPHA))
    return rows.withColumn("alpha_rank", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc_nulls_last("boosted_alpha"), "signal_type")))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, V.SEVERITIES)), severity) - 1


def systemic_risk(found: DataFrame) -> DataFrame:
    """The worst systemic level of a company's compounds."""
    order = F.array_position(F.array(*map(F.lit, V.SYSTEMIC_ORDER)), F.col("systemic_risk"))
    return found.groupBy("company_id").agg(F.min_by("systemic_risk", order).alias("systemic_risk"))


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("company_id").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in V.SEVERITIES])


def top_signals(found: DataFrame, n: int = 3) -> DataFrame:
    order = Window.partitionBy("company_id").orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("confidence"), "signal_type")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def brief(boosted: DataFrame, found: DataFrame, candidates: DataFrame, filings: DataFrame, news: DataFrame) -> DataFrame:
    """One row per company with signals. The overall severity is that of the worst signal."""
    by = boosted.groupBy("company_id").agg(
        F.max("boosted_alpha").alias("top_alpha"), F.min_by("liquidity", "alpha_rank").alias("liquidity"), F.max_by("severity", severity_rank(F.col("severity"))).alias("overall_severity"),
        F.bool_or("review").alias("needs_review"), F.count("*").alias("n_signals"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in V.SEVERITIES],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("review"), F.struct("alpha_rank", "review_reason")))), lambda x: x["review_reason"]), "; ").alias("review_reasons"),
    )
    counts = candidates.groupBy("company_id").agg(F.count("*").alias("n_candidates"))
    sources = filings.groupBy("company_id").agg(F.count("*").alias("n_filings"))
    items = news.groupBy("company_id").agg(F.count("*").alias("n_news"))
    out = by.join(systemic_risk(found), "company_id", "left").join(counts, "company_id", "left").join(sources, "company_id", "left").join(items, "company_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "company_id", "top_alpha", "liquidity", "overall_severity", "needs_review", "review_reasons", "n_signals", *[f"n_{s}" for s in V.SEVERITIES],
        F.coalesce("systemic_risk", F.lit("isolated")).alias("systemic_risk"), zero("n_candidates").alias("n_candidates"), zero("n_filings").alias("n_filings"), zero("n_news").alias("n_news"),
        (zero("n_filings") + zero("n_news")).alias("total_sources"),
    )


def confidence_parts(candidates: DataFrame, stats: DataFrame, learned: DataFrame, *, as_of: dt.datetime, calibration_adjustment: float = 1.0) -> DataFrame:
    """The seven parts of confidence, their weighted sum and what lowers it."""
    w = V.CONFIDENCE_WEIGHTS
    rows = candidates.join(F.broadcast(stats.filter(F.col("signal_type").isin(*V.SIGNAL_TYPES)).select("signal_type", F.col("total").alias("_n"), F.col("precision").alias("_p"))), "signal_type", "left")  # at most 8 rows
    rows = rows.join(learned.select("source_name", F.col("reliability").alias("_learned")), "source_name", "left")
    fixed = X.lookup(F.col("source_name"), V.CREDIBILITY, V.DEFAULT_CREDIBILITY)
    strength = F.when(F.col("source_type") == "filing", X.lookup(F.col("source_name"), V.FILING_STRENGTH, V.OTHER_FILING_STRENGTH)).when(F.col("source_type") == "pe_source", V.FILING_STRENGTH["pe_source"]).otherwise(V.FILING_STRENGTH["news"])
    n, m = F.size("entities"), F.size("patterns")
    rows = rows.withColumns({
        "source_reliability": X.rounded(0.70 * fixed + 0.30 * F.coalesce("_learned", fixed), 4),
        "corroboration_part": F.round(1.0 - 1.0 / (1.0 + 0.9 * F.col("corroboration")), 4),
        "filing_strength": strength,
        "historical_precision": F.when(F.coalesce("_n", F.lit(0)) < 5, 0.60).otherwise(F.round("_p", 4)),
        "entity_match": F.when(n == 0, 0.30).when(n == 1, 0.55).when(n == 2, 0.72).otherwise(0.88),
        "temporal_relevance": F.round(decay(F.col("doc_date"), as_of, V.TEMPORAL_HALF_LIFE, V.TEMPORAL_FLOOR), 4),
        "extraction": F.when(m >= 3, 0.92).when(m == 2, 0.80).otherwise(0.65),
    })
    parts = {"source_reliability": "source_reliability", "corroboration": "corroboration_part", "filing_strength": "filing_strength", "historical_precision": "historical_precision", "entity_match": "entity_match", "temporal_relevance": "temporal_relevance", "extraction": "extraction"}
    total = sum((F.col(c) * w[k] for k, c in parts.items()), F.lit(0.0))
    why = F.concat_ws(
        ", ",
        F.when(F.col("source_reliability") < 0.60, F.format_string(V.CONFIDENCE_TEXT["source"], X.rounded(F.col("source_reliability") * 100, 0).cast("int"))),
        F.when(F.col("corroboration_part") < 0.55, F.format_string(V.CONFIDENCE_TEXT["corroboration"], F.col("corroboration"))),
        F.when(F.col("historical_precision") < 0.50, F.lit(V.CONFIDENCE_TEXT["precision"])),
        F.when(F.col("temporal_relevance") < 0.50, F.lit(V.CONFIDENCE_TEXT["age"])),
    )
    return rows.withColumn("final_confidence", X.rounded(F.least(total * calibration_adjustment, F.lit(1.0)), 4)).withColumn(
        "reasoning", F.when(why == "", F.lit(V.CONFIDENCE_TEXT["normal"])).otherwise(F.format_string(V.CONFIDENCE_TEXT["reduced"], why))
    ).select(*KEY, *parts.values(), "final_confidence", "reasoning")
