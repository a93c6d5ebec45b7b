"""All registered queries of the signal engine over the star schema, and equal SQL for those that SQL can express.

Queries return flat columns (lists joined to text), so that values can be compared. ``AS_OF`` is the moment all ages are measured from.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import values as V
from tidemark.operators import detect as D
from tidemark.operators import entity_graph as G
from tidemark.operators import history as H
from tidemark.operators import ingest as I
from tidemark.operators import score as S
from tidemark.plans import oracle as O
from tidemark.sources import store
from tidemark.sources.projections import view
from tidemark.streaming import jobs as J

AS_OF = dt.datetime(2024, 2, 1)
REPLAY_AT = dt.datetime(2024, 1, 15)
FEEDBACK_ORDER = ["k1", "k2", "k3", "k4", "k5"]
FORMS = ("8-K", "10-K", "SC 13D")


class Frames:
    """The engine's frames for one folder, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def v(self, name: str) -> DataFrame:
        return view(self.spark, self.dir, name)

    company = cached_property(lambda self: self.v("v_company"))
    filing = cached_property(lambda self: self.v("v_filing"))
    news = cached_property(lambda self: self.v("v_news"))
    candidates = cached_property(lambda self: D.detect(self.filing, self.news))
    calibrated = cached_property(lambda self: S.calibrate(self.candidates))
    stats = cached_property(lambda self: H.feedback_stats(self.v("v_feedback")))
    found = cached_property(lambda self: S.signals(self.calibrated))
    scored = cached_property(lambda self: S.score(self.found, self.company, as_of=AS_OF))
    compounds = cached_property(lambda self: S.compounds(self.found))
    boosted = cached_property(lambda self: S.alpha_boost(self.scored, self.compounds))
    outcome = cached_property(lambda self: H.outcome_record(self.v("v_outcome")))
    edges = cached_property(lambda self: G.latest_edges(self.v("v_edge_event"), ["added", "added_no", "added_sub"]))
    nodes = cached_property(lambda self: self.v("v_node"))
    memory = cached_property(lambda self: H.company_memory(self.v("v_run"), self.v("v_run_signal")))
    chain = cached_property(lambda self: H.audit_build(self.v("v_audit")))

    @cached_property
    def distressed(self) -> DataFrame:
        return self.v("v_run").filter("severity = 'critical'").select(F.concat(F.lit("c"), F.col("company_id").cast("string")).alias("company")).distinct()


    def with_stored_candidates(self) -> Frames:
        """The same frames, with the candidates stored and read back: the texts are searched once, whatever is made of them."""
        folder, out = store.shared_folder(self.spark, "candidates"), Frames(self.spark, self.dir)
        store.store_run({"signal_candidates": self.candidates}, folder, "run")
        out.candidates = store.read_table(self.spark, folder, "signal_candidates", "run").drop("run_id")
        return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Frames under its name, with SQL if there is some."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Frames(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = O.complete(sql)
        return f

    return register


r6 = lambda c: X.rounded(F.col(c), 6).alias(c)

# ---- detection -----------------------------------------------------------------------------------------------


@query("SELECT company_id, doc_no, signal_type, base_score, pats AS patterns FROM hits WHERE src_no = 0")
def rule_hits(f):
    return D.filing_hits(f.filing).select("company_id", "doc_no", "signal_type", "base_score", F.array_join("patterns", " | ").alias("patterns"))


@query("SELECT company_id, doc_no, signal_type, " + O.half_up("raw_score", 6) + " AS raw_score, source_name, ref FROM hits WHERE src_no = 0")
def candidates_filings(f):
    return D.filing_hits(f.filing).select("company_id", "doc_no", "signal_type", r6("raw_score"), "source_name", "ref")


@query("SELECT company_id, doc_no, signal_type, " + O.half_up("raw_score", 6) + " AS raw_score, source_name FROM hits WHERE src_no = 1")
def candidates_news(f):
    return D.news_hits(f.news).select("company_id", "doc_no", "signal_type", r6("raw_score"), "source_name")


@query("SELECT company_id, signal_type, source_type, source_name, doc_no, " + O.half_up("raw_score", 6) + " AS raw_score, corroboration, patterns, row_number() OVER (PARTITION BY company_id ORDER BY raw_score DESC, signal_type) AS rank FROM cand")
def candidate_merge(f):
    rank = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("raw_score"), "signal_type"))
    return f.candidates.select("company_id", "signal_type", "source_type", "source_name", "doc_no", r6("raw_score"), "corroboration", F.array_join("patterns", " | ").alias("patterns"), rank.alias("rank"))


@query("SELECT DISTINCT source AS source_name, cred FROM (SELECT source, " + O.contained_credibility("source") + " AS cred FROM v_news)")
def source_credibility(f):
    return f.news.select(F.col("source").alias("source_name"), X.contained_credibility(F.col("source")).alias("cred")).distinct()


@query("SELECT doc_no, " + O.host_source("url", V.NEWS_HOSTS) + " AS news_source, " + O.host_source("url", V.REGIONAL_HOSTS) + " AS regional_source FROM v_news")
def url_source(f):
    return f.news.select("doc_no", X.source_of_url(F.col("url"), V.NEWS_HOSTS).alias("news_source"), X.source_of_url(F.col("url"), V.REGIONAL_HOSTS).alias("regional_source"))


@query("""SELECT doc_no, coalesce(array_to_string(list_slice(list_distinct_ordered, 1, 10), ' | '), '') AS entities FROM (
  SELECT doc_no, list_filter(all_, lambda x, i: list_position(all_, x) = i) AS list_distinct_ordered FROM (
    SELECT doc_no, list_transform(list_concat(list_concat(regexp_extract_all(description, $$""" + V.ENTITY_COMPANY + """$$), regexp_extract_all(description, $$(?i)""" + V.ENTITY_AMOUNT + """$$)), regexp_extract_all(description, $$""" + V.ENTITY_PERCENT + """$$)), lambda x: trim(x)) AS all_ FROM v_filing))""")
def entities(f):
    return f.filing.select("doc_no", F.array_join(X.entities(F.col("description")), " | ").alias("entities"))


@query("""SELECT t.*, coalesce(n, 0) AS hits, coalesce(companies, 0) AS companies, coalesce(best, 0) AS best FROM (
  SELECT type AS signal_type, count(*)::BIGINT AS patterns, max(score) AS high, min(score) AS low, count(DISTINCT r_no)::BIGINT AS tiers FROM rules GROUP BY type) t
LEFT JOIN (SELECT signal_type, count(*) AS n, count(DISTINCT company_id) AS companies, count(*) FILTER (WHERE base_score = high) AS best FROM hits JOIN (SELECT type, max(score) AS high FROM rules GROUP BY type) ON type = signal_type GROUP BY signal_type) h ON h.signal_type = t.signal_type""")
def registry(f):
    return D.registry(D.filing_hits(f.filing).unionByName(D.news_hits(f.news)))


@query("SELECT type AS signal_type, score, r_no AS tier, count(*) AS patterns, (SELECT count(*) FROM hits h WHERE h.signal_type = rules.type AND h.base_score = rules.score) AS hits FROM rules WHERE type = 'credit_risk' GROUP BY ALL")
def registry_type(f):
    return D.registry_tiers(D.filing_hits(f.filing).unionByName(D.news_hits(f.news))).filter("signal_type = 'credit_risk'")


# ---- calibration and score -----------------------------------------------------------------------------------


@query("SELECT company_id, signal_type, corroboration, " + O.half_up("adjusted_score", 6) + " AS adjusted_score, severity, confidence, rate FROM cal")
def calibrate(f):
    return f.calibrated.select("company_id", "signal_type", "corroboration", r6("adjusted_score"), "severity", "confidence", "rate")


@query("SELECT company_id, signal_type, " + O.half_up("adjusted_score", 6) + " AS adjusted_score, severity, confidence, rate, " + O.half_up("precision_factor", 6) + " AS precision_factor, " + O.half_up("fp_factor", 6) + " AS fp_factor, sector_factor FROM adaptive")
def adaptive_calibrate(f):
    return S.adaptive_calibrate(f.candidates, f.company, f.stats).select("company_id", "signal_type", r6("adjusted_score"), "severity", "confidence", "rate", r6("precision_factor"), r6("fp_factor"), "sector_factor")


@query("SELECT company_id, signal_type, severity, headline, left(source_text, 200) AS evidence FROM sig")
def detected_signals(f):
    return f.found.select("company_id", "signal_type", "severity", "headline", "evidence")


@query("SELECT company_id, signal_type, alpha, liquidity, review, review_reason FROM scored")
def alpha_score(f):
    return f.scored.select("company_id", "signal_type", "alpha", "liquidity", "review", "review_reason")


@query("SELECT w.company_id, w.signal_type, w.severity, s.alpha, s.review_reason, s.review_reason IS NOT NULL AS review FROM (SELECT DISTINCT company_id, signal_type, severity FROM (SELECT company_id, signal_type, severity, row_number() OVER (PARTITION BY company_id, signal_type ORDER BY run_date DESC, run_id DESC) AS r FROM v_run_signal) WHERE r = 1) w LEFT JOIN (SELECT company_id, signal_type, alpha, review_reason FROM rescored) s USING (company_id, signal_type)")
def score_join(f):
    newest = f.v("v_run_signal").groupBy("company_id", "signal_type").agg(F.max_by("severity", F.struct("run_date", "run_id")).alias("severity"))
    return S.score_all(newest.withColumn("confidence", F.lit(0.5)), f.candidates, f.company, as_of=AS_OF).select("company_id", "signal_type", "severity", "alpha", "review_reason", "review")


@query("SELECT company_id, signal_type, severity, direction, low_pct, high_pct, comparable_n, move_confidence FROM scored")
def expected_move(f):
    return S.expected_move(f.found.select("company_id", "signal_type", "severity"))


@query("SELECT doc_no, round(greatest(pow(0.5::DOUBLE, (epoch(TIMESTAMP '2024-02-01') - epoch(published_at)) / 86400.0 / 14), 0.30::DOUBLE), 6) AS recency, round(greatest(pow(0.5::DOUBLE, (epoch(TIMESTAMP '2024-02-01') - epoch(published_date::TIMESTAMP)) / 86400.0 / 21), 0.35::DOUBLE), 6) AS temporal FROM (SELECT doc_no, date_trunc('second', published_at) AS published_at, published_date FROM v_news)")
def recency(f):
    return f.news.select("doc_no", F.round(S.decay(F.date_trunc("second", "published_at"), AS_OF, V.RECENCY_HALF_LIFE, V.RECENCY_FLOOR), 6).alias("recency"), F.round(S.decay(F.col("published_date"), AS_OF, V.TEMPORAL_HALF_LIFE, V.TEMPORAL_FLOOR), 6).alias("temporal"))


@query("SELECT company_id, " + O.LIQUIDITY + " AS liquidity FROM v_company")
def liquidity_tier(f):
    return f.company.select("company_id", S.liquidity_tier(F.col("ticker"), F.col("exchange")).alias("liquidity"))


@query("SELECT company_id, signal_type, review_reason FROM scored WHERE review")
def review_flags(f):
    return f.scored.filter("review").select("company_id", "signal_type", "review_reason")


@query("SELECT company_id, signal_type, row_number() OVER (PARTITION BY company_id ORDER BY alpha DESC NULLS LAST, signal_type) AS rank FROM scored")
def alpha_rank(f):
    return f.scored.select("company_id", "signal_type", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc_nulls_last("alpha"), "signal_type")).alias("rank"))


@query("SELECT company_id, count_if(confidence >= 0.40) AS kept, count_if(confidence < 0.40) AS suppressed FROM cal GROUP BY company_id")
def compliance_filter(f):
    return S.compliance_split(f.calibrated)


@query("SELECT company_id, signal_type, severity FROM cal WHERE signal_type IN ('credit_risk', 'insider_activity')")
def focus_filter(f):
    return f.calibrated.filter(F.col("signal_type").isin("credit_risk", "insider_activity")).select("company_id", "signal_type", "severity")


@query("SELECT company_id, rule_no, types, kind, escalation, systemic_risk, multiplier, reasoning, confidence, row_number() OVER (PARTITION BY company_id ORDER BY escalation DESC, rule_no) AS rank FROM comp JOIN (SELECT rule_no, any_value(types) AS types, any_value(reasoning) AS reasoning FROM inter GROUP BY rule_no) USING (rule_no)")
def compounds(f):
    return f.compounds.select("company_id", "rule_no", "types", "kind", "escalation", "systemic_risk", "multiplier", "reasoning", "confidence", "rank")


@query("SELECT company_id, signal_type, alpha, boost, boosted_alpha, alpha_rank, review OR boosted_alpha >= 70 AS review_after_compound FROM boosted")
def alpha_boost(f):
    return f.boosted.select("company_id", "signal_type", "alpha", "boost", "boosted_alpha", "alpha_rank", "review_after_compound")


@query("SELECT company_id, arg_min(systemic_risk, CASE systemic_risk WHEN 'systemic' THEN 0 WHEN 'contained' THEN 1 ELSE 2 END) AS systemic_risk FROM comp GROUP BY company_id")
def systemic_risk(f):
    return S.systemic_risk(f.compounds)


@query("SELECT company_id, count_if(severity = 'low') AS n_low, count_if(severity = 'medium') AS n_medium, count_if(severity = 'high') AS n_high, count_if(severity = 'critical') AS n_critical FROM cal GROUP BY company_id")
def severity_counts(f):
    return S.severity_counts(f.calibrated)


@query("SELECT * FROM (SELECT company_id, signal_type, severity, confidence, row_number() OVER (PARTITION BY company_id ORDER BY " + O.severity_rank("severity") + " DESC, confidence DESC, signal_type) AS rank FROM cal) WHERE rank <= 3")
def top_signals(f):
    return S.top_signals(f.calibrated).select("company_id", "signal_type", "severity", "confidence", "rank")


def _brief(f) -> DataFrame:
    return S.brief(f.boosted, f.compounds, f.candidates, f.filing, f.news)


@query("SELECT * FROM brief")
def brief(f):
    return _brief(f)


@query("SELECT company_id, top_alpha, overall_severity, systemic_risk, n_signals, needs_review, rank FROM (SELECT *, row_number() OVER (ORDER BY top_alpha DESC, company_id) AS rank FROM brief) WHERE rank <= 100")
def flagship(f):
    top = _brief(f).orderBy(F.desc("top_alpha"), "company_id").limit(100)  # a top-100 report; the window below sees 100 rows
    return top.select("company_id", "top_alpha", "overall_severity", "systemic_risk", "n_signals", "needs_review", F.row_number().over(Window.orderBy(F.desc("top_alpha"), "company_id")).alias("rank"))


@query("SELECT company_id, signal_type, source_reliability, corroboration_part, filing_strength, historical_precision, entity_match, temporal_relevance, extraction, final_confidence, reasoning FROM confidence")
def confidence_parts(f):
    learned = H.source_reliability(f.v("v_feedback"), FEEDBACK_ORDER)
    return S.confidence_parts(f.candidates, f.stats, learned, as_of=AS_OF)


_SPOILED = """SELECT company_id, signal_type, CASE company_id % 11 WHEN 0 THEN 'severe' ELSE severity END AS severity, CASE company_id % 13 WHEN 0 THEN 1.25::DOUBLE WHEN 1 THEN -0.5::DOUBLE WHEN 2 THEN NULL ELSE confidence END AS confidence,
  CASE company_id % 17 WHEN 0 THEN raw_score + 1 ELSE raw_score END AS raw_score, CASE company_id % 19 WHEN 0 THEN 0 ELSE corroboration END AS corroboration, CASE company_id % 23 WHEN 0 THEN 'made_up' ELSE signal_type END AS kind FROM cal"""


@query(f"""SELECT company_id, kind AS signal_type, violation FROM ({_SPOILED}), (VALUES ('confidence_range'), ('raw_score_range'), ('corroboration_least'), ('severity_domain'), ('signal_type_domain')) v(violation)
WHERE CASE violation WHEN 'confidence_range' THEN coalesce(confidence < 0 OR confidence > 1, true) WHEN 'raw_score_range' THEN raw_score < 0 OR raw_score > 1 WHEN 'corroboration_least' THEN corroboration < 1
  WHEN 'severity_domain' THEN severity NOT IN ('low', 'medium', 'high', 'critical') ELSE kind NOT IN (SELECT type FROM rules) END""")
def validate(f):
    """The calibrated signals with values spoiled in known places."""
    at = lambda n, k: F.col("company_id") % n == k
    spoiled = f.calibrated.select(
        "company_id", F.when(at(23, 0), "made_up").otherwise(F.col("signal_type")).alias("signal_type"), F.when(at(11, 0), "severe").otherwise(F.col("severity")).alias("severity"),
        F.when(at(13, 0), 1.25).when(at(13, 1), -0.5).when(at(13, 2), None).otherwise(F.col("confidence")).alias("confidence"),
        F.when(at(17, 0), F.col("raw_score") + 1).otherwise(F.col("raw_score")).alias("raw_score"), F.when(at(19, 0), 0).otherwise(F.col("corroboration")).alias("corroboration"))
    return H.validate(spoiled)


_RANGED = {
    "news": ("SELECT company_id, doc_no AS key, 'relevance_score' AS \"column\", CASE doc_no % 29 WHEN 0 THEN 1.5 ELSE relevance_score END AS value, 0 AS lo, 1 AS hi FROM v_news"),
    "alpha": ("SELECT company_id, 0, 'alpha', CASE company_id % 7 WHEN 0 THEN alpha + 100 ELSE alpha END, 0, 100 FROM scored"),
    "compounds": ("SELECT company_id, rule_no, 'multiplier', CASE company_id % 5 WHEN 0 THEN 0.25 ELSE multiplier END, 0.5, 3 FROM comp"),
    "confidence": ("SELECT company_id, 0, 'entity_match', CASE company_id % 9 WHEN 0 THEN -0.1 ELSE entity_match END, 0, 1 FROM confidence"),
    "profiles": ("SELECT company_id, 0, 'governance', CASE company_id % 3 WHEN 0 THEN governance + 200 ELSE governance END, 0, 100 FROM memory"),
}


@query("SELECT \"table\", company_id, key, \"column\", value::DOUBLE AS value FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", * FROM ({sql})" for t, sql in _RANGED.items()) + ") WHERE value < lo OR value > hi")
def validate_ranges(f):
    """Five stored tables with values spoiled in known places."""
    at = lambda n: F.col("company_id") % n == 0
    spoil = lambda rows, column, when, value: rows.withColumn(column, F.when(when, value).otherwise(F.col(column)))
    zero = F.lit(0).cast("long")
    f = f.with_stored_candidates()
    learned = H.source_reliability(f.v("v_feedback"), FEEDBACK_ORDER)
    parts = S.confidence_parts(f.candidates, f.stats, learned, as_of=AS_OF).withColumn("calibration_adjustment", F.lit(1.0))
    spoiled = {
        "news": spoil(f.news.withColumn("key", F.col("doc_no")), "relevance_score", F.col("doc_no") % 29 == 0, F.lit(1.5)),
        "alpha": spoil(f.scored.withColumn("key", zero), "alpha", at(7), F.col("alpha") + 100),
        "compounds": spoil(f.compounds.withColumn("key", F.col("rule_no").cast("long")), "multiplier", at(5), F.lit(0.25)),
        "confidence": spoil(parts.withColumn("key", zero), "entity_match", at(9), F.lit(-0.1)),
        "profiles": spoil(f.memory.withColumn("key", zero), "governance", at(3), F.col("governance") + 200),
    }
    out = None
    for table, rows in spoiled.items():
        found = H.out_of_range(rows, table, "company_id", "key")
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT company_id, top_alpha, liquidity, overall_severity, needs_review, review_reasons, n_signals, systemic_risk, total_sources FROM brief")
def brief_json(f):
    """What is read back from the briefs written as JSON."""
    text = _brief(f).select("company_id", F.to_json(F.struct("*")).alias("json"))
    read = "top_alpha double, liquidity string, overall_severity string, needs_review boolean, review_reasons string, n_signals bigint, systemic_risk string, total_sources bigint"
    return text.select("company_id", F.from_json("json", read).alias("b")).select("company_id", "b.*")


# ---- feedback and outcomes -----------------------------------------------------------------------------------


@query("SELECT * FROM stats")
def feedback_stats(f):
    return f.stats


@query("SELECT signal_type, fp_rate FROM stats")
def fp_rate(f):
    return f.stats.select("signal_type", "fp_rate")


@query("SELECT source_name, votes, reliability FROM learned")
def source_reliability(f):
    return H.source_reliability(f.v("v_feedback"), FEEDBACK_ORDER)


@query("SELECT types.type AS signal_type, coalesce(total, 0) AS total, precision, coalesce(fp_rate, 0) AS fp_rate, CASE WHEN coalesce(total, 0) < 10 THEN 1.0 ELSE greatest(0.7, least(1.3, 0.5 + precision)) END AS precision_factor, greatest(0.60, 1.0 - coalesce(fp_rate, 0) * 0.5) AS fp_factor, " + O.half_up("CASE WHEN coalesce(total, 0) < 10 THEN 1.0 ELSE greatest(0.7, least(1.3, 0.5 + precision)) END * greatest(0.60, 1.0 - coalesce(fp_rate, 0) * 0.5)", 3) + " AS net_factor, CASE WHEN coalesce(total, 0) = 0 THEN 'insufficient data' END AS note, coalesce(total, 0) >= 10 AS adaptive FROM (SELECT DISTINCT type FROM rules) types LEFT JOIN stats ON stats.signal_type = types.type")
def calibration_report(f):
    return H.calibration_report(f.v("v_feedback"))


@query("SELECT k1, k2, k3, feedback_type FROM v_feedback ORDER BY k1 DESC, k2 DESC, k3 DESC, k4 DESC, k5 DESC LIMIT 50")
def recent_feedback(f):
    return f.v("v_feedback").orderBy(*[F.desc(k) for k in FEEDBACK_ORDER]).limit(50).select("k1", "k2", "k3", "feedback_type")


@query("SELECT k1, k2, k3, signal_type, direction_correct, magnitude_error FROM outcome")
def outcome_record(f):
    return f.outcome.select("k1", "k2", "k3", "signal_type", "direction_correct", "magnitude_error")


_ACC = "count(*) AS total, round(count_if(event_confirmed) / count(*), 3) AS confirmation_rate, round(count_if(direction_correct) / greatest(count(direction_correct), 1), 3) AS direction_accuracy, round(avg(magnitude_error), 2) AS avg_magnitude_error"


@query(f"SELECT {_ACC} FROM outcome")
def outcome_accuracy(f):
    return H.outcome_accuracy(f.outcome)


_BY_TYPE = f"SELECT * REPLACE (coalesce(avg_magnitude_error, 0) AS avg_magnitude_error) FROM (SELECT signal_type, {_ACC} FROM outcome GROUP BY signal_type)"


@query(_BY_TYPE)
def outcome_by_type(f):
    return H.outcome_accuracy(f.outcome, by_type=True)


@query(f"SELECT 'type' AS scope, * FROM ({_BY_TYPE}) UNION ALL SELECT 'all', NULL, {_ACC} FROM outcome")
def outcome_report(f):
    """Accuracy overall and by type from one scan of the outcomes."""
    return H.outcome_report(f.outcome)


@query("SELECT count(*) AS total, round(count_if(event_confirmed) / count(*), 3) AS confirmation_rate, round(count_if(direction_correct) / count(*), 3) AS direction_accuracy, round(avg(abs(coalesce(magnitude_error, 0))), 2) AS avg_magnitude_error FROM outcome")
def outcome_accuracy_wh(f):
    return H.outcome_accuracy_all_rows(f.outcome)


@query("SELECT signal_type, count(*) AS samples, round(count_if(event_confirmed) / count(*), 3) AS confirmation_rate, round(count_if(direction_correct) / greatest(count(direction_correct), 1), 3) AS direction_accuracy, round(avg(abs(coalesce(p5, 0))), 2) AS move_5d, round(avg(abs(coalesce(p10, 0))), 2) AS move_10d, round(avg(abs(coalesce(p30, 0))), 2) AS move_30d FROM outcome GROUP BY signal_type")
def signal_accuracy(f):
    return H.signal_accuracy(f.outcome)


# ---- profiles and runs ---------------------------------------------------------------------------------------


@query("SELECT * FROM memory")
def company_memory(f):
    return f.memory


@query("SELECT company_id, risk_delta, trend FROM memory")
def risk_trend(f):
    return f.memory.select("company_id", "risk_delta", "trend")


@query("SELECT company_id, rolling FROM memory WHERE rolling >= 60")
def risk_watch(f):
    return f.memory.filter("rolling >= 60").select("company_id", "rolling")


@query("SELECT company_id, rolling FROM memory ORDER BY rolling DESC, company_id LIMIT 50")
def risk_ranking(f):
    return f.memory.select("company_id", "rolling").orderBy(F.desc("rolling"), "company_id").limit(50)


@query("SELECT request_no, key, company_id, rolling FROM (SELECT o_orderkey AS request_no, CASE WHEN o_custkey % 2 = 0 THEN 'T' || o_custkey ELSE 'CUSTOMER#' || lpad(o_custkey::STRING, 9, '0') END AS key FROM orders) JOIN (SELECT replace(trim(upper(coalesce(nullif(ticker, ''), company_name))), ' ', '_') AS key, min(company_id) AS company_id FROM v_company GROUP BY ALL) USING (key) JOIN memory USING (company_id)")
def profile_lookup(f):
    """Profiles by key for the requests that the orders make: by ticker or by name."""
    wanted = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("t"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))
    requests = f.v("orders").select(F.col("o_orderkey").alias("request_no"), H.company_key(wanted, wanted).alias("key"))
    keys = f.company.groupBy(H.company_key(F.col("ticker"), F.col("company_name")).alias("key")).agg(F.min("company_id").alias("company_id"))
    return requests.join(keys, "key").join(f.memory, "company_id").select("request_no", "key", "company_id", "rolling")


@query("SELECT company_id, signal_type, count(*) AS n FROM v_run_signal GROUP BY ALL")
def signal_density(f):
    return H.signal_density(f.v("v_run_signal"))


@query("SELECT company_id, count(*) AS total, count_if(signal_type = 'leadership_change') AS leadership_changes, count_if(signal_type = 'debt_restructuring') AS debt_restructures, count_if(signal_type = 'regulatory_action') AS regulatory_actions FROM v_run_signal GROUP BY company_id")
def signal_totals(f):
    return H.signal_totals(f.v("v_run_signal"))


@query("SELECT company_id, string_agg(signal_type, ',' ORDER BY signal_type) AS patterns FROM (SELECT company_id, signal_type, count(*) AS n FROM v_run_signal GROUP BY ALL) WHERE n >= 3 GROUP BY company_id")
def repeated_patterns(f):
    return H.repeated_patterns(f.v("v_run_signal"))


@query("SELECT company_id, count(*)::INT AS n, string_agg(top_alpha::INT::STRING, ',' ORDER BY run_date, run_id) AS alphas FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY run_date DESC, run_id DESC) AS back FROM v_run WHERE top_alpha IS NOT NULL) WHERE back <= 20 GROUP BY company_id")
def alpha_history(f):
    return H.alpha_history(f.v("v_run"))


@query("SELECT * FROM (SELECT company_id, run_id, run_date, top_alpha, top_alpha - lag(top_alpha) OVER w AS delta, row_number() OVER w AS rank FROM v_run WINDOW w AS (PARTITION BY company_id ORDER BY run_date, run_id)) WHERE rank <= 100")
def scoring_trend(f):
    return H.scoring_trend(f.v("v_run"))


@query("SELECT * FROM (SELECT company_id, run_id, severity, row_number() OVER (PARTITION BY company_id ORDER BY run_date DESC, run_id DESC) AS rank FROM v_run JOIN v_company USING (company_id) WHERE company_name ILIKE '%#0000001%') WHERE rank <= 20")
def company_history(f):
    chosen = f.company.filter(F.col("company_name").ilike("%#0000001%")).select("company_id")
    return H.newest(f.v("v_run").join(chosen, "company_id"), 20, "run_date", "run_id").select("company_id", "run_id", "severity", "rank")


@query("SELECT * FROM (SELECT company_id, run_id, signal_type, row_number() OVER (PARTITION BY company_id ORDER BY run_date DESC, run_id DESC, signal_type DESC) AS rank FROM v_run_signal) WHERE rank <= 50")
def signal_history(f):
    return H.newest(f.v("v_run_signal"), 50, "run_date", "run_id", "signal_type").select("company_id", "run_id", "signal_type", "rank")


@query("""SELECT r.run_id, coalesce(s.n_signals, 0) AS n_signals, s.worst_name, coalesce(fl.n, 0) AS n_filings, coalesce(nw.n, 0) AS n_news FROM v_run r
LEFT JOIN (SELECT run_id, count(signal_type) AS n_signals, max(severity) AS worst_name FROM v_run_signal GROUP BY run_id) s ON s.run_id = r.run_id
LEFT JOIN (SELECT run_id, count(*) AS n FROM v_run JOIN v_filing USING (company_id) WHERE filing_date BETWEEN run_date - 30 AND run_date GROUP BY run_id) fl ON fl.run_id = r.run_id
LEFT JOIN (SELECT run_id, count(*) AS n FROM v_run JOIN v_news USING (company_id) WHERE published_date BETWEEN run_date - 30 AND run_date GROUP BY run_id) nw ON nw.run_id = r.run_id""")
def run_contents(f):
    return H.run_contents(f.v("v_run"), f.v("v_run_signal"), f.filing, f.news)


@query("SELECT origin, company_id, count(*) AS n, max(day) AS last FROM (SELECT 'filing' AS origin, company_id, filing_date AS day FROM v_filing UNION ALL SELECT 'news', company_id, published_date FROM v_news) WHERE day <= DATE '2024-01-15' GROUP BY origin, company_id")
def replay_inputs(f):
    rows = H.replay_inputs(f.filing, f.news, as_of=REPLAY_AT)
    return rows.groupBy("origin", "company_id").agg(F.count("*").alias("n"), F.max("day").alias("last"))


@query("SELECT company_id, signal_type, severity, alpha FROM replayed")
def replay(f):
    return H.replay(f.filing, f.news, f.company, as_of=REPLAY_AT).select("company_id", "signal_type", "severity", "alpha")


@query("SELECT company_id, 'run-1' AS original_run_id, DATE '2024-01-15' AS replay_date, 'rules-1' AS ruleset_version, 'alpha-1' AS scoring_version, 70 AS review_alpha, count(*) AS n_signals, max(alpha) AS top_alpha FROM replayed GROUP BY company_id")
def replay_runs(f):
    rows = H.replay_rows(H.replay(f.filing, f.news, f.company, as_of=REPLAY_AT), "run-1", as_of=REPLAY_AT)
    return rows.withColumn("review_alpha", F.get_json_object("config_snapshot", "$.review_alpha").cast("double").cast("int")).drop("config_snapshot")


@query("SELECT * FROM (SELECT coalesce(a.company_id, b.company_id) AS company_id, coalesce(a.signal_type, b.signal_type) AS signal_type, CASE WHEN b.severity IS NULL THEN 'removed' WHEN a.severity IS NULL THEN 'added' WHEN a.severity <> b.severity OR abs(b.alpha - a.alpha) > 5 THEN 'modified' END AS change, round(coalesce(b.alpha, 0) - coalesce(a.alpha, 0), 1) AS alpha_delta FROM scored a FULL JOIN replayed b ON a.company_id = b.company_id AND a.signal_type = b.signal_type) WHERE change IS NOT NULL")
def run_diff(f):
    """Two days of one detection."""
    days = {"now": (AS_OF, None), "then": (REPLAY_AT, REPLAY_AT)}
    return H.horizon_diff(H.scored_as_of(f.filing, f.news, f.company, days, listed=["now"]), "now", "then").select("company_id", "signal_type", "change", "alpha_delta")


@query(O.AS_OF_DAYS)
def as_of_days(f):
    """What was known on three days, from one search of the texts: candidates and their best score by type."""
    days = {str(d): (dt.datetime.combine(d, dt.time()), dt.datetime.combine(d, dt.time())) for d in O.DAYS}
    rows = H.scored_as_of(f.filing, f.news, f.company, days)
    return rows.groupBy("horizon", "signal_type").agg(F.count("*").alias("n"), F.max("alpha").alias("top_alpha"), F.count_if("review").alias("reviews"))


# ---- audit, alerts, tables -----------------------------------------------------------------------------------


@query(O.AUDIT_SQL)
def audit_build(f):
    return f.chain.select("chain", F.col("seq").cast("long").alias("seq"), "prev_hash", "data_hash")


@query("""WITH c AS (SELECT chain, seq, chain % 7 = 0 AND seq = 2 AS changed, chain % 5 = 0 AND seq = 3 AS broken, chain % 5 = 0 AND seq = 3 AS broken_hash FROM v_audit)
SELECT chain, count(*) AS entries, NOT bool_or(broken) AS links_hold, min(CASE WHEN broken THEN seq END)::INT AS first_break, min(CASE WHEN changed OR broken_hash THEN seq END)::INT AS first_change FROM c GROUP BY chain""")
def audit_verify(f):
    """Chains whose second payload (each seventh chain) or third link (each fifth) was tampered with."""
    payload = F.when((F.col("chain") % 7 == 0) & (F.col("seq") == 2), F.lit("changed")).otherwise(F.col("payload"))
    link = F.when((F.col("chain") % 5 == 0) & (F.col("seq") == 3), F.lit("forged")).otherwise(F.col("prev_hash"))
    return H.audit_verify(f.chain.withColumns({"payload": payload, "prev_hash": link}))


@query("SELECT * FROM (" + O.AUDIT_SQL + ") WHERE seq > 3")
def audit_append(f):
    """Entries of a third batch: each goes on from the heads that the two batches before it left in the stored table."""
    folder, whole = store.shared_folder(f.spark, "audit"), f.v("v_audit")
    for run, own in (("run-1", "seq <= 2"), ("run-2", "seq = 3"), ("run-3", "seq > 3")):
        heads = None if run == "run-1" else H.audit_heads(store.read_table(f.spark, folder, "audit"))
        store.save_state("audit", H.audit_build(whole.filter(own), heads), folder, run)
    return store.read_table(f.spark, folder, "audit", "run-3").select("chain", F.col("seq").cast("long").alias("seq"), "prev_hash", "data_hash")


@query("SELECT chain, seq, payload FROM v_audit ORDER BY seq DESC, chain DESC LIMIT 100")
def recent_audit(f):
    return f.chain.orderBy(F.desc("seq"), F.desc("chain")).limit(100).select("chain", F.col("seq").cast("long").alias("seq"), "payload")


_ALERT = O.ALERT


@query(_ALERT)
def alerts(f):
    return H.alerts(f.v("v_run"), f.v("v_watch")).select("company_id", "run_id", "run_date", "by_severity", "by_alpha")


@query(f"SELECT * FROM ({_ALERT}) ORDER BY run_date DESC, run_id DESC LIMIT 500")
def recent_alerts(f):
    return H.alerts(f.v("v_run"), f.v("v_watch")).select("company_id", "run_id", "run_date", "by_severity", "by_alpha").orderBy(F.desc("run_date"), F.desc("run_id")).limit(500)


@query("SELECT company_id, CASE WHEN company_id % 8 = 0 THEN 'low' ELSE alert_severity END AS alert_severity, CASE WHEN company_id % 8 = 0 THEN 10 ELSE alert_alpha END AS alert_alpha FROM v_watch WHERE company_id % 12 <> 0 UNION ALL SELECT company_id, 'low', 10 FROM v_company WHERE company_id % 8 = 2")
def watchlist_upsert(f):
    watch = f.v("v_watch")
    new = f.company.filter("company_id % 8 in (0, 2)").select("company_id", F.lit("low").alias("alert_severity"), F.lit(10.0).alias("alert_alpha"))
    return H.upsert(watch, new, ["company_id"], watch.filter("company_id % 12 = 0"))


def _store_run(f, folder: str, run_id: str) -> None:
    """All tables of a run. What is made from candidates, signals and compounds is made from the stored ones, so the texts are searched once, and once more as of the replay."""

    def stored(name: str, rows: DataFrame) -> DataFrame:
        store.store_run({name: rows}, folder, run_id)
        return store.read_table(f.spark, folder, name, run_id).drop("run_id")

    run = Frames(f.spark, f.dir)
    run.filing, run.news = stored("filings", f.filing), stored("news_items", f.news)
    run.candidates = stored("signal_candidates", run.candidates)
    run.scored, run.compounds = stored("detected_signals", run.scored), stored("compound_events", run.compounds)
    replayed = H.replay(run.filing, run.news, run.company, as_of=REPLAY_AT)
    store.store_run({
        "analyst_briefs": _brief(run), "market_outcomes": f.outcome, "replay_runs": H.replay_rows(replayed, "run-1", as_of=REPLAY_AT),
        "scoring_history": run.scored.select("company_id", "signal_type", "alpha", "severity", "confidence"),
    }, folder, run_id)


@query("""SELECT 'filings' AS "table", count(*) AS rows, count(DISTINCT company_id) AS companies FROM v_filing UNION ALL SELECT 'news_items', count(*), count(DISTINCT company_id) FROM v_news UNION ALL SELECT 'signal_candidates', count(*), count(DISTINCT company_id) FROM cand
UNION ALL SELECT 'detected_signals', count(*), count(DISTINCT company_id) FROM scored UNION ALL SELECT 'compound_events', count(*), count(DISTINCT company_id) FROM comp UNION ALL SELECT 'analyst_briefs', count(*), count(DISTINCT company_id) FROM brief
UNION ALL SELECT 'market_outcomes', count(*), count(DISTINCT signal_type) FROM outcome UNION ALL SELECT 'replay_runs', count(DISTINCT company_id), count(DISTINCT company_id) FROM replayed UNION ALL SELECT 'scoring_history', count(*), count(DISTINCT company_id) FROM scored""")
def warehouse_write(f):
    """All tables of a run, stored twice under one run id and beside an older run; counted as read back."""
    folder, out = store.shared_folder(f.spark, "warehouse"), None
    store.store_run({"filings": f.filing, "news_items": f.news}, folder, "run-0")
    _store_run(f, folder, "run-1")
    store.store_run({name: store.read_table(f.spark, folder, name, "run-1") for name in store.RUN_TABLES}, folder, "run-1")
    for name in store.RUN_TABLES:
        key = "signal_type" if name == "market_outcomes" else "company_id"
        count = store.read_table(f.spark, folder, name, "run-1").groupBy().agg(F.count("*").alias("rows"), F.count_distinct(key).alias("companies")).select(F.lit(name).alias("table"), "rows", "companies")
        out = count if out is None else out.unionByName(count)
    return out


@query("""SELECT 'feedback' AS "table", count(*) AS rows FROM v_feedback UNION ALL SELECT 'outcomes', count(*) FROM outcome UNION ALL SELECT 'profiles', count(*) FROM memory UNION ALL SELECT 'graph_nodes', count(*) FROM v_node
UNION ALL SELECT 'graph_edges', count(*) FROM edges UNION ALL SELECT 'watchlist', count(*) FROM v_watch UNION ALL SELECT 'alerts', count(*) FROM (""" + O.ALERT + """) UNION ALL SELECT 'audit', count(*) FROM v_audit""")
def state_tables(f):
    """The state that lives on between runs, appended in two halves, the second one twice, and counted as read back."""
    folder, out = store.shared_folder(f.spark, "state"), None
    rows = {
        "feedback": f.v("v_feedback"), "outcomes": f.outcome, "profiles": f.memory, "graph_nodes": f.nodes, "graph_edges": f.edges, "watchlist": f.v("v_watch"),
        "alerts": H.alerts(f.v("v_run"), f.v("v_watch")), "audit": f.chain,
    }
    for name, df in rows.items():
        df = store.cut(df)
        half = F.pmod(F.xxhash64(*df.columns), F.lit(2))
        for run, part in (("run-1", 0), ("run-2", 1), ("run-2", 1)):
            store.save_state(name, df.filter(half == part), folder, run)
        count = store.read_table(f.spark, folder, name).groupBy().agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = count if out is None else out.unionByName(count)
    return out


@query("SELECT signal_type, count(*) AS total, round(count_if(feedback_type = 'confirmed') / greatest(count_if(feedback_type = 'confirmed') + count_if(feedback_type = 'false_positive'), 1), 3) AS precision FROM (SELECT signal_type, feedback_type FROM v_feedback UNION ALL SELECT signal_type, CASE WHEN severity IN ('high', 'critical') THEN 'confirmed' ELSE 'false_positive' END FROM cal) GROUP BY signal_type")
def feedback_submit(f):
    """Statistics after reviewers' verdicts on the detected signals were appended to the stored feedback."""
    folder = store.shared_folder(f.spark, "feedback")
    verdict = F.when(F.col("severity").isin("high", "critical"), "confirmed").otherwise("false_positive")
    store.save_state("feedback", f.v("v_feedback").select("signal_type", "feedback_type"), folder, "run-0")
    for _ in range(2):
        store.save_state("feedback", f.calibrated.select("signal_type", verdict.alias("feedback_type")), folder, "run-1")
    return H.feedback_stats(store.read_table(f.spark, folder, "feedback")).select("signal_type", "total", "precision")


# ---- graph ---------------------------------------------------------------------------------------------------


@query("SELECT a, b, edge_type, detail FROM edges")
def graph_edges(f):
    return f.edges.select("a", "b", "edge_type", "detail")


@query("SELECT coalesce(n.node_id, 'c' || b.company_id) AS node_id, CASE WHEN b.company_id IS NOT NULL THEN 'company' ELSE node_type END AS node_type, overall_severity AS last_severity, CASE WHEN b.company_id IS NOT NULL THEN coalesce(top_alpha, 0) END AS last_alpha FROM v_node n FULL JOIN brief b ON n.node_id = 'c' || b.company_id")
def graph_nodes(f):
    return G.nodes_from_briefs(f.nodes, _brief(f))


@query(O.NEAR_CLASSES)
def connected_companies(f):
    """Pairs within two hops, and for hubs the sources that hold them and their members once."""
    pairs, holds, members = G.near_companies(f.nodes, f.edges, f.distressed)
    null = F.lit(None)
    return pairs.select(F.lit("pair").alias("what"), "company", "other", F.col("hops").cast("int").alias("hops")).unionByName(
        holds.select(F.lit("holds").alias("what"), "company", F.col("hub").alias("other"), null.cast("int").alias("hops"))).unionByName(
        members.select(F.lit("member").alias("what"), F.col("member").alias("company"), F.col("hub").alias("other"), null.cast("int").alias("hops")))


@query("SELECT x.company AS company_a, y.company AS company_b, count(*) AS n, string_agg(x.executive, ',' ORDER BY x.executive) AS executives FROM execs x JOIN execs y ON x.executive = y.executive AND x.company < y.company GROUP BY ALL")
def shared_execs(f):
    return G.shared_executives(f.nodes, f.edges)


@query("""WITH n AS (SELECT executive FROM execs GROUP BY executive HAVING count(*) >= 3), few AS (SELECT * FROM execs WHERE executive NOT IN (SELECT executive FROM n))
SELECT 'pair' AS what, x.company AS company_a, y.company AS company_b, string_agg(x.executive, ',' ORDER BY x.executive) AS executives FROM few x JOIN few y ON x.executive = y.executive AND x.company < y.company GROUP BY ALL
UNION ALL SELECT 'member', company, NULL, executive FROM execs WHERE executive IN (SELECT executive FROM n)""")
def shared_exec_classes(f):
    """Pairs by executives of two companies; those of three and more as classes."""
    pairs, members = G.shared_executive_classes(f.nodes, f.edges, busy=3)
    return pairs.select(F.lit("pair").alias("what"), "company_a", "company_b", "executives").unionByName(
        members.select(F.lit("member").alias("what"), F.col("company").alias("company_a"), F.lit(None).cast("string").alias("company_b"), F.col("executive").alias("executives")))


@query("SELECT node AS lender, other AS company, coalesce(detail, 'unknown') AS facility FROM both_ways WHERE edge_type = 'lends_to' AND node IN (SELECT node_id FROM v_node WHERE node_type = 'lender')")
def lender_exposure(f):
    return G.lender_exposure(f.nodes, f.edges)


@query("SELECT node AS company, other, detail AS status FROM both_ways WHERE edge_type = 'acquired'")
def acquisitions(f):
    return G.acquisitions(f.edges)


@query(O.CONTAGION)
def contagion(f):
    return G.contagion(f.nodes, f.edges, f.distressed)


@query(O.CONTAGION_THIRD)
def contagion_third(f):
    """Companies within three hops of distressed ones, hubs as classes."""
    return G.reach(f.nodes, f.edges, f.distressed, depth=3)


@query(O.ACQUISITION_CHAINS)
def acquisition_chains(f):
    return G.acquisition_chains(f.edges)


@query("SELECT 'edge' AS what, edge_type AS type, count(*) AS n FROM edges GROUP BY edge_type UNION ALL SELECT 'node', coalesce(node_type, 'unknown'), count(*) FROM (SELECT a AS e FROM edges UNION SELECT b FROM edges) FULL JOIN v_node ON e = node_id GROUP BY ALL")
def graph_summary(f):
    return G.summary(f.nodes, f.edges)


@query("""WITH RECURSIVE reached(node) AS (SELECT min(node) FROM both_ways UNION SELECT b.other FROM reached r JOIN both_ways b ON b.node = r.node),
every AS (SELECT node_id AS node FROM v_node UNION SELECT node FROM both_ways), rest AS (SELECT node FROM every WHERE node NOT IN (SELECT node FROM reached)),
linked(root, node) AS (SELECT node, node FROM rest UNION SELECT l.root, b.other FROM linked l JOIN both_ways b ON b.node = l.node)
SELECT (SELECT count(*) FROM every) AS nodes, 1 + (SELECT count(DISTINCT least_node) FROM (SELECT root, min(node) AS least_node FROM linked GROUP BY root)) AS components, (SELECT count(*) FROM rest) = 0 AS is_connected""")
def graph_connected(f):
    return G.connected(f.nodes, f.edges)


# ---- ingestion -----------------------------------------------------------------------------------------------


@query("SELECT * FROM (SELECT company_id, accession_number, form_type, filing_date, row_number() OVER (PARTITION BY company_id ORDER BY filing_date, accession_number) AS rank FROM v_filing WHERE form_type IN ('8-K', '10-K', 'SC 13D') AND filing_date >= DATE '2001-08-01' - 1000) WHERE rank <= 20")
def filing_scan(f):
    rows = F.array_sort(F.collect_list(F.struct("filing_date", "accession_number", "form_type")))
    arrays = f.filing.groupBy("company_id").agg(rows.alias("r")).select("company_id", *[F.col(f"r.{c}").alias(c) for c in ("accession_number", "form_type", "filing_date")])
    return I.scan_submissions(arrays, FORMS, as_of=dt.datetime(2001, 8, 1), lookback=1000).select("company_id", "accession_number", "form_type", "filing_date", "rank")


@query("SELECT * FROM (SELECT company_id, phrase, accession_number, row_number() OVER (PARTITION BY company_id, phrase ORDER BY filing_date DESC, accession_number) AS rank FROM v_filing JOIN (VALUES ('merger talks'), ('going concern'), ('profit warning')) p(phrase) ON contains(lower(description), phrase) WHERE form_type IN ('8-K', '10-K', 'SC 13D') AND filing_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31') WHERE rank <= 3")
def phrase_search(f):
    return I.phrase_search(f.filing, ("merger talks", "going concern", "profit warning"), FORMS, dt.date(1996, 1, 1), dt.date(2000, 12, 31)).select("company_id", "phrase", "accession_number", "rank")


#: Phrases out of the filings' own words, and names that none of them holds.
_PHRASES = """SELECT DISTINCT concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS phrase FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT string_split(description, ' ') AS w FROM v_filing))
UNION SELECT DISTINCT substr(description, 3, 6) FROM v_filing UNION SELECT p_name FROM part"""


@query(f"SELECT * FROM (SELECT company_id, phrase, accession_number, row_number() OVER (PARTITION BY company_id, phrase ORDER BY filing_date DESC, accession_number) AS rank FROM v_filing JOIN ({_PHRASES}) p ON contains(lower(description), lower(phrase)) AND trim(phrase) <> '' WHERE form_type IN ('8-K', '10-K', 'SC 13D') AND filing_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31') WHERE rank <= 3")
def phrase_table(f):
    """Phrases from a table: three-word windows of the filings, pieces of words, and the names of all parts."""
    w = F.split("description", " ")
    windows = f.filing.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).alias("phrase"))
    phrases = windows.unionByName(f.filing.select(F.substring("description", 3, 6).alias("phrase"))).unionByName(f.v("part").select(F.col("p_name").alias("phrase"))).distinct()
    return I.phrase_filings(f.filing, phrases, FORMS, dt.date(1996, 1, 1), dt.date(2000, 12, 31)).select("company_id", "phrase", "accession_number", "rank")


@query("SELECT title, url AS link, strftime(published_at, '%a, %d %b %Y %H:%M:%S GMT') AS \"pubDate\", snippet FROM v_news")
def feed_items(f):
    item = F.struct(F.struct("title", F.col("url").alias("link"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("pubDate"), F.concat(F.lit("<p>"), "snippet", F.lit("</p>")).alias("description")).alias("item"))
    text = f.news.select(F.to_xml(item).alias("xml"))
    rows = text.select(F.from_xml("xml", "item struct<title:string,link:string,pubDate:string,description:string>").alias("r")).select("r.item.*")
    return I.feed_items(rows)


@query("SELECT doc_no, published_date AS day FROM v_news")
def feed_dates(f):
    text = F.when(F.col("doc_no") % 3 == 0, F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(F.col("doc_no") % 3 == 1, F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss Z")).otherwise(F.date_format("published_at", "yyyy-MM-dd"))
    return f.news.select("doc_no", text.alias("t")).select("doc_no", I.feed_date(F.col("t"), AS_OF).alias("day"))


_FEEDS = ("ngx_announcement", "ngx_disclosure", "jse_sens", "jse_news", "nse_kenya")
_ITEMS = "SELECT company_id, feed, row_number() OVER (PARTITION BY company_id, feed ORDER BY published_date DESC, doc_no) AS pos, CASE doc_no % 11 WHEN 0 THEN '' ELSE title || ' ' || doc_no % 7 END AS title, snippet, url, published_date FROM (SELECT *, CASE WHEN doc_no % 5 = 2 AND company_id % 3 = 0 THEN 'other' ELSE CASE doc_no % 5 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_FEEDS)) + " END END AS feed FROM v_news)"


def _items(f) -> DataFrame:
    """Items of five feeds in their order; each third company has none in one of them, and some items have no title."""
    feed = F.element_at(F.array(*map(F.lit, _FEEDS)), (F.col("doc_no") % 5 + 1).cast("int"))
    rows = f.news.withColumn("feed", F.when((F.col("doc_no") % 5 == 2) & (F.col("company_id") % 3 == 0), "other").otherwise(feed))
    title = F.when(F.col("doc_no") % 11 == 0, "").otherwise(F.concat("title", F.lit(" "), (F.col("doc_no") % 7).cast("string")))
    pos = F.row_number().over(Window.partitionBy("company_id", "feed").orderBy(F.desc("published_date"), "doc_no"))
    return rows.select("company_id", "feed", pos.alias("pos"), title.alias("title"), F.col("snippet").alias("text"), F.col("url").alias("link"), F.col("published_date").alias("day"))


@query(f"""WITH items AS ({_ITEMS}), own AS (SELECT * FROM items WHERE title <> '' AND pos <= CASE feed WHEN 'ngx_announcement' THEN 3 WHEN 'ngx_disclosure' THEN 3 WHEN 'jse_sens' THEN 8 WHEN 'other' THEN 0 ELSE 4 END)
SELECT company_id, CASE feed WHEN 'jse_sens' THEN 'SENS' WHEN 'jse_news' THEN 'JSE' WHEN 'nse_kenya' THEN 'NSE' ELSE 'NGX' END || '-' || left(md5(title), 12) AS accession_number,
  CASE feed WHEN 'jse_sens' THEN 'JSE SENS' WHEN 'jse_news' THEN 'JSE Announcement' WHEN 'nse_kenya' THEN 'NSE Kenya Disclosure' ELSE 'NGX Announcement' END AS form_type, CASE feed WHEN 'jse_sens' THEN 'JSE' WHEN 'jse_news' THEN 'JSE' WHEN 'nse_kenya' THEN 'NSE-KE' ELSE 'NGX' END AS cik,
  published_date AS filing_date, title AS description, left(snippet, 300) AS raw_excerpt FROM own WHERE feed <> 'jse_news' OR company_id NOT IN (SELECT company_id FROM own WHERE feed = 'jse_sens')""")
def exchange_filings(f):
    return I.exchange_filings(_items(f)).select("company_id", "accession_number", "form_type", "cik", "filing_date", "description", "raw_excerpt")


@query("SELECT company_id, doc_no, 'primary' AS origin FROM v_news WHERE source = 'Moneyweb' UNION ALL SELECT company_id, doc_no, 'fallback' FROM v_news WHERE source = 'Stears' AND company_id NOT IN (SELECT company_id FROM v_news WHERE source = 'Moneyweb')")
def exchange_fallback(f):
    of = lambda source, origin: f.news.filter(F.col("source") == source).select("company_id", "doc_no", F.lit(origin).alias("origin"))
    return I.fallback(of("Moneyweb", "primary"), of("Stears", "fallback"))


@query(r"""SELECT * FROM (SELECT page_id, title, link, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM (
  SELECT page_id, pos, trim(regexp_replace(inner_, '<[^>]+>', ' ', 'g')) AS title, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href WHEN starts_with(href, 'http') THEN href END AS link FROM (
    SELECT page_id, url, unnest(range(len(h))) AS pos, trim(unnest(h)) AS href, unnest(t) AS inner_ FROM (
      SELECT page_id, url, regexp_extract_all(html, '(?is)<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2) AS t FROM pages)))
  WHERE length(title) BETWEEN 3 AND 300 AND regexp_matches(title, '\p{L}') AND link IS NOT NULL) WHERE rank <= 8""")
def link_extract(f):
    return I.link_extract(f.v("pages"), min_len=3).select("page_id", "title", "link", "rank")


#: Listing pages of companies: a link for each of their news items, and a short one.
_NAMED = "CASE company_id % 4 WHEN 0 THEN 'Delta Holdings plc' WHEN 1 THEN 'Target Corp' WHEN 2 THEN 'Nowhere Ltd' ELSE company_name END"


def _listings(f) -> DataFrame:
    link = F.concat(F.lit("<li><a class='x' href='"), F.when(F.col("doc_no") % 5 == 0, F.lit("#top")).otherwise(F.concat(F.lit("/n/"), F.col("doc_no").cast("string"))), F.lit("'>"), "title", F.lit(" <b>today</b></a></li>"))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_no", link.alias("link")))), lambda x: x["link"]), "")
    pages = f.news.groupBy("company_id").agg(html.alias("html")).join(f.company, "company_id")
    return pages.select(F.col("company_id").alias("page_id"), F.lit("https://listing.example/all").alias("url"), F.expr(_NAMED).alias("company"), F.concat(F.lit("<a href='/nav'>Home page</a>"), "html").alias("html"))


_SIGNAL_WORDS = " OR ".join(f"contains(lower(title), {O.text(w)})" for ws in V.REGIONAL_KEYWORDS.values() for w in ws)


@query(f"""WITH pages_of AS (SELECT company_id AS page_id, lower({_NAMED}) AS company FROM v_company), t AS (SELECT company_id AS page_id, doc_no, trim(title || '  today ') AS title, 'https://listing.example/n/' || doc_no AS link FROM v_news WHERE doc_no % 5 <> 0)
SELECT * FROM (SELECT page_id, title, link, row_number() OVER (PARTITION BY page_id ORDER BY doc_no) AS rank FROM t JOIN pages_of USING (page_id)
  WHERE length(title) BETWEEN 15 AND 300 AND (contains(lower(title), company) OR len(list_filter(string_split(company, ' '), lambda p: length(p) > 3 AND contains(lower(title), p))) > 0 OR {_SIGNAL_WORDS})) WHERE rank <= 8""")
def link_extract_company(f):
    """Links of listing pages whose text names the company, or a part of its name, or holds a keyword."""
    words = [w for ws in V.REGIONAL_KEYWORDS.values() for w in ws]
    return I.link_extract(_listings(f), keywords=words, company="company").select("page_id", "title", "link", "rank")


@query(r"SELECT page_id, left(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 4000) AS text FROM pages")
def html_text(f):
    return f.v("pages").select("page_id", I.html_text(F.col("html")).alias("text"))


@query("SELECT request_no, coalesce(bt, bn) AS company_id, lpad(coalesce(bt, bn)::STRING, 10, '0') AS padded, CASE WHEN bt IS NOT NULL THEN 'ticker' WHEN bn IS NOT NULL THEN 'name' ELSE 'none' END AS found_by FROM (SELECT o_orderkey AS request_no, (SELECT min(company_id) FROM v_company WHERE ticker = CASE WHEN o_orderkey % 2 = 0 THEN 'T' || o_custkey END) AS bt, (SELECT min(company_id) FROM v_company WHERE lower(trim(company_name)) = 'customer#' || lpad((o_custkey + o_orderkey % 3 * 100000)::STRING, 9, '0')) AS bn FROM orders)")
def company_resolve(f):
    name = F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") + F.col("o_orderkey") % 3 * 100000).cast("string"), 9, "0"))
    ticker = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" t"), F.col("o_custkey").cast("string")))
    return I.resolve_companies(f.v("orders").select(F.col("o_orderkey").alias("request_no"), ticker.alias("ticker"), name.alias("name")), f.company)


@query("SELECT doc_no, 'https://www.sec.gov/Archives/edgar/data/' || regexp_replace(cik, '^0+', '') || '/' || replace(accession_number, '-', '') || '/' || accession_number || '-index.htm' AS url FROM v_filing")
def doc_url(f):
    return f.filing.select("doc_no", I.document_url(F.col("cik"), F.col("accession_number")).alias("url"))


@query("SELECT 'filing' AS origin, company_id, doc_no, form_type AS name, NULL AS error FROM v_filing UNION ALL SELECT 'news', company_id, doc_no, source, NULL FROM v_news UNION ALL SELECT 'regional', NULL, NULL, NULL, 'AnalysisException'")
def source_union(f):
    """Three sources, of which one is missing: its failure is a row of its own."""
    readers = {
        "filing": lambda: f.filing.select("company_id", "doc_no", F.col("form_type").alias("name")), "news": lambda: f.news.select("company_id", "doc_no", F.col("source").alias("name")),
        "regional": lambda: f.spark.read.parquet(f"{f.dir}/no_such_source.parquet"),
    }
    rows, errors = store.gather(f.spark, readers, {"company_id": "bigint", "doc_no": "bigint", "name": "string"})
    none = F.lit(None)
    return rows.withColumn("error", none.cast("string")).unionByName(errors.select(F.col("source").alias("origin"), none.cast("bigint").alias("company_id"), none.cast("bigint").alias("doc_no"), none.cast("string").alias("name"), "error"))


@query("""SELECT 'feed' AS origin, doc_no, NULL AS error FROM v_news WHERE doc_no % 17 > 1 UNION ALL SELECT 'feed', NULL, 'corrupt row' FROM v_news WHERE doc_no % 17 <= 1 UNION ALL SELECT 'table', doc_no, NULL FROM v_filing
UNION ALL SELECT 'table', NULL, 'no rows could be read' UNION ALL SELECT 'gone', NULL, 'AnalysisException'""")
def source_errors(f):
    """Landed JSON with spoiled records, a Parquet folder with a spoiled file, and a source that is not there: what can be read, and an error for each."""
    folder = store.shared_folder(f.spark, "landed")
    record = F.to_json(F.struct("company_id", "doc_no"))
    cut_off, wrong = F.left(record, F.length(record) - 3), F.concat(F.lit('{"company_id": "none", "doc_no": '), F.col("doc_no").cast("string"), F.lit("}"))
    f.news.select(F.when(F.col("doc_no") % 17 == 0, cut_off).when(F.col("doc_no") % 17 == 1, wrong).otherwise(record)).write.text(f"{folder}/feed")
    f.filing.select("company_id", "doc_no").write.parquet(f"{folder}/table")
    f.spark.range(1).select(F.lit("not a table")).write.mode("append").text(f"{folder}/table")
    kind = "company_id bigint, doc_no bigint"
    readers = {
        "feed": lambda: store.landed(f.spark, f"{folder}/feed", "json", kind), "table": lambda: store.landed(f.spark, f"{folder}/table", "parquet", kind),
        "gone": lambda: f.spark.read.parquet(f"{folder}/no_such_source"),
    }
    rows, errors = store.gather(f.spark, readers, {"doc_no": "bigint"})
    return rows.withColumn("error", F.lit(None).cast("string")).unionByName(errors.select(F.col("source").alias("origin"), F.lit(None).cast("bigint").alias("doc_no"), "error"))


@query("SELECT origin, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (SELECT 'filing' AS origin, form_type AS name FROM v_filing UNION ALL SELECT 'news', source FROM v_news) GROUP BY origin")
def collection_summary(f):
    rows = f.filing.select(F.lit("filing").alias("origin"), F.col("form_type").alias("name")).unionByName(f.news.select(F.lit("news").alias("origin"), F.col("source").alias("name")))
    return rows.groupBy("origin").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@query("SELECT doc_no FROM v_news WHERE published_date >= DATE '2024-02-01' - 14")
def lookback(f):
    return f.news.filter(I.since(F.col("published_date"), AS_OF, 14)).select("doc_no")


@query("SELECT doc_no, relevance FROM (SELECT doc_no, round(" + O.relevance(V.NEWS_KEYWORDS) + ", 2) AS relevance FROM v_news JOIN v_company USING (company_id)) WHERE relevance >= 0.1")
def news_relevance(f):
    return I.news_relevance(f.news, f.company).select("doc_no", "relevance")


_REGIONAL = "SELECT doc_no, round(" + O.relevance(V.REGIONAL_KEYWORDS) + ", 2) AS relevance FROM v_news JOIN v_company USING (company_id)"


@query(f"SELECT doc_no, relevance FROM ({_REGIONAL}) WHERE relevance >= 0.08")
def regional_relevance(f):
    return I.regional_relevance(f.news, f.company).select("doc_no", "relevance")


@query(f"SELECT doc_no, CASE WHEN relevance < 0.05 THEN 0.25 ELSE relevance END AS relevance FROM ({_REGIONAL})")
def institutional_relevance(f):
    return I.institutional_relevance(f.news, f.company).select("doc_no", "relevance")


@query("SELECT c_custkey AS company_id, " + " OR ".join(f"contains(lower(c_name || ' ' || n_name || ' ' || r_name), {O.text(w.lower())})" for w in (*V.REGION_COUNTRIES, *V.REGION_WORDS)) + " AS regional FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def region_flag(f):
    rows = f.v("customer").join(f.v("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(f.v("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("c_custkey").alias("company_id"), I.is_regional(F.concat_ws(" ", "c_name", "n_name"), F.col("r_name")).alias("regional"))


@query("""SELECT company_id, doc_no, priority FROM (SELECT *, row_number() OVER (PARTITION BY company_id, key ORDER BY priority, filing_date, doc_no) AS r FROM (
  SELECT *, CASE WHEN doc_no % 5 = 0 THEN 'u' || doc_no ELSE accession_number END AS key, 0 AS priority FROM v_filing UNION ALL SELECT *, CASE WHEN doc_no % 5 = 0 THEN 'u' || doc_no ELSE accession_number END, 1 FROM v_filing WHERE doc_no % 3 = 0
  UNION ALL SELECT * REPLACE (doc_no + 1000000000 AS doc_no), 'X' || doc_no, 1 FROM v_filing WHERE doc_no % 3 = 1)) WHERE r = 1""")
def filing_dedup(f):
    """Filings of two sources; the second repeats some of the first, and some have no accession number."""
    lacks = F.col("doc_no") % 5 == 0
    own = f.filing.select("company_id", "doc_no", "filing_date", F.when(~lacks, F.col("accession_number")).alias("accession_number"), F.concat(F.lit("u"), F.col("doc_no").cast("string")).alias("document_url"))
    new = own.filter("doc_no % 3 = 1").withColumns({"accession_number": F.concat(F.lit("X"), F.col("doc_no").cast("string")), "doc_no": F.col("doc_no") + 1_000_000_000})
    return I.merge_filings([own, own.filter("doc_no % 3 = 0").unionByName(new)]).select("company_id", "doc_no", "priority")


@query("SELECT company_id, doc_no, priority FROM (SELECT *, row_number() OVER (PARTITION BY company_id, title ORDER BY priority, published_date, doc_no) AS r FROM (SELECT *, CASE WHEN source IN ('Reuters', 'Bloomberg') THEN 0 ELSE 1 END AS priority FROM v_news)) WHERE r = 1")
def news_merge(f):
    first = F.col("source").isin("Reuters", "Bloomberg")
    return I.merge_news([f.news.filter(first), f.news.filter(~first)]).select("company_id", "doc_no", "priority")


@query("SELECT * FROM (SELECT company_id, doc_no, row_number() OVER (PARTITION BY company_id ORDER BY relevance_score DESC, published_date, doc_no) AS rank FROM v_news) WHERE rank <= 30")
def news_topk(f):
    return I.first_rows(f.news, ["company_id"], [F.desc("relevance_score"), "published_date", "doc_no"], 30).select("company_id", "doc_no", "rank")


@query("SELECT * FROM (SELECT company_id, doc_no, row_number() OVER (PARTITION BY company_id ORDER BY relevance_score DESC, doc_no) AS rank FROM v_news WHERE source IN ('Moneyweb', 'Stears')) WHERE rank <= 40")
def regional_topk(f):
    return I.first_rows(f.news.filter(F.col("source").isin("Moneyweb", "Stears")), ["company_id"], [F.desc("relevance_score"), "doc_no"], 40).select("company_id", "doc_no", "rank")


@query("SELECT company_id, doc_no, priority, row_number() OVER (PARTITION BY company_id ORDER BY relevance_score DESC, priority, published_date, doc_no) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id, title ORDER BY priority, published_date, doc_no) AS r FROM (SELECT *, CASE WHEN source IN ('Moneyweb', 'Stears') THEN 1 ELSE 0 END AS priority FROM v_news)) WHERE r = 1")
def news_ranked(f):
    """Global and regional news merged, then ranked again by relevance."""
    regional = F.col("source").isin("Moneyweb", "Stears")
    rows = I.merge_news([f.news.filter(~regional), f.news.filter(regional)])
    rank = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("relevance_score"), "priority", "published_date", "doc_no"))
    return rows.select("company_id", "doc_no", "priority", rank.alias("rank"))


@query(r"""SELECT reply_no, company_id, signal_type, coalesce(headline, list_reduce(list_transform(string_split(signal_type, '_'), lambda x: upper(left(x, 1)) || substr(x, 2)), lambda a, b: a || ' ' || b) || ' detected') AS headline,
  coalesce(array_to_string(evidence, '; '), '') AS evidence, coalesce(reasoning, '') AS reasoning, severity, confidence FROM (
  SELECT reply_no, company_id, replace(replace(lower(j->0->>'signal_type'), ' ', '_'), '-', '_') AS signal_type, j->0->>'headline' AS headline, (j->0->'evidence')::VARCHAR[] AS evidence, j->0->>'reasoning' AS reasoning FROM (
    SELECT reply_no, company_id, trim(regexp_replace(reply, '```json|```', '', 'g'))::JSON AS j FROM v_reply)) JOIN cal USING (company_id, signal_type)""")
def explain_guard(f):
    rows = I.explain_guard(f.v("v_reply"), f.calibrated)
    return rows.withColumn("evidence", F.array_join("evidence", "; "))


# ---- clauses -------------------------------------------------------------------------------------------------

#: Clause-like sentences put around the phrases, so that clause patterns have something to find.
_CLAUSE_TEXT = "CASE doc_no % 5 WHEN 0 THEN concat('As noted, there is substantial doubt about the company''s ability to continue. ', description, ' effective January 2024') WHEN 1 THEN concat(description, '. The group experienced a breach of its financial covenant on 01/02/2024 and paid $4.5 million') WHEN 2 THEN concat(description, ' It entered into a definitive agreement to acquire Target Corp.') ELSE description END"


def _clause_docs(f) -> DataFrame:
    return f.filing.select("doc_no", "company_id", "filing_date", F.expr(_CLAUSE_TEXT.replace("''", "\\'")).alias("text"))


@query(O.clauses(_CLAUSE_TEXT) + "SELECT doc_no, kind, confidence, rank, start, clause, context, " + O.clause_details("context") + ", 'filing' AS location FROM ranked")
def clauses(f):
    return I.clauses(_clause_docs(f), "text", "doc_no")


@query(O.clauses("title || '. ' || snippet", "v_news", "published_date") + "SELECT doc_no, kind, confidence, rank, start, clause, 'news' AS location FROM ranked")
def news_clauses(f):
    docs = f.news.select("doc_no", F.concat("title", F.lit(". "), "snippet").alias("text"))
    return I.clauses(docs, "text", "doc_no", location="news").select("doc_no", "kind", "confidence", "rank", "start", "clause", "location")


@query(O.clauses(_CLAUSE_TEXT) + "SELECT doc_no, rank, '[' || array_to_string(list_transform(string_split(kind, '_'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') || '] ' || clause || CASE WHEN amount <> '' THEN ' (' || amount || ')' ELSE '' END || CASE WHEN \"time\" <> '' THEN ' — ' || \"time\" ELSE '' END AS line FROM (SELECT *, " + O.clause_details("context") + " FROM ranked)")
def clause_strings(f):
    rows = I.clauses(_clause_docs(f), "text", "doc_no")
    return rows.select("doc_no", "rank", I.clause_strings(rows).alias("line"))


def _told(docs: str, text: str, day: str, view: str, docs_order: str, n: int, each: int) -> str:
    return O.clauses(text, view, day) + f"SELECT company_id, doc_no, '{docs}' AS origin, clause, nth, rank FROM ranked JOIN (SELECT doc_no, company_id, row_number() OVER (PARTITION BY company_id ORDER BY {docs_order}) AS nth FROM {view}) USING (doc_no) WHERE nth <= {n} AND rank <= {each}"


@query("SELECT company_id, doc_no, origin, clause, place FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY origin, nth, rank) AS place FROM (SELECT * FROM ("
       + _told("filing", _CLAUSE_TEXT, "filing_date", "v_filing", "filing_date, doc_no", 5, 2) + ") UNION ALL SELECT * FROM (" + _told("news", "title || '. ' || snippet", "published_date", "v_news", "relevance_score DESC, published_date, doc_no", 3, 1) + "))) WHERE place <= 3")
def evidence(f):
    """Clauses of the first five filings (two each) and the three most relevant news items (one each) of a company, the first three of all."""
    def told(docs, order, n, location):
        few = I.first_rows(docs, ["company_id"], order, n, "nth")
        return I.clauses(few, "text", "doc_no", location=location).join(few.select("doc_no", "company_id", "nth"), "doc_no").select("company_id", "doc_no", "nth", "rank", "clause")

    filings = told(_clause_docs(f), ["filing_date", "doc_no"], V.EVIDENCE["filings"], "filing")
    news = f.news.withColumn("text", F.concat("title", F.lit(". "), "snippet"))
    items = told(news, [F.desc("relevance_score"), "published_date", "doc_no"], V.EVIDENCE["news"], "news")
    return I.evidence(filings, items).select("company_id", "doc_no", "origin", "clause", "place")


# ---- streams -------------------------------------------------------------------------------------------------


def _news_stream(f) -> DataFrame:
    from tidemark.sources.projections import VIEWS

    return f.spark.sql(VIEWS["v_news"], events=J.table_stream(f.spark, f"{f.dir}/events.parquet"))


def _run_stream(f) -> DataFrame:
    from tidemark.sources.projections import VIEWS

    return f.spark.sql(VIEWS["v_run"], orders=J.table_stream(f.spark, f"{f.dir}/orders.parquet"))


@query("SELECT company_id, signal_type, doc_no, source_name, " + O.half_up("raw_score", 6) + " AS raw_score FROM hits WHERE src_no = 1")
def stream_hits(f):
    return J.run(J.hits(_news_stream(f)), store.shared_folder(f.spark, "hits"))


@query("SELECT company_id, signal_type, doc_no, source_name, " + O.half_up("raw_score", 6) + " AS raw_score FROM hits WHERE src_no = 0")
def stream_filing_hits(f):
    from tidemark.sources.projections import VIEWS

    filings = f.spark.sql(VIEWS["v_filing"], orders=J.table_stream(f.spark, f"{f.dir}/orders.parquet"))
    return J.run(J.filing_hits(filings), store.shared_folder(f.spark, "filing-hits"))


@query("SELECT DISTINCT company_id, title FROM v_news")
def stream_dedup(f):
    """One file is one batch, so no state is dropped in between and each title of a company comes once."""
    return J.run(J.dedup(_news_stream(f)), store.shared_folder(f.spark, "dedup")).select("company_id", "title")


@query("""SELECT window_start, window_start + INTERVAL 30 DAY AS window_end, company_id, signal_type, count(DISTINCT source_name)::INT AS sources, """ + O.half_up("max(raw_score)", 6) + """ AS best_score FROM (
  SELECT h.*, date_trunc('day', n.published_at) - INTERVAL 1 DAY * unnest(range(30)) AS window_start FROM hits h JOIN (SELECT doc_no, published_at FROM v_news) n USING (doc_no) WHERE src_no = 1) GROUP BY ALL""")
def stream_corroboration(f):
    return J.newest_corroboration(_news_stream(f), store.shared_folder(f.spark, "corroboration"))


@query("""WITH both_hits AS (SELECT company_id, signal_type, 'filing:' || source_name AS source, doc_date::TIMESTAMP AS seen_at, raw_score FROM hits WHERE src_no = 0
  UNION ALL SELECT company_id, signal_type, 'news:' || source_name, published_at AS seen_at, raw_score FROM hits JOIN (SELECT doc_no, published_at FROM v_news) USING (doc_no) WHERE src_no = 1)
SELECT window_start, window_start + INTERVAL 30 DAY AS window_end, company_id, signal_type, count(DISTINCT source)::INT AS sources, """ + O.half_up("max(raw_score)", 6) + """ AS best_score FROM (
  SELECT *, TIMESTAMP '1970-01-01' + INTERVAL 1 DAY * (floor(epoch(seen_at) / 864000)::INT * 10 - unnest(range(0, 30, 10)))::INT AS window_start FROM both_hits) GROUP BY ALL""")
def stream_corroboration_both(f):
    """Filings and news in one stream of windows."""
    from tidemark.sources.projections import VIEWS

    filings = f.spark.sql(VIEWS["v_filing"], orders=J.table_stream(f.spark, f"{f.dir}/orders.parquet"))
    return J.newest_windows(J.corroboration_of_both(filings, _news_stream(f), slide="10 days"), store.shared_folder(f.spark, "both"))


@query("SELECT * FROM memory")
def stream_memory(f):
    """Runs with their signals, landed as files and folded into keyed state in order of the day."""
    folder = store.shared_folder(f.spark, "memory")
    J.briefs(f.v("v_run"), f.v("v_run_signal")).write.parquet(f"{folder}/briefs")
    return J.memory(J.table_stream(f.spark, f"{folder}/briefs"), folder)


@query(_ALERT)
def stream_alerts(f):
    return J.alerts(_run_stream(f), f.v("v_watch"), store.shared_folder(f.spark, "alerts")).select("company_id", "run_id", "run_date", "by_severity", "by_alpha")


@query("SELECT company_id, count(*) AS checks, count_if(fired) AS alerts, arg_max(severity, (run_date, run_id)) AS last_severity FROM (SELECT r.*, " + O.severity_rank("severity") + " >= " + O.severity_rank("alert_severity") + " OR coalesce(top_alpha <> 0 AND top_alpha >= alert_alpha, false) AS fired FROM v_run r JOIN v_watch USING (company_id)) GROUP BY company_id")
def stream_watch(f):
    return J.watch_counters(_run_stream(f), f.v("v_watch"), store.shared_folder(f.spark, "watch"))
