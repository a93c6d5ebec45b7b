"""Values worked out by hand from the formulas, on tiny frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import values as V
from tidemark.operators import detect as D
from tidemark.operators import entity_graph as G
from tidemark.operators import history as H
from tidemark.operators import ingest as I
from tidemark.operators import score as S
from tidemark.sources.projections import PHRASES

FILING = "company_id long, doc_no long, accession_number string, filing_date date, form_type string, cik string, description string, raw_excerpt string"
NEWS = "company_id long, doc_no long, published_date date, source string, title string, snippet string, relevance_score double"
DAY = dt.date(2024, 1, 1)
EXPECTED = {  # phrase number: (type, score)
    0: ("m_and_a_activity", 0.90), 1: ("m_and_a_activity", 0.75), 2: ("m_and_a_activity", 0.55), 3: ("credit_risk", 0.92), 4: ("credit_risk", 0.78), 5: ("credit_risk", 0.55),
    6: ("distressed_asset", 0.95), 7: ("distressed_asset", 0.80), 8: ("distressed_asset", 0.60), 9: ("earnings_surprise", 0.88), 10: ("earnings_surprise", 0.72), 11: ("earnings_surprise", 0.55),
    12: ("leadership_change", 0.90), 13: ("leadership_change", 0.75), 14: ("leadership_change", 0.50), 15: ("regulatory_action", 0.93), 16: ("regulatory_action", 0.80), 17: ("regulatory_action", 0.58),
    18: ("debt_restructuring", 0.88), 19: ("debt_restructuring", 0.75), 20: ("debt_restructuring", 0.55), 21: ("insider_activity", 0.85), 22: ("insider_activity", 0.72), 23: ("insider_activity", 0.52),
}


def test_each_phrase_fires_its_rule(spark):
    rows = spark.createDataFrame(list(enumerate(PHRASES)), "i int, t string").select("i", X.rule_hits("t").alias("h")).collect()
    for r in rows:
        hits = {(h["signal_type"], h["base_score"]) for h in r["h"]}
        assert (EXPECTED[r["i"]] in hits) if r["i"] in EXPECTED else not hits


def test_rule_hits_of_null_and_unicode(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "going concern")], "i int, t string").select("i", X.rule_hits("t").alias("h")).collect()
    got = {r["i"]: [h["signal_type"] for h in r["h"] or []] for r in rows}
    assert got == {1: [], 2: [], 3: ["credit_risk"]}


def candidates(spark, rows):
    return spark.createDataFrame(rows, "company_id long, signal_type string, raw_score double, corroboration int")


@pytest.mark.parametrize(("raw", "n", "severity"), [(0.92, 2, "critical"), (0.95, 1, "high"), (0.30, 1, "low"), (0.60, 1, "medium")])
def test_calibrate_distressed(spark, raw, n, severity):
    assert S.calibrate(candidates(spark, [(1, "distressed_asset", raw, n)])).first()["severity"] == severity


def test_calibrate_keeps_extra_columns_and_empty(spark):
    rows = candidates(spark, [(1, "credit_risk", 0.9, 2)]).withColumn("note", F.lit("x"))
    assert "note" in S.calibrate(rows).columns
    assert S.calibrate(rows.limit(0)).count() == 0


def test_merge_takes_best_and_counts_sources(spark):
    filings = spark.createDataFrame([(1, 1, "a1", DAY, "8-K", "0000000001", "Definitive merger agreement", None), (1, 2, "a2", DAY, "10-K", "0000000001", "takeover", None), (2, 3, "a3", DAY, "10-Q", "1", " ", None)], FILING)
    news = spark.createDataFrame([(1, 9, DAY, "Reuters", "Merger confirmed", "acquisition deal announced", 0.9), (1, 10, DAY, "Some Blog", "takeover", "", 0.1)], NEWS)
    got = {r["signal_type"]: r for r in D.detect(filings, news).filter("company_id = 1").collect()}["m_and_a_activity"]
    assert (got["source_name"], got["raw_score"], got["corroboration"]) == ("8-K", 0.9, 3)
    assert len(got["patterns"]) == len(set(got["patterns"]))


def test_venue_code_counts_before_form(spark):
    filings = spark.createDataFrame([(1, 1, "a", DAY, "NGX Announcement", "NGX", "Definitive merger agreement", None)], FILING)
    assert D.filing_hits(filings).first()["raw_score"] == pytest.approx(0.90 * 0.95)


def test_source_lookups(spark):
    row = spark.range(1).select(X.contained_credibility(F.lit("unknown blog")).alias("a"), X.contained_credibility(F.lit("via REUTERS Africa")).alias("b"), X.lookup(F.lit("8-K"), V.CREDIBILITY, V.DEFAULT_CREDIBILITY).alias("c")).first()
    assert tuple(row) == (0.40, 0.95, 0.40)


def test_liquidity_tiers(spark):
    rows = spark.createDataFrame([("AAPL", None, "large_cap"), ("XYZ", "NYSE", "mid_cap"), ("XYZ", "NGX", "small_cap"), ("XYZ", None, "mid_cap"), (None, "NYSE", "private")], "t string, e string, want string")
    assert rows.filter(S.liquidity_tier(F.col("t"), F.col("e")) != F.col("want")).count() == 0


def test_more_sources_never_lower_confidence(spark):
    rows = S.calibrate(candidates(spark, [(n, "credit_risk", 0.7, n) for n in range(1, 9)])).orderBy("company_id").collect()
    assert [r["confidence"] for r in rows] == sorted(r["confidence"] for r in rows)


def test_decay_has_a_floor(spark):
    at = dt.datetime(2024, 1, 29)
    row = spark.range(1).select(S.decay(F.lit(dt.date(2024, 1, 15)), at, 14.0, 0.3).alias("a"), S.decay(F.lit(dt.date(2020, 1, 1)), at, 14.0, 0.3).alias("b")).first()
    assert row["a"] == pytest.approx(0.5) and row["b"] == 0.3


SIGNAL = "company_id long, signal_type string, severity string, confidence double, corroboration int, doc_date date"


def test_compounds_need_all_types_at_medium(spark):
    found = spark.createDataFrame([(1, "credit_risk", "high", 0.6, 3, DAY), (1, "distressed_asset", "critical", 0.8, 3, DAY), (2, "credit_risk", "low", 0.6, 1, DAY), (2, "distressed_asset", "high", 0.8, 1, DAY)], SIGNAL)
    got = S.compounds(found).collect()
    assert [r["company_id"] for r in got] == [1]
    assert got[0]["confidence"] == pytest.approx(round(min(((0.36 + 0.64) / 2) ** 0.5 * 1.1, 1), 3))


def test_compound_window_is_optional(spark):
    found = spark.createDataFrame([(1, "credit_risk", "high", 0.6, 1, DAY), (1, "distressed_asset", "high", 0.8, 1, dt.date(2023, 1, 1))], SIGNAL)
    assert S.compounds(found).count() == 1 and S.compounds(found, window_days=30).count() == 0


def test_feedback_values(spark):
    rows = spark.createDataFrame([("credit_risk", t) for t in ("confirmed", "confirmed", "false_positive")] + [("insider_activity", t) for t in ("confirmed", "false_positive")], "signal_type string, feedback_type string")
    got = {r["signal_type"]: r for r in H.feedback_stats(rows).collect()}
    assert got["credit_risk"]["precision"] == 0.667 and got["insider_activity"]["fp_rate"] == 0.5
    assert H.calibration_report(rows).count() == len(V.SIGNAL_TYPES)


def test_reliability_rises_and_tail_agrees(spark):
    rows = spark.createDataFrame([("Reuters", i % 5 != 0, i) for i in range(400)], "source_name string, was_correct boolean, i int")
    full, tail = H.source_reliability(rows, ["i"]).first(), H.source_reliability(rows, ["i"], tail=200).first()
    assert full["reliability"] > 0.70 and abs(full["reliability"] - tail["reliability"]) < 0.02


def test_outcome_values(spark):
    rows = spark.createDataFrame([("m_and_a_activity", 15.3, 5.0, 1.0, True, "positive", 8.0, 20.0), ("credit_risk", None, None, None, False, "negative", 8.0, 20.0)], "signal_type string, p10 double, p5 double, p30 double, event_confirmed boolean, expected_direction string, expected_low double, expected_high double")
    rec = H.outcome_record(rows)
    first = rec.filter("signal_type = 'm_and_a_activity'").first()
    assert first["direction_correct"] is True and first["magnitude_error"] == 1.3
    assert H.outcome_accuracy(rec).first()["confirmation_rate"] == 0.5 and H.outcome_accuracy(rec).first()["direction_accuracy"] == 1.0
    assert H.outcome_accuracy_all_rows(rec).first()["direction_accuracy"] == 0.5


def test_memory_first_run(spark):
    runs = spark.createDataFrame([(1, 7, DAY, "high", 70.0)], "run_id long, company_id long, run_date date, severity string, top_alpha double")
    signals = spark.createDataFrame([(1, 7, DAY, "credit_risk", "high", 70.0)], "run_id long, company_id long, run_date date, signal_type string, severity string, alpha double")
    got = H.company_memory(runs, signals).first()
    assert (got["rolling"], got["credit"], got["velocity"], got["trend"]) == (15.75, 15.0, 0.25, "deteriorating")


def test_memory_continues_from_profiles(spark):
    run = "run_id long, company_id long, run_date date, severity string, top_alpha double"
    none = spark.createDataFrame([], "run_id long, company_id long, run_date date, signal_type string, severity string, alpha double")
    both = spark.createDataFrame([(1, 7, DAY, "high", 70.0), (2, 7, dt.date(2024, 2, 1), "low", None)], run)
    first = H.company_memory(both.filter("run_id = 1"), none)
    assert H.company_memory(both.filter("run_id = 2"), none, first).first()["rolling"] == H.company_memory(both, none).first()["rolling"]


def test_diff(spark):
    kind = "company_id long, signal_type string, severity string, alpha double"
    a = spark.createDataFrame([(1, "credit_risk", "high", 60.0), (1, "insider_activity", "high", 60.0), (1, "m_and_a_activity", "low", 10.0)], kind)
    b = spark.createDataFrame([(1, "insider_activity", "high", 66.0), (1, "m_and_a_activity", "low", 12.0), (1, "distressed_asset", "low", 1.0)], kind)
    assert {r["signal_type"]: r["change"] for r in H.run_diff(a, b).collect()} == {"credit_risk": "removed", "insider_activity": "modified", "distressed_asset": "added"}


def test_audit_chain_finds_tampering(spark):
    chain = H.audit_build(spark.createDataFrame([(1, i, f"p{i}") for i in range(1, 6)] + [(2, 1, "q")], "chain long, seq int, payload string"))
    assert chain.filter("seq = 1 and prev_hash = 'GENESIS'").count() == 2
    assert {r["chain"]: r["links_hold"] for r in H.audit_verify(chain).collect()} == {1: True, 2: True}
    bad = chain.withColumn("prev_hash", F.when((F.col("chain") == 1) & (F.col("seq") == 3), "x").otherwise(F.col("prev_hash")))
    got = {r["chain"]: r for r in H.audit_verify(bad).collect()}
    assert not got[1]["links_hold"] and got[1]["first_break"] == 3 and got[2]["links_hold"]


def test_alert_predicate(spark):
    briefs = spark.createDataFrame([(1, "low", 55.0), (2, "high", None), (3, "low", 10.0)], "company_id long, severity string, top_alpha double")
    watch = spark.createDataFrame([(i, "medium", 50.0) for i in (1, 2, 3)], "company_id long, alert_severity string, alert_alpha double")
    assert {r["company_id"] for r in H.alerts(briefs, watch).collect()} == {1, 2}


def test_graph(spark):
    events = spark.createDataFrame([("bank", "a", "lends_to", "x", 1), ("a", "b", "board_overlap", "Jane", 2), ("b", "a", "acquired", "done", 3), ("b", "c", "board_overlap", "Joe", 4), ("exec", "a", "employed_by", "d", 5), ("exec", "c", "employed_by", "d", 6)], "src string, dst string, edge_type string, detail string, t int")
    nodes = spark.createDataFrame([("a", "company"), ("b", "company"), ("c", "company"), ("lonely", "company"), ("bank", "lender"), ("exec", "executive")], "node_id string, node_type string")
    edges = G.latest_edges(events, ["t"])
    assert edges.filter("a = 'a' and b = 'b'").first()["edge_type"] == "acquired"
    reach = {(r["other"], r["hops"]) for r in G.connected_companies(nodes, edges, spark.createDataFrame([("a",)], "company string")).collect()}
    assert reach == {("b", 1), ("c", 2)}
    assert G.shared_executives(nodes, edges).first()["executives"] == "exec"
    assert not G.connected(nodes, edges).first()["is_connected"] and G.connected(nodes.filter("node_id <> 'lonely'"), edges).first()["is_connected"]
    got = {r["company"]: r["risk_level"] for r in G.contagion(nodes, edges, spark.createDataFrame([("a",), ("lonely",), ("nowhere",)], "company string")).collect()}
    assert got == {"a": "contained", "lonely": "isolated", "nowhere": "unknown"}


@pytest.mark.parametrize(("text", "kind"), [
    ("There is substantial doubt about the company's ability to continue as a going concern.", "going_concern"), ("The firm experienced a breach of its financial covenant in May.", "covenant_breach"),
    ("It entered into a definitive agreement to acquire Target Corp.", "merger_language"), ("The unit filed for Chapter 11 bankruptcy protection.", "insolvency_formal"), ("It has a forbearance agreement with its lenders.", "restructuring_clause"),
])
def test_clause_kinds(spark, text, kind):
    rows = I.clauses(spark.createDataFrame([(1, text)], "doc_no long, text string"), "text", "doc_no").collect()
    assert kind in {r["kind"] for r in rows}
    assert all(text[r["start"] :].startswith(r["clause"]) for r in rows)


def test_clause_cap_is_strict(spark):
    text = "covenant breach, covenant waiver, covenant default, covenant violation were all noted in the report"
    assert I.clauses(spark.createDataFrame([(1, text), (2, None), (3, "short")], "doc_no long, text string"), "text", "doc_no").count() == 2


def test_feed_dates_and_items(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> A </title><link>http://x</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;hi&lt;/p&gt;</description></item><item><title></title></item></channel></rss>")
    rows = I.read_feed(spark, str(tmp_path / "f.xml")).collect()
    assert [(r["title"], r["snippet"]) for r in rows] == [("A", "hi")]
    days = spark.createDataFrame([("Mon, 01 Jan 2024 10:00:00 GMT",), ("Mon, 01 Jan 2024 10:00:00 +0000",), ("2024-01-01",), ("nonsense",), (None,)], "t string").select(I.feed_date(F.col("t"), dt.datetime(2024, 5, 5)).alias("d")).collect()
    assert [str(r["d"]) for r in days] == ["2024-01-01"] * 3 + ["2024-05-05"] * 2


def test_explain_guard_drops_inventions(spark):
    held = spark.createDataFrame([(1, "credit_risk", "high", 0.7)], "company_id long, signal_type string, severity string, confidence double")
    replies = spark.createDataFrame([(1, 1, '```json [{"signal_type": "Credit Risk", "headline": "h"}, {"signal_type": "made up"}]```'), (2, 1, '{"signal_type": "insider_activity"}'), (3, 1, "no json"), (4, 1, None)], "reply_no long, company_id long, reply string")
    assert [(r["reply_no"], r["signal_type"]) for r in I.explain_guard(replies, held).collect()] == [(1, "credit_risk")]


def test_relevance_counts_a_category_once(spark):
    row = spark.range(1).select(X.relevance(F.lit("Acme Group merger and takeover"), F.lit("default"), F.lit("Acme Group"), V.NEWS_KEYWORDS).alias("a"), X.relevance(F.lit("acme news"), F.lit(""), F.lit("Acme Group"), V.NEWS_KEYWORDS).alias("b")).first()
    assert row["a"] == pytest.approx(0.3 + 0.24) and row["b"] == pytest.approx(0.1)
