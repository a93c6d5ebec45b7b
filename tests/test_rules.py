"""Rules of collection, explanation, profiles and evidence, with values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators import history as H
from tidemark.operators import ingest as I
from tidemark.operators import score as S

DAY = dt.date(2024, 1, 1)
RUN = "run_id long, company_id long, run_date date, severity string, top_alpha double"
SIGNAL = "run_id long, company_id long, run_date date, signal_type string, severity string, alpha double"


def test_governance_starts_in_the_middle(spark):
    runs = spark.createDataFrame([(1, 1, DAY, "low", None), (2, 2, DAY, "high", 80.0)], RUN)
    signals = spark.createDataFrame([(1, 1, DAY, "leadership_change", "low", 20.0)], SIGNAL)
    got = {r["company_id"]: r for r in H.company_memory(runs, signals).collect()}
    # 50 + 0.25 (10 - 50) = 40; a company without such a signal stays at 50
    assert (got[1]["governance"], got[2]["governance"]) == (40.0, 50.0)
    # rolling: 0 + 0.25 * 10; and max(60, 80 * 0.9) = 72, a quarter of it
    assert (got[1]["rolling"], got[2]["rolling"]) == (2.5, 18.0)
    stored = spark.createDataFrame([(1, 2.5, 40.0)], "company_id long, rolling double, governance double")
    for c in ("credit", "regulatory", "velocity"):
        stored = stored.withColumn(c, F.lit(0.0))
    for c in ("runs", "n_signals", "leadership_changes", "debt_restructures", "regulatory_actions"):
        stored = stored.withColumn(c, F.lit(1).cast("long"))
    later = {r["company_id"]: r for r in H.company_memory(runs, signals, stored).collect()}
    assert (later[1]["governance"], later[2]["governance"], later[1]["runs"], later[2]["runs"]) == (32.5, 50.0, 2, 1)


def news(spark, titles):
    return spark.createDataFrame([(1, i, t, "") for i, t in enumerate(titles)], "company_id long, doc_no long, title string, snippet string")


def test_regional_and_institutional_relevance(spark):
    company = spark.createDataFrame([(1, "Delta Holdings")], "company_id long, company_name string")
    rows = news(spark, ["Nothing to see", "A holdings matter", "A merger", "Delta Holdings merger, profit warning"])
    of = lambda df: {r["doc_no"]: r["relevance"] for r in df.collect()}
    assert of(I.regional_relevance(rows, company)) == {1: 0.1, 2: 0.12, 3: 0.54}  # what names nothing is left out
    assert of(I.institutional_relevance(rows, company)) == {0: 0.25, 1: 0.1, 2: 0.12, 3: 0.54}  # it is kept here, at the floor


def test_exchange_feeds(spark):
    item = lambda company, feed, pos, title=None: (company, feed, pos, f"{feed} {pos}" if title is None else title, "x" * 400, f"http://{feed}/{pos}", DAY)
    rows = [item(1, feed, i) for feed in V.EXCHANGE_FEEDS for i in range(12)] + [item(2, "jse_news", i) for i in range(6)]
    rows += [item(3, "jse_sens", i, "") for i in range(9)] + [item(3, "jse_news", 0)]  # items without a title give no filing
    rows += [item(4, "jse_sens", i, "" if i < 8 else "late") for i in range(9)]  # the cap counts items, with a title or not
    got = I.exchange_filings(spark.createDataFrame(rows, "company_id long, feed string, pos int, title string, text string, link string, day date")).collect()
    count = lambda c: {f: sum(r["company_id"] == c and r["form_type"] == f for r in got) for f in {x["form_type"] for x in got if x["company_id"] == c}}
    assert count(1) == {"NGX Announcement": 6, "JSE SENS": 8, "NSE Kenya Disclosure": 4}
    assert count(2) == {"JSE Announcement": 4} and count(3) == {"JSE Announcement": 1} and count(4) == {}
    prefixes = {(r["form_type"], r["cik"], r["accession_number"].split("-")[0]) for r in got}
    assert prefixes == {("NGX Announcement", "NGX", "NGX"), ("JSE SENS", "JSE", "SENS"), ("JSE Announcement", "JSE", "JSE"), ("NSE Kenya Disclosure", "NSE-KE", "NSE")}
    assert {len(r["raw_excerpt"]) for r in got} == {300}


def test_links_by_company_part_or_keyword(spark):
    anchor = lambda href, text: f'<a href="{href}">{text}</a>'
    html = "".join([
        anchor("https://x.example/deals/1", "GTBank acquires fintech in merger deal announced"), anchor("/nav", "Home"), anchor("/2", "Nothing of interest here at all"),
        anchor("/3", "A short one"), anchor("#top", "GTBank somewhere on this page"), anchor("/4", "Dangote <b>Cement</b> opens a plant"), anchor("/5", "Business rescue begins today"), anchor("/6", "1234567890 1234567890"),
    ])
    page = lambda name: spark.createDataFrame([(1, "https://x.example/t/deals", html, name)], "page_id long, url string, html string, company string")
    words = [w for ws in V.REGIONAL_KEYWORDS.values() for w in ws]
    links = lambda name: [r["link"] for r in I.link_extract(page(name), keywords=words, company="company").orderBy("rank").collect()]
    assert links("GTBank") == ["https://x.example/deals/1", "https://x.example/5"]
    assert links("Dangote Cement Plc") == ["https://x.example/deals/1", "https://x.example/4", "https://x.example/5"]  # parts of over three letters
    assert links(None) == ["https://x.example/deals/1", "https://x.example/5"]


def test_accuracy_without_known_errors(spark):
    rows = spark.createDataFrame([("a", True, None, None), ("b", False, True, 2.0), (None, True, False, 4.0)], "signal_type string, event_confirmed boolean, direction_correct boolean, magnitude_error double")
    assert {r["signal_type"]: r["avg_magnitude_error"] for r in H.outcome_accuracy(rows, by_type=True).collect()} == {"a": 0.0, "b": 2.0, None: 4.0}
    assert H.outcome_accuracy(rows.filter("signal_type = 'a'")).first()["avg_magnitude_error"] is None
    report = {(r["scope"], r["signal_type"]): (r["total"], r["confirmation_rate"], r["avg_magnitude_error"]) for r in H.outcome_report(rows).collect()}
    assert report == {("all", None): (3, 0.667, 3.0), ("type", "a"): (1, 1.0, 0.0), ("type", "b"): (1, 0.0, 2.0), ("type", None): (1, 1.0, 4.0)}
    plan = H.outcome_report(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Aggregate") == 1


def test_replies(spark):
    held = spark.createDataFrame([(1, "credit_risk", "high", 0.7)], "company_id long, signal_type string, severity string, confidence double")
    texts = ['```json [{"signal_type": "Credit Risk", "evidence": ["a", "b"], "reasoning": "so"}]```', '{"signal_type": "credit-risk", "headline": "H"}', 'Here: [{"signal_type": "credit_risk"}] as asked', '[{"signal_type": "insider_activity"}]', "no", None]
    got = {r["reply_no"]: (r["headline"], r["evidence"], r["reasoning"], r["severity"]) for r in I.explain_guard(spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "reply_no long, company_id long, reply string"), held).collect()}
    assert got == {0: ("Credit Risk detected", ["a", "b"], "so", "high"), 1: ("H", [], "", "high"), 2: ("Credit Risk detected", [], "", "high")}


def test_evidence_of_filings_and_news(spark):
    clause = lambda company, doc, nth, rank: (company, doc, nth, rank, f"{doc}.{rank}")
    schema = "company_id long, doc_no long, nth int, rank int, clause string"
    filings = spark.createDataFrame([clause(1, 10, 1, r) for r in (1, 2, 3)] + [clause(2, 20, 6, 1), clause(3, 30, 2, 1)], schema)
    items = spark.createDataFrame([clause(1, 11, 1, 1), clause(1, 11, 1, 2), clause(1, 12, 2, 1), clause(2, 21, 3, 1), clause(2, 22, 4, 1), clause(3, 31, 1, 1), clause(3, 32, 2, 1), clause(3, 33, 3, 1)], schema)
    got = {}
    for r in I.evidence(filings, items).orderBy("company_id", "place").collect():
        got.setdefault(r["company_id"], []).append(r["clause"])
    # two of a filing, then one of an item; the sixth filing and the fourth item do not count; three in all
    assert got == {1: ["10.1", "10.2", "11.1"], 2: ["21.1"], 3: ["30.1", "31.1", "32.1"]}


def test_ranges_of_stored_tables(spark):
    rows = spark.createDataFrame([(1, 0.5, 1.0, 3.0), (2, 1.5, -0.1, 3.1), (3, None, 0.0, 0.5)], "company_id long, escalation double, confidence double, multiplier double")
    got = {(r["company_id"], r["column"], r["value"]) for r in H.out_of_range(rows, "compounds", "company_id").collect()}
    assert got == {(2, "escalation", 1.5), (2, "confidence", -0.1), (2, "multiplier", 3.1)}


def test_calibration_report_of_no_feedback(spark):
    rows = spark.createDataFrame([("credit_risk", "confirmed")] * 8 + [("credit_risk", "false_positive")] * 2, "signal_type string, feedback_type string")
    got = {r["signal_type"]: r for r in H.calibration_report(rows).collect()}
    # 0.5 + 0.8 and 1 - 0.2 / 2
    assert (got["credit_risk"]["net_factor"], got["credit_risk"]["note"]) == (pytest.approx(1.17), None)
    assert (got["insider_activity"]["net_factor"], got["insider_activity"]["note"]) == (1.0, "insufficient data")


def test_days_of_one_detection_equal_replays(spark, small):
    from tidemark.sources.projections import view

    filings, items, company = (view(spark, small, v) for v in ("v_filing", "v_news", "v_company"))
    at = dt.datetime(2024, 1, 15)
    both = H.scored_as_of(filings, items, company, {"now": (dt.datetime(2024, 2, 1), None), "then": (at, at)}, listed=["now"])
    again = H.replay(filings, items, company, as_of=at)
    rows = lambda df: sorted((r["company_id"], r["signal_type"], r["severity"], r["alpha"]) for r in df.select("company_id", "signal_type", "severity", "alpha").collect())
    assert rows(both.filter("horizon = 'then'")) == rows(again)
    from tidemark.operators import detect as D

    now = S.score(S.signals(S.calibrate(D.detect(filings, items))), company, as_of=dt.datetime(2024, 2, 1))
    assert rows(both.filter("horizon = 'now'")) == rows(now)
    pair = lambda df: sorted((r["company_id"], r["signal_type"], r["change"], r["alpha_delta"]) for r in df.collect())
    diff = H.horizon_diff(both, "now", "then")
    assert pair(diff) == pair(H.run_diff(now, again))
    # each source is searched once
    plan = diff._jdf.queryExecution().sparkPlan().toString()
    assert (plan.count("orders.parquet]"), plan.count("events.parquet]")) == (1, 1)
