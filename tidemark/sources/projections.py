"""Input frames for the signal operators, derived from the star schema.

The text of each view runs in Spark SQL and in other engines alike, so a result can be held against the same input elsewhere. Names in
braces are tables or other views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.values import MOVES, SIGNAL_TYPES

#: Texts that the projections give to filings and news, by key modulo their number.
PHRASES = (
    "Definitive merger agreement signed with Target Corp for $2.1 billion",
    "Board in merger talks with Delta Holdings",
    "Rumoured takeover interest noted by analysts",
    "Covenant breach disclosed; going concern doubt raised",
    "Liquidity crisis deepens as cash burn rises 12%",
    "Leverage ratio discussed in annual report",
    "Business rescue proceedings commenced by board",
    "Creditor committee formed ahead of liquidation",
    "Non-performing loan book grew",
    "Profit warning issued; guidance cut",
    "Revenue fell, loss per share widened",
    "Disappointing results reported",
    "CEO resigned effective immediately from the board",
    "Interim CFO named as board reshuffle continues",
    "Succession plan published",
    "SEC probe into accounting, fine expected",
    "Regulatory inquiry opened into trading desk",
    "Compliance issue noted by auditors",
    "Debt restructuring agreed, forbearance granted",
    "Loan amendment signed with creditor settlement",
    "Maturity wall approaching in 2026",
    "SC 13D filed by activist investor",
    "Insider selling reported by two directors",
    "Open-market purchase disclosed",
    "Annual general meeting scheduled",
    "New branch opened downtown",
)


def sql_string(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def phrase(key: str) -> str:
    return f"CASE ({key}) % {len(PHRASES)} " + " ".join(f"WHEN {i} THEN {sql_string(p)}" for i, p in enumerate(PHRASES)) + " END"


def _type(key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i + 1} THEN '{t}'" for i, t in enumerate(SIGNAL_TYPES)) + " END"


def _move(field: int, default: str) -> str:
    return "CASE " + " ".join(f"WHEN signal_type = '{t}' AND severity = '{s}' THEN {sql_string(m[field]) if field == 0 else f'CAST({m[field]} AS DOUBLE)'}" for (t, s), m in MOVES.items()) + f" ELSE {default} END"


VIEWS: dict[str, str] = {
    "v_company": """
SELECT c_custkey AS company_id, c_name AS company_name,
  CASE c_custkey % 5 WHEN 0 THEN 'AAPL' WHEN 1 THEN 'SCOM' WHEN 2 THEN concat('T', CAST(c_custkey AS STRING)) WHEN 3 THEN concat('T', CAST(c_custkey AS STRING)) END AS ticker,
  CASE r_name WHEN 'AMERICA' THEN 'NYSE' WHEN 'EUROPE' THEN 'JSE' WHEN 'AFRICA' THEN 'NGX' WHEN 'ASIA' THEN 'NSE' END AS exchange,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'mining' WHEN 'BUILDING' THEN 'real_estate' WHEN 'AUTOMOBILE' THEN 'telecom' WHEN 'HOUSEHOLD' THEN 'fintech' END AS sector
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "v_filing": f"""
SELECT o_orderkey AS doc_no, concat('ACC-', CAST(o_orderkey AS STRING)) AS accession_number, o_custkey AS company_id, CAST(o_orderdate AS DATE) AS filing_date,
  CASE o_orderpriority WHEN '1-URGENT' THEN '8-K' WHEN '2-HIGH' THEN 'SC 13D' WHEN '3-MEDIUM' THEN '10-Q' WHEN '4-NOT SPECIFIED' THEN '10-K' ELSE 'NGX Announcement' END AS form_type,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'NGX' ELSE lpad(CAST(o_custkey AS STRING), 10, '0') END AS cik,
  {phrase("o_orderkey")} AS description, CAST(NULL AS STRING) AS raw_excerpt
FROM {{orders}}""",
    "v_news": f"""
SELECT event_id AS doc_no, user_id AS company_id, CAST(ts AS DATE) AS published_date, ts AS published_at,
  CASE event_id % 6 WHEN 0 THEN 'Reuters' WHEN 1 THEN 'Bloomberg' WHEN 2 THEN 'Moneyweb' WHEN 3 THEN 'Stears' WHEN 4 THEN 'Yahoo Finance' ELSE 'Some Blog' END AS source,
  {phrase("event_id")} AS title, {phrase("event_id * 7 + 3")} AS snippet, CAST((event_id * 13) % 101 AS DOUBLE) / 100 AS relevance_score,
  concat('https://', CASE event_id % 6 WHEN 0 THEN 'www.reuters.com' WHEN 1 THEN 'bloomberg.com' WHEN 2 THEN 'www.moneyweb.co.za' WHEN 3 THEN 'stears.co' WHEN 4 THEN 'finance.yahoo.com' ELSE 'some-blog.example.net' END, '/', CAST(event_id AS STRING)) AS url
FROM {{events}}""",
    "v_feedback": f"""
SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_extendedprice AS k5, {_type("l_linenumber")} AS signal_type,
  CASE WHEN l_returnflag = 'A' THEN 'confirmed' WHEN l_returnflag = 'R' THEN 'false_positive' WHEN l_linestatus = 'F' THEN 'missed_event' ELSE 'severity_too_high' END AS feedback_type,
  CASE l_suppkey % 6 WHEN 0 THEN 'Reuters' WHEN 1 THEN 'Bloomberg' WHEN 2 THEN 'Moneyweb' WHEN 3 THEN 'Stears' WHEN 4 THEN 'Yahoo Finance' ELSE 'Some Blog' END AS source_name,
  l_returnflag = 'A' AS was_correct
FROM {{lineitem}}""",
    "v_outcome_base": f"""
SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_extendedprice AS k5, {_type("l_linenumber")} AS signal_type,
  CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'R' THEN 'medium' ELSE 'low' END AS severity, (l_discount - l_tax) * 100 AS p5,
  CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN NULL ELSE (l_discount - l_tax) * 250 END AS p10, (l_discount - l_tax) * 400 AS p30, l_linestatus = 'F' AS event_confirmed
FROM {{lineitem}}""",
    "v_outcome": f"""
SELECT *, {_move(0, "'neutral'")} AS expected_direction, {_move(1, "CAST(0 AS DOUBLE)")} AS expected_low, {_move(2, "CAST(0 AS DOUBLE)")} AS expected_high FROM {{v_outcome_base}}""",
    "v_run": """
SELECT o_orderkey AS run_id, o_custkey AS company_id, CAST(o_orderdate AS DATE) AS run_date,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS DOUBLE) END AS top_alpha
FROM {orders}""",
    "v_run_signal": f"""
SELECT run_id, company_id, run_date, signal_type, severity, alpha FROM (
  SELECT l_orderkey AS run_id, {_type("l_linenumber")} AS signal_type,
    max(CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'critical' END) AS severity,
    max(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 101 AS DOUBLE)) AS alpha
  FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber
) JOIN (SELECT o_orderkey, o_custkey AS company_id, CAST(o_orderdate AS DATE) AS run_date FROM {{orders}}) ON run_id = o_orderkey""",
    "v_node": """
SELECT concat('c', CAST(c_custkey AS STRING)) AS node_id, 'company' AS node_type FROM {customer}
UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), 'lender' FROM {supplier}
UNION ALL SELECT concat('r', CAST(r_regionkey AS STRING)), 'regulator' FROM {region}
UNION ALL SELECT concat('x', CAST(p_partkey AS STRING)), 'executive' FROM {part} WHERE p_partkey % 10 = 0""",
    "v_edge_event": """
SELECT concat('s', CAST(l_suppkey AS STRING)) AS src, concat('c', CAST(o_custkey AS STRING)) AS dst, 'lends_to' AS edge_type, l_returnflag AS detail, CAST(o_orderdate AS DATE) AS added, o_orderkey AS added_no, l_linenumber AS added_sub
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber = 1
UNION ALL SELECT concat('r', CAST(n_regionkey AS STRING)), concat('c', CAST(c_custkey AS STRING)), 'regulates', n_name, DATE '1995-01-01', c_custkey, 0 FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT concat('x', CAST(l_partkey AS STRING)), concat('c', CAST(o_custkey AS STRING)), 'employed_by', 'director', CAST(o_orderdate AS DATE), o_orderkey, l_linenumber FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_partkey % 10 = 0 AND l_linenumber = 2
UNION ALL SELECT concat('c', CAST(o_custkey AS STRING)), concat('c', CAST((o_custkey * 7 + 1) % 1500 AS STRING)), CASE o_orderkey % 2 WHEN 0 THEN 'board_overlap' ELSE 'acquired' END, o_orderstatus, CAST(o_orderdate AS DATE), o_orderkey, 0 FROM {orders} WHERE o_orderkey % 10 = 3 AND (o_custkey * 7 + 1) % 1500 <> o_custkey""",
    "v_audit": """
SELECT o_custkey AS chain, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, concat(o_orderstatus, '~', o_orderpriority, '~', CAST(o_orderkey AS STRING)) AS payload FROM {orders}""",
    "v_watch": """
SELECT c_custkey AS company_id, CASE c_custkey % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'critical' END AS alert_severity, CAST(40 + c_custkey % 50 AS DOUBLE) AS alert_alpha FROM {customer} WHERE c_custkey % 4 = 0""",
    "v_reply": f"""
SELECT o_orderkey AS reply_no, o_custkey AS company_id, concat('```json [{{{{"signal_type": "', CASE o_orderkey % 4 WHEN 0 THEN 'Credit-Risk' WHEN 1 THEN 'm_and_a activity' WHEN 2 THEN 'insider activity' ELSE 'made_up' END, '"', CASE o_orderkey % 3 WHEN 0 THEN '' ELSE concat(', "headline": "H', CAST(o_orderkey AS STRING), '"') END, CASE o_orderkey % 4 WHEN 2 THEN ', "evidence": ["a fact", "another"], "reasoning": "Because."' ELSE '' END, '}}}}]```') AS reply FROM {{orders}} WHERE o_orderkey % 5 = 0""",
}


def names_in(text: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the list, or a table of the folder."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in names_in(text)})


def view_sql(name: str, seen: dict[str, str]) -> None:
    """Add the SQL of a view, and of the views below it, to ``seen`` in order of need."""
    if name in seen or name not in VIEWS:
        return
    for n in names_in(VIEWS[name]):
        view_sql(n, seen)
    seen[name] = VIEWS[name].format(**{n: n for n in names_in(VIEWS[name])})
