"""SQL building blocks for holding the queries against another engine: the engine's steps as common table expressions."""

from __future__ import annotations

import datetime as dt
import re

from tidemark.functions import values as V
from tidemark.sources.projections import VIEWS, view_sql


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def double(value: float) -> str:
    return f"CAST({value} AS DOUBLE)"


def half_up(value: str, digits: int) -> str:
    """Rounded half up as a decimal of eight places, as the engine does where a value can end on a half."""
    return f"round(CAST({value} AS DECIMAL(20, 8)), {digits})::DOUBLE"


def contained_credibility(column: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({column}), {text(k.lower())}) THEN {double(v)}" for k, v in V.CREDIBILITY.items()) + f" ELSE {double(V.DEFAULT_CREDIBILITY)} END"


def exact(column: str, table: dict, default: float) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {text(k)} THEN {double(v)}" for k, v in table.items()) + f" ELSE {double(default)} END"


def host_source(url: str, hosts: dict[str, str]) -> str:
    host = f"regexp_extract({url}, 'https?://(?:www\\.)?([^/]+)', 1)"
    label = f"split_part(replace({host}, 'www.', ''), '.', 1)"
    return f"CASE WHEN {host} = '' THEN 'Unknown' " + " ".join(f"WHEN contains({host}, {text(k)}) THEN {text(v)}" for k, v in hosts.items()) + f" ELSE upper(left({label}, 1)) || lower(substr({label}, 2)) END"


def severity_rank(column: str) -> str:
    return f"CASE {column} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 END"


def relevance(keywords: dict) -> str:
    body = "lower(title || ' ' || snippet)"
    part = f"len(list_filter(string_split(lower(company_name), ' '), lambda p: len(p) > 3 AND contains({body}, p))) > 0"
    out = f"CASE WHEN contains({body}, lower(company_name)) THEN {double(0.3)} WHEN {part} THEN {double(0.1)} ELSE {double(0)} END"
    for words in keywords.values():
        out += " + CASE WHEN " + " OR ".join(f"contains({body}, {text(w)})" for w in words) + f" THEN {double(0.12)} ELSE {double(0)} END"
    return f"least({out}, {double(1)})"


def multiplier(n: str) -> str:
    return f"CASE {n} " + " ".join(f"WHEN {k} THEN {double(m)}" for k, m in V.CORROBORATION_MULTIPLIER.items()) + f" ELSE {double(V.MOST_CORROBORATION_MULTIPLIER)} END"


ALERT = "SELECT company_id, run_id, run_date, by_severity, by_alpha FROM (SELECT r.*, " + severity_rank("severity") + " >= " + severity_rank("alert_severity") + " AS by_severity, coalesce(top_alpha <> 0 AND top_alpha >= alert_alpha, false) AS by_alpha FROM v_run r JOIN v_watch USING (company_id)) WHERE by_severity OR by_alpha"

LIQUIDITY = (
    "CASE WHEN coalesce(ticker, '') = '' THEN 'private' WHEN upper(ticker) IN (" + ", ".join(map(text, V.LARGE_CAPS)) + ") THEN 'large_cap' "
    "WHEN contains(upper(exchange), 'NYSE') OR contains(upper(exchange), 'NASDAQ') OR contains(upper(exchange), 'JSE') THEN 'mid_cap' "
    "WHEN contains(upper(exchange), 'NGX') OR contains(upper(exchange), 'NSE') OR contains(upper(exchange), 'GSE') THEN 'small_cap' ELSE 'mid_cap' END"
)

_SEVERITY = lambda adj: f"CASE WHEN b.severity = 'critical' AND corroboration < {V.CRITICAL_SOURCES} THEN 'high' ELSE coalesce(b.severity, 'low') END"
_RATE = f"CASE WHEN b.severity = 'critical' AND corroboration < {V.CRITICAL_SOURCES} THEN least(b.rate, {double(V.UNCONFIRMED_RATE)}) ELSE coalesce(b.rate, {double(0.10)}) END"


def _calibrated(source: str, factor: str) -> str:
    return f"""SELECT a.* EXCLUDE (adj), adj AS adjusted_score, {_SEVERITY('adj')} AS severity, {half_up(f"least(({_RATE}) * ({multiplier('corroboration')}) * {factor}, {double(1)})", 3)} AS confidence, round({_RATE}, 3) AS rate
FROM ({source}) a LEFT JOIN bands b ON a.signal_type = b.type AND adj >= b.lo AND adj < b.hi"""


def _hits(when: str) -> str:
    return f"""WITH docs AS (
  SELECT company_id, 0 AS src_no, {double(0)} AS rank_no, filing_date AS doc_date, doc_no, 'filing' AS source_type, form_type AS source_name, accession_number AS ref, {double(1)} AS rel,
    CASE WHEN cik IN ('NGX', 'JSE', 'NSE-KE') THEN {double(0.95)} WHEN form_type IN ('8-K', 'JSE SENS', 'NGX Announcement', 'NSE Kenya Disclosure') THEN {double(1)} ELSE {contained_credibility('form_type')} END AS cred,
    concat_ws(' ', nullif(description, ''), nullif(raw_excerpt, ''), nullif(form_type, '')) AS txt FROM v_filing {when.format('filing_date')}
  UNION ALL SELECT company_id, 1, -relevance_score, published_date, doc_no, 'news', source, NULL, relevance_score, {contained_credibility('source')}, title || ' ' || snippet FROM v_news {when.format('published_date')}
), found AS (
  SELECT txt, type, score, r_no, p_no, pat, first_value(r_no) OVER (PARTITION BY txt, type ORDER BY score DESC, r_no) AS best FROM (SELECT DISTINCT txt FROM docs) JOIN rules ON regexp_matches(lower(txt), pat, 'i')
), byt AS (
  SELECT txt, type, max(score) AS score, list(pat ORDER BY p_no) AS pl FROM found WHERE r_no = best GROUP BY txt, type
)
SELECT company_id, src_no, rank_no, doc_date, doc_no, source_type, source_name, ref, left(txt, 500) AS source_text, type AS signal_type, score AS base_score, least(score * cred * rel, {double(1)}) AS raw_score, pl, array_to_string(pl, ' | ') AS pats
FROM docs JOIN byt USING (txt) WHERE src_no = 0 OR least(score * cred * rel, {double(1)}) >= {double(V.WEAK_NEWS)}"""


def _cand(hits: str) -> str:
    return f"""SELECT w.* EXCLUDE (rn, pl, pats), c.corroboration, p.patterns, p.n_patterns FROM (SELECT *, row_number() OVER (PARTITION BY company_id, signal_type ORDER BY raw_score DESC, src_no, rank_no, doc_date, doc_no) AS rn FROM {hits}) w
JOIN (SELECT company_id, signal_type, count(DISTINCT source_type || ':' || source_name)::INT AS corroboration FROM {hits} GROUP BY ALL) c USING (company_id, signal_type)
JOIN (SELECT company_id, signal_type, string_agg(pattern, ' | ' ORDER BY src_no, rank_no, doc_date, doc_no, pos) AS patterns, count(*) AS n_patterns FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id, signal_type, pattern ORDER BY src_no, rank_no, doc_date, doc_no, pos) AS k FROM (
    SELECT company_id, signal_type, src_no, rank_no, doc_date, doc_no, unnest(pl) AS pattern, unnest(range(len(pl))) AS pos FROM {hits})) WHERE k = 1 GROUP BY ALL) p USING (company_id, signal_type)
WHERE rn = 1"""


def _scored(source: str, ticker: str, as_of: str) -> str:
    w = V.ALPHA_WEIGHTS
    alpha = half_up(
        f"100 * ({exact('severity', V.SEVERITY_WEIGHT, 0.28)} * {double(w['severity'])} + {exact('source_name', V.CREDIBILITY, V.DEFAULT_CREDIBILITY)} * {double(w['credibility'])} + (1 - 1 / (1 + {double(0.8)} * corroboration)) * {double(w['corroboration'])}"
        f" + greatest(pow({double(0.5)}, (epoch(TIMESTAMP '{as_of}') - epoch(doc_date::TIMESTAMP)) / 86400.0 / 14), {double(0.3)}) * {double(w['recency'])} + {exact('liquidity', V.LIQUIDITY_WEIGHT, 0.2)} * {double(w['liquidity'])})", 1
    )
    return f"""SELECT *, review_reason IS NOT NULL AS review FROM (SELECT *, CASE WHEN alpha >= 70 THEN 'Alpha score ' || round(alpha)::INT || ' ≥ threshold 70' WHEN severity = 'critical' THEN 'Severity CRITICAL requires mandatory review' END AS review_reason FROM (
  SELECT s.*, {alpha} AS alpha, coalesce(m.direction, 'neutral') AS direction, coalesce(m.low_pct, 0) AS low_pct, coalesce(m.high_pct, 0) AS high_pct, coalesce(m.comparable_n, 0) AS comparable_n, coalesce(m.move_confidence, 'low') AS move_confidence
  FROM (SELECT x.*, {LIQUIDITY} AS liquidity FROM {source} x LEFT JOIN (SELECT company_id, {ticker} AS ticker, exchange FROM v_company) USING (company_id)) s LEFT JOIN moves m ON m.mtype = s.signal_type AND m.msev = s.severity))"""


_TITLE = "list_reduce(list_transform(string_split(signal_type, '_'), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), lambda a, b: a || ' ' || b)"
_RISK = lambda c: exact(c, V.SEVERITY_RISK, 0)


def _ema(dim: str, start: float = 0) -> str:
    """Folded values of one dimension."""
    return f"list_reduce(list_prepend({double(start)}, coalesce(list(value ORDER BY run_date, run_id, place, key) FILTER (WHERE {dim}), [])), lambda a, x: round(CAST(a + 0.25 * (x - a) AS DECIMAL(20, 8)), 2)::DOUBLE)"


_DIM = "CASE signal_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.RISK_DIMENSION.items()) + " END"
_CLAMP = "greatest(0, least(100, {}))"

STEPS: dict[str, str] = {
    "rules": "SELECT * FROM (VALUES " + ", ".join(f"({text(t)}, {double(s)}, {i}, {j}, {text(p)})" for i, (t, s, ps) in enumerate(V.RULES) for j, p in enumerate(ps)) + ") AS r(type, score, r_no, p_no, pat)",
    "bands": "SELECT * FROM (VALUES " + ", ".join(f"({text(t)}, {double(a)}, {double(b)}, {double(r)}, {text(s)})" for t, bs in V.BANDS.items() for a, b, r, s in bs) + ") AS b(type, lo, hi, rate, severity)",
    "moves": "SELECT * FROM (VALUES " + ", ".join(f"({text(t)}, {text(s)}, {text(m[0])}, {double(m[1])}, {double(m[2])}, {m[3]}, {text(m[4])})" for (t, s), m in V.MOVES.items()) + ") AS m(mtype, msev, direction, low_pct, high_pct, comparable_n, move_confidence)",
    "inter": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {text(t)}, {len(ts)}, {text(k)}, {double(e)}, {text(r)}, {double(m)}, {text(' + '.join(ts))}, {text(why)})" for i, (ts, k, e, r, m, why) in enumerate(V.INTERACTIONS) for t in ts) + ") AS i(rule_no, signal_type, need, kind, escalation, systemic_risk, multiplier, types, reasoning)",
    "hits": _hits(""),
    "cand": _cand("hits"),
    "cal": _calibrated(f"SELECT *, least(raw_score * ({multiplier('corroboration')}), {double(1)}) AS adj FROM cand", double(1)),
    "sig": f"SELECT *, {_TITLE} || ' -- deterministic detection' AS headline FROM cal",
    "scored": _scored("cal", "ticker", "2024-02-01"),
    "comp": f"""SELECT company_id, rule_no, any_value(kind) AS kind, any_value(escalation) AS escalation, any_value(systemic_risk) AS systemic_risk, any_value(multiplier) AS multiplier,
  round(CASE WHEN avg(corroboration) >= 3 THEN least(least(sqrt(avg(confidence * confidence)), 1) * {double(1.1)}, 1) ELSE least(sqrt(avg(confidence * confidence)), 1) END, 3) AS confidence
FROM cal JOIN inter USING (signal_type) WHERE severity IN ('medium', 'high', 'critical') GROUP BY company_id, rule_no HAVING count(*) = any_value(need)""",
    "boosted": """SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY boosted_alpha DESC NULLS LAST, signal_type) AS alpha_rank FROM (
  SELECT s.*, coalesce(b.boost, 1) AS boost, CASE WHEN coalesce(b.boost, 1) = 1 THEN alpha ELSE round(CAST(least(alpha * b.boost, 100) AS DECIMAL(20, 8)), 1)::DOUBLE END AS boosted_alpha
  FROM scored s LEFT JOIN (SELECT company_id, i.signal_type, greatest(max(c.multiplier), 1) AS boost FROM comp c JOIN inter i USING (rule_no) WHERE c.kind <> 'contradictory' GROUP BY ALL) b USING (company_id, signal_type))""",
    "brief": f"""SELECT b.*, coalesce(r.systemic_risk, 'isolated') AS systemic_risk, coalesce(k.n, 0) AS n_candidates, coalesce(fl.n, 0) AS n_filings, coalesce(nw.n, 0) AS n_news, coalesce(fl.n, 0) + coalesce(nw.n, 0) AS total_sources FROM (
  SELECT company_id, max(boosted_alpha) AS top_alpha, arg_min(liquidity, alpha_rank) AS liquidity, arg_max(severity, {severity_rank('severity')}) AS overall_severity, bool_or(review) AS needs_review,
    coalesce(string_agg(review_reason, '; ' ORDER BY alpha_rank) FILTER (WHERE review), '') AS review_reasons, count(*) AS n_signals, count_if(severity = 'low') AS n_low, count_if(severity = 'medium') AS n_medium, count_if(severity = 'high') AS n_high, count_if(severity = 'critical') AS n_critical FROM boosted GROUP BY company_id) b
LEFT JOIN (SELECT company_id, arg_min(systemic_risk, CASE systemic_risk WHEN 'systemic' THEN 0 WHEN 'contained' THEN 1 ELSE 2 END) AS systemic_risk FROM comp GROUP BY company_id) r USING (company_id)
LEFT JOIN (SELECT company_id, count(*) AS n FROM cand GROUP BY company_id) k USING (company_id) LEFT JOIN (SELECT company_id, count(*) AS n FROM v_filing GROUP BY company_id) fl USING (company_id) LEFT JOIN (SELECT company_id, count(*) AS n FROM v_news GROUP BY company_id) nw USING (company_id)""",
    "stats": """SELECT *, round(confirmed / greatest(confirmed + false_positive, 1), 3) AS precision, round(confirmed / greatest(total, 1), 3) AS recall_proxy, round(false_positive / greatest(total, 1), 3) AS fp_rate FROM (
  SELECT signal_type, count(*) AS total, count_if(feedback_type = 'confirmed') AS confirmed, count_if(feedback_type = 'false_positive') AS false_positive, count_if(feedback_type = 'missed_event') AS missed, count_if(feedback_type IN ('severity_too_high', 'severity_too_low')) AS adjusted FROM v_feedback GROUP BY signal_type)""",
    "learned": f"SELECT source_name, count(*) AS votes, list_reduce(list_prepend({double(0.70)}, list((CASE WHEN was_correct THEN 1 ELSE 0 END)::DOUBLE ORDER BY k1, k2, k3, k4, k5)), lambda a, x: round(CAST(a + 0.15 * (x - a) AS DECIMAL(20, 8)), 4)::DOUBLE) AS reliability FROM v_feedback GROUP BY source_name",
    "adaptive": _calibrated(
        f"SELECT *, least(raw_score * precision_factor * fp_factor * sector_factor * ({multiplier('corroboration')}), {double(1)}) AS adj FROM (SELECT cand.*, CASE WHEN coalesce(total, 0) < 10 THEN {double(1)} ELSE greatest({double(0.7)}, least({double(1.3)}, 0.5 + precision)) END AS precision_factor, greatest({double(0.60)}, 1 - coalesce(fp_rate, 0) * 0.5) AS fp_factor, "
        + "CASE " + " ".join(f"WHEN contains(lower(sector), {text(k)}) THEN {exact('cand.signal_type', by, 1.0)}" for k, by in V.SECTOR_PRECISION.items()) + f" ELSE {double(1)} END AS sector_factor FROM cand LEFT JOIN v_company USING (company_id) LEFT JOIN stats ON stats.signal_type = cand.signal_type)", "precision_factor"),
    "parts": f"""SELECT company_id, c.signal_type, {half_up("0.70::DOUBLE * fixed + 0.30::DOUBLE * coalesce(reliability, fixed)", 4)} AS source_reliability, round(1 - 1 / (1 + 0.9::DOUBLE * corroboration), 4) AS corroboration_part,
  CASE WHEN source_type = 'filing' THEN {exact('c.source_name', V.FILING_STRENGTH, V.OTHER_FILING_STRENGTH)} ELSE {double(V.FILING_STRENGTH['news'])} END AS filing_strength, CASE WHEN coalesce(total, 0) < 5 THEN 0.60 ELSE round(precision, 4) END AS historical_precision,
  round(greatest(pow(0.5::DOUBLE, (epoch(TIMESTAMP '2024-02-01') - epoch(doc_date::TIMESTAMP)) / 86400.0 / 21), 0.35::DOUBLE), 4) AS temporal_relevance, CASE WHEN n_patterns >= 3 THEN 0.92 WHEN n_patterns = 2 THEN 0.80 ELSE 0.65 END AS extraction, CASE ents.n WHEN 0 THEN 0.30 WHEN 1 THEN 0.55 WHEN 2 THEN 0.72 ELSE 0.88 END AS entity_match, corroboration
FROM (SELECT *, {exact('source_name', V.CREDIBILITY, V.DEFAULT_CREDIBILITY)} AS fixed FROM cand) c JOIN ents ON ents.txt = c.source_text LEFT JOIN learned USING (source_name) LEFT JOIN stats ON stats.signal_type = c.signal_type""",
    "ents": f"""SELECT txt, least(len(list_distinct(list_transform(list_concat(list_concat(regexp_extract_all(txt, $${V.ENTITY_COMPANY}$$), regexp_extract_all(txt, $$(?i){V.ENTITY_AMOUNT}$$)), regexp_extract_all(txt, $${V.ENTITY_PERCENT}$$)), lambda x: trim(x)))), {V.MOST_ENTITIES}) AS n FROM (SELECT DISTINCT source_text AS txt FROM cand)""",
    "confidence": f"""SELECT *, CASE WHEN why = '' THEN 'All components within normal range.' ELSE 'Confidence reduced by: ' || why END AS reasoning FROM (
  SELECT *, {half_up("least(source_reliability * 0.22::DOUBLE + corroboration_part * 0.20::DOUBLE + filing_strength * 0.18::DOUBLE + historical_precision * 0.15::DOUBLE + entity_match * 0.10::DOUBLE + temporal_relevance * 0.10::DOUBLE + extraction * 0.05::DOUBLE, 1)", 4)} AS final_confidence,
    concat_ws(', ', CASE WHEN source_reliability < 0.60 THEN 'low source reliability (' || {half_up("source_reliability * 100", 0)}::INT || '%)' END, CASE WHEN corroboration_part < 0.55 THEN 'single-source (' || corroboration || ' corroboration)' END,
      CASE WHEN historical_precision < 0.50 THEN 'limited historical precision data' END, CASE WHEN temporal_relevance < 0.50 THEN 'signal age reducing temporal relevance' END) AS why FROM parts)""",
    "rescored": _scored("(SELECT c.*, w.severity, 0.5 AS confidence FROM cand c JOIN (SELECT company_id, signal_type, arg_max(severity, (run_date, run_id)) AS severity FROM v_run_signal GROUP BY ALL) w USING (company_id, signal_type))", "ticker", "2024-02-01"),
    "outcome": "SELECT *, CASE WHEN p10 IS NOT NULL THEN (CASE WHEN p10 > 0 THEN 'positive' WHEN p10 < 0 THEN 'negative' ELSE 'neutral' END) = expected_direction END AS direction_correct, CASE WHEN p10 IS NOT NULL THEN round(abs(abs(p10) - (expected_low + expected_high) / 2), 2) END AS magnitude_error FROM v_outcome",
    "steps": f"""SELECT company_id, run_date, run_id, {double(0)} AS place, '' AS key, 'run' AS dim, greatest({_RISK('severity')}, CASE WHEN coalesce(top_alpha, 0) <> 0 THEN top_alpha * 0.9 ELSE 0 END) AS value, top_alpha AS alpha, coalesce(n, 0)::DOUBLE AS n
FROM v_run LEFT JOIN (SELECT run_id, count(*) AS n FROM v_run_signal GROUP BY run_id) USING (run_id)
UNION ALL SELECT company_id, run_date, run_id, 1000 - coalesce(alpha, 0), signal_type, {_DIM}, {_RISK('severity')}, NULL, 0 FROM v_run_signal""",
    "folded": f"""SELECT company_id, {_ema("dim IN ('run', 'rolling')")} AS rolling, {_ema("dim = 'governance'", 50)} AS governance, {_ema("dim = 'credit'")} AS credit, {_ema("dim = 'regulatory'")} AS regulatory,
  list_reduce(list_prepend({double(0)}, list(n ORDER BY run_date, run_id) FILTER (WHERE dim = 'run')), lambda a, x: round(CAST(a + 0.25 * (x - a) AS DECIMAL(20, 8)), 2)::DOUBLE) AS velocity,
  list_reduce(list_prepend({double(0)}, coalesce(list(value ORDER BY run_date, run_id, place, key) FILTER (WHERE dim IN ('run', 'rolling') AND (run_date, run_id) < (last_date, last_run)), [])), lambda a, x: round(CAST(a + 0.25 * (x - a) AS DECIMAL(20, 8)), 2)::DOUBLE) AS before,
  arg_max(alpha, (run_date, run_id)) FILTER (WHERE dim = 'run' AND run_id = last_run) AS last_alpha, count_if(dim = 'run') AS runs, count_if(dim <> 'run') AS n_signals, count_if(key = 'leadership_change') AS leadership_changes, count_if(key = 'debt_restructuring') AS debt_restructures, count_if(key = 'regulatory_action') AS regulatory_actions
FROM (SELECT *, max(run_date) OVER (PARTITION BY company_id) AS last_date, arg_max(run_id, (run_date, run_id)) OVER (PARTITION BY company_id) AS last_run FROM steps) GROUP BY company_id""",
    "memory": f"""SELECT company_id, {_CLAMP.format('rolling')} AS rolling, {_CLAMP.format('governance')} AS governance, {_CLAMP.format('credit')} AS credit, {_CLAMP.format('regulatory')} AS regulatory, velocity, round(CAST(rolling - before AS DECIMAL(20, 8)), 2)::DOUBLE AS risk_delta,
  CASE WHEN rolling - before > 5 THEN 'deteriorating' WHEN rolling - before < -5 THEN 'improving' ELSE 'stable' END AS trend, {_CLAMP.format('round(CAST(velocity * 10 + coalesce(last_alpha, 0) * 0.3 AS DECIMAL(20, 8)), 1)::DOUBLE')} AS attention, runs, n_signals, leadership_changes, debt_restructures, regulatory_actions FROM folded""",
    "hits_then": _hits("WHERE {} <= DATE '2024-01-15'"),
    "cand_then": _cand("hits_then"),
    "cal_then": _calibrated(f"SELECT *, least(raw_score * ({multiplier('corroboration')}), {double(1)}) AS adj FROM cand_then", double(1)),
    "replayed": _scored("cal_then", "NULL::STRING", "2024-01-15"),
    "edges": "SELECT a, b, src, dst, edge_type, detail FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY added DESC, added_no DESC, added_sub DESC, edge_type DESC, detail DESC) AS rn FROM (SELECT *, least(src, dst) AS a, greatest(src, dst) AS b FROM v_edge_event WHERE src <> dst)) WHERE rn = 1",
    "both_ways": "SELECT a AS node, b AS other, edge_type, detail FROM edges UNION ALL SELECT b, a, edge_type, detail FROM edges",
    "execs": "SELECT node AS executive, other AS company FROM both_ways WHERE node IN (SELECT node_id FROM v_node WHERE node_type = 'executive')",
    "distressed": "SELECT DISTINCT 'c' || company_id AS company FROM v_run WHERE severity = 'critical'",
    "near": "SELECT company, other, min(hops) AS hops FROM (SELECT company, other, 1 AS hops FROM distressed JOIN both_ways ON node = company UNION ALL SELECT d.company, y.other, 2 FROM distressed d JOIN both_ways x ON x.node = d.company JOIN both_ways y ON y.node = x.other) WHERE other <> company GROUP BY ALL",
}

NEAR_CLASSES = """WITH co AS (SELECT node_id FROM v_node WHERE node_type = 'company'), hub AS (SELECT node FROM both_ways WHERE other IN (SELECT node_id FROM co) GROUP BY node HAVING count(*) >= 256),
two AS (SELECT d.company, y.other, 2 AS hops FROM distressed d JOIN both_ways x ON x.node = d.company JOIN both_ways y ON y.node = x.other WHERE x.other NOT IN (SELECT node FROM hub)
  UNION ALL SELECT company, other, 1 FROM distressed JOIN both_ways ON node = company)
SELECT 'pair' AS what, company, other, min(hops)::INT AS hops FROM two WHERE other <> company AND other IN (SELECT node_id FROM co) GROUP BY ALL
UNION ALL SELECT 'holds', company, other, NULL FROM distressed JOIN both_ways ON node = company WHERE other IN (SELECT node FROM hub)
UNION ALL SELECT 'member', other, node, NULL FROM both_ways WHERE node IN (SELECT node FROM hub) AND other IN (SELECT node_id FROM co)"""
CONTAGION = """SELECT d.company, CASE WHEN coalesce(r.connected, 0) > 5 OR coalesce(n.lenders, 0) > 2 THEN 'systemic' WHEN coalesce(n.lenders, 0) > 0 OR coalesce(n.board_links, 0) > 0 THEN 'contained' ELSE 'isolated' END AS risk_level,
  coalesce(n.lenders, 0) AS lenders, coalesce(n.board_links, 0) AS board_links, coalesce(n.regulators, 0) AS regulators, coalesce(r.connected, 0) AS connected, coalesce(r.second_order, '') AS second_order
FROM distressed d LEFT JOIN (SELECT node, count_if(edge_type = 'lends_to' OR coalesce(node_type = 'lender', false)) AS lenders, count_if(edge_type = 'board_overlap') AS board_links, count_if(coalesce(node_type = 'regulator', false)) AS regulators FROM both_ways LEFT JOIN v_node ON node_id = other GROUP BY node) n ON n.node = d.company
LEFT JOIN (SELECT company, count(*) AS connected, array_to_string(list_slice(list_sort(list(other)), 1, 10), ',') AS second_order FROM near WHERE other IN (SELECT node_id FROM v_node WHERE node_type = 'company') GROUP BY company) r ON r.company = d.company"""

CONTAGION_THIRD = """WITH co AS (SELECT node_id FROM v_node WHERE node_type = 'company'), one AS (SELECT company, other FROM distressed JOIN both_ways ON node = company),
two AS (SELECT company, other FROM one UNION SELECT o.company, b.other FROM one o JOIN both_ways b ON b.node = o.other), three AS (SELECT company, other FROM two UNION SELECT t.company, b.other FROM two t JOIN both_ways b ON b.node = t.other)
SELECT company, count(*) AS connected, array_to_string(list_slice(list_sort(list(other)), 1, 10), ',') AS second_order FROM three WHERE other <> company AND other IN (SELECT node_id FROM co) GROUP BY company"""
ACQUISITION_CHAINS = """WITH RECURSIVE own AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'acquired'), c(company, other, hops) AS (SELECT src, dst, 1 FROM own UNION SELECT c.company, o.dst, c.hops + 1 FROM c JOIN own o ON o.src = c.other WHERE c.hops < 60 AND o.dst <> c.company)
SELECT company, other, min(hops)::INT AS hops FROM c GROUP BY ALL"""
#: Days whose knowledge one pass tells.
DAYS = (dt.date(1996, 6, 30), dt.date(1999, 12, 31), dt.date(2024, 1, 15))
for _i, _day in enumerate(DAYS):
    STEPS |= {
        f"hits_{_i}": _hits(f"WHERE {{}} <= DATE '{_day}'"), f"cand_{_i}": _cand(f"hits_{_i}"),
        f"cal_{_i}": _calibrated(f"SELECT *, least(raw_score * ({multiplier('corroboration')}), {double(1)}) AS adj FROM cand_{_i}", double(1)), f"scored_{_i}": _scored(f"cal_{_i}", "NULL::STRING", str(_day)),
    }
AS_OF_DAYS = " UNION ALL ".join(f"SELECT '{d}' AS horizon, signal_type, count(*) AS n, max(alpha) AS top_alpha, count_if(review) AS reviews FROM scored_{i} GROUP BY signal_type" for i, d in enumerate(DAYS))

AUDIT_SQL = """WITH RECURSIVE c AS (SELECT chain, seq, 'GENESIS' AS prev_hash, sha256(payload || '|GENESIS') AS data_hash FROM v_audit WHERE seq = 1
  UNION ALL SELECT a.chain, a.seq, c.data_hash, sha256(a.payload || '|' || c.data_hash) FROM c JOIN v_audit a ON a.chain = c.chain AND a.seq = c.seq + 1)
SELECT chain, seq, prev_hash, data_hash FROM c"""


def clause_details(context: str) -> str:
    return f"trim(regexp_extract({context}, $$(?i){V.CLAUSE_AMOUNT}$$)) AS amount, trim(regexp_extract({context}, $$(?i){V.CLAUSE_TIME}$$)) AS \"time\", trim(regexp_extract({context}, $${V.CLAUSE_COMPANY}$$)) AS subject"


def clauses(document: str, view: str = "v_filing", day: str = "filing_date") -> str:
    """The steps ``docs`` to ``ranked`` for the clauses of texts derived from filings or news."""
    table = ", ".join(f"({k}, {j}, {text(kind)}, {double(c)}, {text(p)})" for k, (kind, c, ps) in enumerate(V.CLAUSES) for j, p in enumerate(ps))
    return f"""WITH docs AS (SELECT doc_no, company_id, {day} AS filing_date, {document} AS text FROM {view}), tpl(kind_no, pattern_no, kind, confidence, pat) AS (VALUES {table}),
m AS (SELECT doc_no, text, kind_no, pattern_no, kind, confidence, unnest(regexp_extract_all(text, pat, 0, 'i')) AS clause FROM docs JOIN tpl ON length(text) >= {V.CLAUSE_LEAST_TEXT} AND regexp_matches(text, pat, 'i')),
s AS (SELECT *, strpos(text, clause) - 1 AS start FROM m),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_no, clause ORDER BY kind_no, pattern_no, start) AS first FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_no, kind ORDER BY pattern_no, start) AS in_kind FROM u WHERE first = 1),
ranked AS (SELECT doc_no, kind, confidence, row_number() OVER (PARTITION BY doc_no ORDER BY confidence DESC, kind_no, pattern_no, start) AS rank, start::INT AS start, left(trim(clause), {V.CLAUSE_CHARS}) AS clause,
  left(trim(substr(text, greatest(0, start - {V.CLAUSE_WINDOW}) + 1, start + length(clause) + {V.CLAUSE_WINDOW} - greatest(0, start - {V.CLAUSE_WINDOW}))), {V.CLAUSE_CONTEXT_CHARS}) AS context FROM k WHERE in_kind <= 2)
"""


def complete(sql: str) -> str:
    """Put the steps and views that a statement names, and those that they need, in front of it."""
    order: dict[str, str] = {}

    def need(body: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b\w+\b", body)):
            if name in order:
                continue
            if name in VIEWS:
                view_sql(name, order)
            elif name in STEPS and re.search(rf"(?:FROM|JOIN)\s*\(?\s*{name}\b", body):
                need(STEPS[name])
                order.setdefault(name, STEPS[name])

    need(sql)
    if not order:
        return sql
    head = ", ".join(f"{n} AS ({b})" for n, b in order.items())
    lead = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if lead:
        return f"WITH {lead[1] or ''}{head}, {sql[lead.end():]}"
    return f"WITH {head} {sql}"
