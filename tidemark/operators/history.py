"""Longitudinal operators: feedback, market outcomes, company profiles, run history, replay and diff, audit chains, alerts."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.functions import text as X
from tidemark.functions.text import rounded
from tidemark.operators import detect as D
from tidemark.operators import score as S
from tidemark.sources.store import cut

FEEDBACK = ("confirmed", "false_positive", "missed_event", "severity_too_high", "severity_too_low")


# ---- feedback ------------------------------------------------------------------------------------------------


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Counts per signal type with precision, recall proxy and false-positive rate."""
    is_ = lambda x: F.count_if(F.col("feedback_type") == x)
    out = feedback.groupBy("signal_type").agg(
        F.count("*").alias("total"), is_("confirmed").alias("confirmed"), is_("false_positive").alias("false_positive"), is_("missed_event").alias("missed"),
        F.count_if(F.col("feedback_type").isin("severity_too_high", "severity_too_low")).alias("adjusted"),
    )
    least = lambda c: F.greatest(c, F.lit(1))
    return out.select(
        "*", F.round(F.col("confirmed") / least(F.col("confirmed") + F.col("false_positive")), 3).alias("precision"),
        F.round(F.col("confirmed") / least(F.col("total")), 3).alias("recall_proxy"), F.round(F.col("false_positive") / least(F.col("total")), 3).alias("fp_rate"),
    )


def calibration_report(feedback: DataFrame) -> DataFrame:
    """Feedback of all signal types, also of those without any, the factors that calibration would use, and their product."""
    types = feedback.sparkSession.createDataFrame([(t,) for t in V.SIGNAL_TYPES], "signal_type string")
    rows = types.join(feedback_stats(feedback), "signal_type", "left")
    n = F.coalesce("total", F.lit(0))
    precision = F.when(n < 10, 1.0).otherwise(F.greatest(F.lit(0.7), F.least(F.lit(1.3), 0.5 + F.col("precision"))))
    penalty = F.greatest(F.lit(0.60), 1.0 - F.coalesce("fp_rate", F.lit(0.0)) * 0.5)
    return rows.select("signal_type", n.alias("total"), "precision", F.coalesce("fp_rate", F.lit(0.0)).alias("fp_rate"), precision.alias("precision_factor"), penalty.alias("fp_factor"), X.rounded(precision * penalty, 3).alias("net_factor"),
                       F.when(n == 0, "insufficient data").alias("note"), (n >= 10).alias("adaptive"))


def ema_fold(values: Column, start: float, alpha: float, digits: int) -> Column:
    """Exponential mean of an ordered list, rounded at each step as the stored profiles are."""
    return F.aggregate(values, F.lit(start), lambda a, x: rounded(a + alpha * (x - a), digits))


def source_reliability(feedback: DataFrame, order: Sequence[str], tail: int = 512) -> DataFrame:
    """Reliability of each source: an exponential mean of its votes from 0.70 on, rounded at each step.

    A rounded step never reverses the order of two values. So where the last ``tail`` votes lead from 0 and from 1 to the same value, they do from
    whatever the votes before made, and the value is exact; for the other sources the tail is made longer, up to all their votes. Only tails are
    sorted and listed.
    """
    rows = feedback.select("source_name", F.when(F.col("was_correct"), 1.0).otherwise(0.0).alias("x"), *order)
    left, done = cut(rows.groupBy("source_name").agg(F.count("*").alias("votes"))), []
    back = F.row_number().over(Window.partitionBy("source_name").orderBy(*[F.desc(c) for c in order]))
    ema = lambda start: ema_fold(F.transform("v", lambda s: s["x"]), start, 0.15, 4)
    while True:
        some = rows.join(left.select(F.col("source_name").alias("_s")), F.col("source_name").eqNullSafe(F.col("_s")), "left_semi").withColumn("_back", back).filter(F.col("_back") <= tail)
        ends = some.groupBy(F.col("source_name").alias("_s")).agg(F.array_sort(F.collect_list(F.struct(*order, "x"))).alias("v")).join(left, F.col("_s").eqNullSafe(F.col("source_name")))
        ends = ends.select("source_name", "votes", (F.col("votes") <= tail).alias("all"), ema(0.70).alias("reliability"), ema(0.0).alias("lo"), ema(1.0).alias("hi"))
        ends = cut(ends.select("source_name", "votes", F.when(F.col("all"), F.col("reliability")).when(F.col("lo") == F.col("hi"), F.col("lo")).alias("reliability")))
        done.append(ends.filter("reliability is not null"))
        left = ends.filter("reliability is null").select("source_name", "votes")
        if left.isEmpty():
            break
        tail *= 8
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


# ---- market outcomes -----------------------------------------------------------------------------------------


def outcome_record(outcomes: DataFrame) -> DataFrame:
    """Add whether the 10-day move had the expected direction, and its distance from the expected middle."""
    actual = F.when(F.col("p10") > 0, "positive").when(F.col("p10") < 0, "negative").otherwise("neutral")
    known = F.col("p10").isNotNull()
    mid = (F.col("expected_low") + F.col("expected_high")) / 2
    return outcomes.withColumn("direction_correct", F.when(known & (F.col("expected_direction") != ""), actual == F.col("expected_direction"))).withColumn(
        "magnitude_error", F.when(known & F.col("expected_low").isNotNull() & F.col("expected_high").isNotNull(), F.round(F.abs(F.abs("p10") - mid), 2)))


def _accuracy(error: Column) -> list[Column]:
    has = F.count("direction_correct")
    return [
        F.count("*").alias("total"), F.round(F.count_if("event_confirmed") / F.greatest(F.count("*"), F.lit(1)), 3).alias("confirmation_rate"),
        F.round(F.count_if("direction_correct") / F.greatest(has, F.lit(1)), 3).alias("direction_accuracy"), error.alias("avg_magnitude_error"),
    ]


def outcome_accuracy(records: DataFrame, by_type: bool = False) -> DataFrame:
    """Confirmation rate, direction accuracy over known directions, mean magnitude error over known ones; overall or by signal type. Without any
    known error the mean is null overall and 0 for a type."""
    mean = F.round(F.avg("magnitude_error"), 2)
    return records.groupBy(*(["signal_type"] if by_type else [])).agg(*_accuracy(F.coalesce(mean, F.lit(0.0)) if by_type else mean))


def outcome_report(records: DataFrame) -> DataFrame:
    """``outcome_accuracy`` overall (scope ``all``, no type) and by signal type (scope ``type``), in one aggregation over grouping sets.

    A record without a type is a type of its own; ``grouping_id`` tells it from the overall row.
    """
    overall, mean = F.grouping_id() == 1, F.round(F.avg("magnitude_error"), 2)
    rows = records.rollup("signal_type").agg(overall.alias("_all"), *_accuracy(F.when(overall, mean).otherwise(F.coalesce(mean, F.lit(0.0)))))
    return rows.withColumn("scope", F.when(F.col("_all"), "all").otherwise("type")).drop("_all")


def outcome_accuracy_all_rows(records: DataFrame) -> DataFrame:
    """The stored-table variant: unknown directions count as wrong, unknown errors as 0."""
    return records.groupBy().agg(
        F.count("*").alias("total"), F.round(F.count_if("event_confirmed") / F.greatest(F.count("*"), F.lit(1)), 3).alias("confirmation_rate"),
        F.round(F.count_if("direction_correct") / F.greatest(F.count("*"), F.lit(1)), 3).alias("direction_accuracy"), F.round(F.avg(F.abs(F.coalesce("magnitude_error", F.lit(0.0)))), 2).alias("avg_magnitude_error"),
    )


def signal_accuracy(records: DataFrame) -> DataFrame:
    move = lambda c: F.round(F.avg(F.abs(F.coalesce(c, F.lit(0.0)))), 2)
    return records.groupBy("signal_type").agg(
        F.count("*").alias("samples"), F.round(F.count_if("event_confirmed") / F.count("*"), 3).alias("confirmation_rate"),
        F.round(F.count_if("direction_correct") / F.greatest(F.count("direction_correct"), F.lit(1)), 3).alias("direction_accuracy"),
        move("p5").alias("move_5d"), move("p10").alias("move_10d"), move("p30").alias("move_30d"),
    )


# ---- company profiles ----------------------------------------------------------------------------------------


def company_key(ticker: Column, name: Column) -> Column:
    return F.replace(F.trim(F.upper(F.coalesce(F.when(ticker != "", ticker), name))), F.lit(" "), F.lit("_"))


def _risk(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in V.SEVERITY_RISK.items() for x in kv])[severity]


#: Columns of a stored profile.
PROFILE = (
    "company_id bigint, rolling double, governance double, credit double, regulatory double, velocity double, risk_delta double, trend string, attention double, "
    "runs bigint, n_signals bigint, leadership_changes bigint, debt_restructures bigint, regulatory_actions bigint"
)
_DIMS = ("rolling", "governance", "credit", "regulatory")
_COUNTS = ("runs", "n_signals", "leadership_changes", "debt_restructures", "regulatory_actions")


def company_memory(runs: DataFrame, run_signals: DataFrame, profiles: DataFrame | None = None, tail: int = 1_024) -> DataFrame:
    """Profile of each company after its runs in order (run_date, run_id), or from stored ``profiles`` on, whose counts go on too. A new
    company starts with ``PROFILE_START``.

    Within a run the run itself comes first, then its signals by alpha descending and type, as rolling risk is touched by both. Each
    exponential mean (weight 0.25) is rounded at each step and is therefore folded in order over one company's own steps. Of a company with more
    than ``tail`` steps only the last ones are listed: where they lead from the least and from the greatest state to the same one, that is exact;
    for other companies the tail is made longer.
    """
    run_level = F.greatest(_risk(F.col("severity")), F.when(F.coalesce("top_alpha", F.lit(0.0)) != 0, F.col("top_alpha") * 0.9))
    dims = F.create_map(*[F.lit(x) for kv in V.RISK_DIMENSION.items() for x in kv])
    counts = run_signals.groupBy("run_id").agg(F.count("*").alias("n_signals"))
    heads = runs.join(counts, "run_id", "left").withColumn("n_signals", F.coalesce("n_signals", F.lit(0)))
    step = lambda place, key, dim, value, alpha, n: F.struct(F.col("run_date").alias("run_date"), F.col("run_id").alias("run_id"), place.alias("place"), key.alias("key"), dim.alias("dim"), value.cast("double").alias("value"), alpha.alias("alpha"), n.cast("double").alias("n"))
    none = F.lit(None).cast("double")
    steps = heads.select("company_id", step(F.lit(0.0), F.lit(""), F.lit("run"), run_level, F.col("top_alpha"), F.col("n_signals")).alias("s"))
    steps = steps.unionByName(run_signals.select("company_id", step(1000.0 - F.coalesce("alpha", F.lit(0.0)), F.col("signal_type"), dims[F.col("signal_type")], _risk(F.col("severity")), none, F.lit(0)).alias("s")))
    is_ = lambda kind: F.count_if(F.col("s.key") == kind)
    # a company's steps are its runs and its signals; if they are few for all, they are listed with the counts in one aggregation
    most = runs.select("company_id").unionByName(run_signals.select("company_id")).groupBy("company_id").count().agg(F.max("count")).first()[0] or 0
    listed = [F.array_sort(F.collect_list("s")).alias("steps")] if most <= tail else []
    left = steps.groupBy("company_id").agg(
        F.count("*").alias("_steps"), F.coalesce(F.max("s.n"), F.lit(0.0)).alias("_most"), F.count_if(F.col("s.dim") == "run").alias("runs"), F.count_if(F.col("s.key") != "").alias("n_signals"),
        is_("leadership_change").alias("leadership_changes"), is_("debt_restructuring").alias("debt_restructures"), is_("regulatory_action").alias("regulatory_actions"), *listed)
    state = (*_DIMS, "velocity")
    if profiles is None:
        left = left.withColumns({f"_{c}": F.lit(V.PROFILE_START[c]) for c in state})
    else:
        stored = profiles.select("company_id", *[F.col(c).alias(f"_{c}") for c in (*state, *_COUNTS)])
        left = left.join(stored, "company_id", "left").withColumns({f"_{c}": F.coalesce(f"_{c}", F.lit(V.PROFILE_START[c])) for c in state})
        left = left.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in _COUNTS}).drop(*[f"_{c}" for c in _COUNTS])
    to = lambda a, x: rounded(a + 0.25 * (x - a), 2)

    def fold(acc: Column, s: Column) -> Column:
        run = s["dim"] == "run"
        moved = lambda dim: F.when((s["dim"] == dim) | (run & F.lit(dim == "rolling")), to(acc[dim], s["value"])).otherwise(acc[dim])
        return F.struct(
            *[moved(d).alias(d) for d in _DIMS],
            F.when(run, to(acc["velocity"], s["n"])).otherwise(acc["velocity"]).alias("velocity"),
            F.when(run, acc["rolling"]).otherwise(acc["before"]).alias("before"), F.when(run, s["alpha"]).otherwise(acc["last_alpha"]).alias("last_alpha"),
        )

    def folded(start: dict[str, Column]) -> Column:
        return F.aggregate("steps", F.struct(*[start[c].alias(c) for c in state], start["rolling"].alias("before"), none.alias("last_alpha")), fold)

    zero = dict.fromkeys(state, F.lit(0.0))
    back = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("s")))
    done: DataFrame | None = None
    if listed:
        done = left.withColumn("p", folded({c: F.col(f"_{c}") for c in state})).drop("steps")
    while not listed:
        some = steps.join(left.select("company_id"), "company_id", "left_semi") if done is not None else steps
        some = some.withColumn("_back", back).filter(F.col("_back") <= tail)
        ends = some.groupBy("company_id").agg(F.array_sort(F.collect_list("s")).alias("steps")).join(left, "company_id")
        whole = F.col("_steps") <= tail
        ends = ends.withColumn("lo", folded({c: F.when(whole, F.col(f"_{c}")).otherwise(zero[c]) for c in state}))
        ends = ends.withColumn("hi", F.when(~whole, folded(dict.fromkeys(_DIMS, F.lit(100.0)) | {"velocity": F.greatest("_most", "_velocity")})))
        known = whole | (F.exists("steps", lambda s: s["dim"] == "run") & (F.col("lo") == F.col("hi")))
        ends = ends.withColumn("p", F.when(known, F.col("lo"))).drop("steps", "lo", "hi")
        ends = cut(ends)
        sure = ends.filter("p is not null")
        done = sure if done is None else done.unionByName(sure)
        left = ends.filter("p is null").drop("p")
        if left.isEmpty():
            break
        tail *= 8
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    delta = F.col("p.rolling") - F.col("p.before")
    return done.select(
        "company_id", *[clamp(F.col(f"p.{d}")).alias(d) for d in _DIMS], F.col("p.velocity").alias("velocity"),
        rounded(delta, 2).alias("risk_delta"), F.when(delta > 5, "deteriorating").when(delta < -5, "improving").otherwise("stable").alias("trend"),
        clamp(rounded(F.col("p.velocity") * 10 + F.coalesce("p.last_alpha", F.lit(0.0)) * 0.3, 1)).alias("attention"), *[F.col(c).cast("long").alias(c) for c in _COUNTS],
    )


def signal_density(run_signals: DataFrame) -> DataFrame:
    return run_signals.groupBy("company_id", "signal_type").agg(F.count("*").alias("n"))


def signal_totals(run_signals: DataFrame) -> DataFrame:
    """Signals of each company in all, and those of the three counted types."""
    is_ = lambda kind: F.count_if(F.col("signal_type") == kind)
    return run_signals.groupBy("company_id").agg(F.count("*").alias("total"), is_("leadership_change").alias("leadership_changes"), is_("debt_restructuring").alias("debt_restructures"), is_("regulatory_action").alias("regulatory_actions"))


def repeated_patterns(run_signals: DataFrame, least: int = 3) -> DataFrame:
    often = signal_density(run_signals).filter(F.col("n") >= least)
    return often.groupBy("company_id").agg(F.array_join(F.array_sort(F.collect_list("signal_type")), ",").alias("patterns"))


def alpha_history(runs: DataFrame, last: int = 20) -> DataFrame:
    """The last known alphas of each company, oldest first."""
    rows = runs.filter(F.col("top_alpha").isNotNull()).withColumn("back", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("run_date"), F.desc("run_id"))))
    kept = rows.filter(F.col("back") <= last).groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("run_date", "run_id", "top_alpha"))).alias("h"))
    return kept.select("company_id", F.size("h").alias("n"), F.array_join(F.transform("h", lambda x: x["top_alpha"].cast("int").cast("string")), ",").alias("alphas"))


# ---- run history ---------------------------------------------------------------------------------------------


def newest(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The newest ``limit`` rows of each company."""
    rank = F.row_number().over(Window.partitionBy("company_id").orderBy(*[F.desc(k) for k in keys]))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit)


def scoring_trend(runs: DataFrame, limit: int = 100) -> DataFrame:
    w = Window.partitionBy("company_id").orderBy("run_date", "run_id")
    return runs.withColumn("rank", F.row_number().over(w)).withColumn("delta", F.col("top_alpha") - F.lag("top_alpha").over(w)).filter(F.col("rank") <= limit).select("company_id", "run_id", "run_date", "top_alpha", "delta", "rank")


def replay_inputs(filings: DataFrame, news: DataFrame, *, as_of: dt.datetime) -> DataFrame:
    """The documents (origin, company_id, doc_no, day) that were known at ``as_of``: filings and news dated up to then."""
    of = lambda rows, origin, day: rows.filter(F.col(day) <= F.lit(as_of).cast("date")).select(F.lit(origin).alias("origin"), "company_id", "doc_no", F.col(day).alias("day"))
    return of(filings, "filing", "filing_date").unionByName(of(news, "news", "published_date"))


def replay(filings: DataFrame, news: DataFrame, company: DataFrame, *, as_of: dt.datetime) -> DataFrame:
    """What the engine would have found at ``as_of``: the same functions over rows dated up to then, with static calibration and no ticker."""
    day = F.lit(as_of).cast("date")
    found = S.signals(S.calibrate(D.detect(filings.filter(F.col("filing_date") <= day), news.filter(F.col("published_date") <= day))))
    return S.score(found, company.withColumn("ticker", F.lit(None).cast("string")), as_of=as_of)


def scored_as_of(filings: DataFrame, news: DataFrame, company: DataFrame, days: Mapping[str, tuple[dt.datetime, dt.datetime | None]], listed: Sequence[str] = ()) -> DataFrame:
    """Scored signals as they stood on several days, with the day's name in ``horizon``: the texts are searched once.

    ``days``: name to (moment that ages are measured from, last day of documents that count or None for all). Each hit goes to the days that know its
    document; candidates are merged for each. Horizons of ``listed`` are scored with the companies' tickers, the others as replays, without.
    """
    hits = D.filing_hits(filings).unionByName(D.news_hits(news))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(None if last is None else last.date()).cast("date").alias("last")) for name, (_, last) in days.items()])
    knows = F.transform(F.filter(table, lambda d: d["last"].isNull() | (F.col("doc_date") <= d["last"])), lambda d: d["name"])
    found = S.signals(S.calibrate(D.merge_candidates(hits.withColumn("horizon", F.explode(knows)), extra=("horizon",))))
    as_of = None
    for name, (at, _) in days.items():
        as_of = F.when(F.col("horizon") == name, F.lit(at)) if as_of is None else as_of.when(F.col("horizon") == name, F.lit(at))
    return S.score(found, company, as_of=as_of, ticker=F.when(F.col("horizon").isin(*listed), F.col("ticker")))


def horizon_diff(scored: DataFrame, a: str, b: str, keys: Sequence[str] = ("company_id", "signal_type")) -> DataFrame:
    """``run_diff`` of two horizons of one frame, by one aggregation."""
    own = lambda name: F.max(F.when(F.col("horizon") == name, F.struct("severity", "alpha")))  # noqa: E731  one row a key and horizon
    rows = scored.filter(F.col("horizon").isin(a, b)).groupBy(*keys).agg(own(a).alias("_a"), own(b).alias("_b"))
    return _changes(rows.select(*keys, *[F.col(f"_{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("severity", "alpha")]))


def run_diff(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("company_id", "signal_type")) -> DataFrame:
    """Signals removed, added or modified (severity differs, or alpha by more than 5) from ``a`` to ``b``."""
    left = a.select(*keys, F.col("severity").alias("severity_a"), F.col("alpha").alias("alpha_a"))
    right = b.select(*keys, F.col("severity").alias("severity_b"), F.col("alpha").alias("alpha_b"))
    return _changes(left.join(right, list(keys), "full_outer"))


def _changes(both: DataFrame) -> DataFrame:
    delta = F.coalesce("alpha_b", F.lit(0.0)) - F.coalesce("alpha_a", F.lit(0.0))
    change = F.when(F.col("severity_b").isNull(), "removed").when(F.col("severity_a").isNull(), "added").when((F.col("severity_a") != F.col("severity_b")) | (F.abs(delta) > 5), "modified")
    return both.withColumn("change", change).withColumn("alpha_delta", F.round(delta, 1)).filter(F.col("change").isNotNull())


# ---- audit chains --------------------------------------------------------------------------------------------


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (chain, seq, payload, head) in order of chain and seq, with the hashes that link them; all that is kept is the last hash."""
    chain, last, begun = None, "", False
    for batch in batches:
        chains, payloads, heads = (batch.column(i).to_pylist() for i in (0, 2, 3))
        before, own = [], []
        for c, payload, head in zip(chains, payloads, heads, strict=True):
            if not begun or c != chain:
                chain, last, begun = c, head, True
            before.append(last)
            # a null payload makes a null hash, and what follows it has none either
            last = None if payload is None or last is None else hashlib.sha256(f"{payload}|{last}".encode()).hexdigest()
            own.append(last)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(before, pa.string()), pa.array(own, pa.string())], ["chain", "seq", "payload", "prev_hash", "data_hash"])


def audit_build(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Chain the payloads of each ``chain`` in order of ``seq``: data_hash is the SHA-256 of the payload and the hash before it.

    ``heads`` (chain, data_hash), as ``audit_heads`` gives them, are the last entries stored before; chains that it lacks begin with GENESIS. A chain is sequential by its nature: its
    entries pass one task in order, of which no more than a batch is in memory at a time, and other chains pass other tasks.
    """
    kind = events.schema["chain"].dataType.simpleString()
    rows = events.select("chain", F.col("seq").cast("int").alias("seq"), "payload")
    start = F.lit("GENESIS")
    if heads is not None:
        rows = rows.join(heads.select(F.col("chain").alias("_chain"), F.col("data_hash").alias("_head")), F.col("chain").eqNullSafe(F.col("_chain")), "left")
        start = F.coalesce("_head", start)
    ordered = rows.select("chain", "seq", "payload", start.alias("head")).repartition("chain").sortWithinPartitions("chain", "seq")
    return ordered.mapInArrow(_chained, f"chain {kind}, seq int, payload string, prev_hash string, data_hash string")


def audit_heads(chain: DataFrame) -> DataFrame:
    """The last entry of each chain: chain, seq, data_hash."""
    return chain.groupBy("chain").agg(F.max_by(F.struct("seq", "data_hash"), "seq").alias("e")).select("chain", "e.*")


def audit_verify(chain: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Per chain its length, whether all links hold, the first broken link and the first row whose stored hash does not fit its content.

    With ``heads`` the first entry of each chain must follow the last one of the batches before it.
    """
    w = Window.partitionBy("chain").orderBy("seq")
    start = F.lit("GENESIS")
    if heads is not None:
        chain = chain.join(heads.select(F.col("chain").alias("_chain"), F.col("data_hash").alias("_head")), F.col("chain").eqNullSafe(F.col("_chain")), "left")
        start = F.coalesce("_head", start)
    before = F.coalesce(F.lag("data_hash").over(w), start)
    rows = chain.withColumn("_broken", F.col("prev_hash") != before).withColumn("_changed", F.col("data_hash") != F.sha2(F.concat("payload", F.lit("|"), "prev_hash"), 256))
    return rows.groupBy("chain").agg(F.count("*").alias("entries"), (~F.bool_or("_broken")).alias("links_hold"), F.min(F.when(F.col("_broken"), F.col("seq"))).alias("first_break"), F.min(F.when(F.col("_changed"), F.col("seq"))).alias("first_change"))


# ---- watchlist and alerts ------------------------------------------------------------------------------------


def alerts(briefs: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Briefs of watched companies at or above their row's severity or alpha; a null alpha never triggers."""
    rows = briefs.join(watchlist, "company_id")
    by_severity = S.severity_rank(F.col("severity")) >= S.severity_rank(F.col("alert_severity"))
    by_alpha = (F.coalesce("top_alpha", F.lit(0.0)) != 0) & (F.col("top_alpha") >= F.col("alert_alpha"))
    return rows.withColumn("by_severity", by_severity).withColumn("by_alpha", F.coalesce(by_alpha, F.lit(False))).filter("by_severity or by_alpha")


def watch_counters(briefs: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Checks, alerts and the severity of the newest brief of each watched company that has briefs."""
    fired = alerts(briefs, watchlist).select("company_id", "run_id", F.lit(1).alias("_fired"))
    rows = briefs.join(watchlist.select("company_id"), "company_id", "left_semi").join(fired, ["company_id", "run_id"], "left")
    newest = F.struct("run_date", "run_id")
    return rows.groupBy("company_id").agg(F.count("*").alias("checks"), F.count("_fired").alias("alerts"), F.max(newest).alias("last"), F.max_by("severity", newest).alias("last_severity")).select(
        "company_id", "checks", "alerts", "last.run_date", "last.run_id", "last_severity")


def merged_counters(parts: DataFrame) -> DataFrame:
    """Counters of several batches as one row a company."""
    newest = F.struct("run_date", "run_id")
    return parts.groupBy("company_id").agg(F.sum("checks").alias("checks"), F.sum("alerts").alias("alerts"), F.max_by("last_severity", newest).alias("last_severity"))


def replay_rows(replayed: DataFrame, original_run_id: str, *, as_of: dt.datetime) -> DataFrame:
    """One stored row per replayed company: the run it repeats, the day, the versions and settings in force, and how many signals it gave."""
    settings = {"corroboration": V.CORROBORATION_MULTIPLIER, "alpha_weights": V.ALPHA_WEIGHTS, "review_alpha": V.REVIEW_ALPHA, "weak_news": V.WEAK_NEWS}
    rows = replayed.groupBy("company_id").agg(F.count("*").alias("n_signals"), F.max("alpha").alias("top_alpha"))
    return rows.select(
        "company_id", F.lit(original_run_id).alias("original_run_id"), F.lit(as_of).cast("date").alias("replay_date"), F.lit(V.RULESET_VERSION).alias("ruleset_version"),
        F.lit(V.SCORING_VERSION).alias("scoring_version"), F.lit(json.dumps(settings, sort_keys=True)).alias("config_snapshot"), "n_signals", "top_alpha")


def run_contents(runs: DataFrame, run_signals: DataFrame, filings: DataFrame, news: DataFrame, days: int = 30) -> DataFrame:
    """Per run its signals with the alphabetically last severity, and the filings and news items of its company in the ``days`` up to it.

    Runs and documents of a company are ordered by day once; a moving sum over the days counts, so no run is paired with documents.
    """
    one = lambda rows, day, what: rows.select("company_id", F.datediff(F.col(day), F.lit(dt.date(1970, 1, 1))).alias("day"), F.lit(what).alias("what"), (F.col("run_id") if what == "run" else F.lit(None).cast("long")).alias("run_id"))
    every = one(runs, "run_date", "run").unionByName(one(filings, "filing_date", "filing")).unionByName(one(news, "published_date", "news"))
    span = Window.partitionBy("company_id").orderBy("day").rangeBetween(-days, 0)
    near = lambda what: F.sum((F.col("what") == what).cast("long")).over(span)
    counted = every.select("run_id", "what", near("filing").alias("n_filings"), near("news").alias("n_news")).filter("what = 'run'").drop("what")
    signals = run_signals.groupBy("run_id").agg(F.count("signal_type").alias("n_signals"), F.max("severity").alias("worst_name"))
    return counted.join(signals, "run_id", "left").select("run_id", F.coalesce("n_signals", F.lit(0)).alias("n_signals"), "worst_name", "n_filings", "n_news")


def upsert(rows: DataFrame, changes: DataFrame, keys: Sequence[str], removed: DataFrame | None = None) -> DataFrame:
    """Rows of ``changes`` win over those of ``rows`` with the same keys; ``removed`` keys leave."""
    both = rows.withColumn("_v", F.lit(0)).unionByName(changes.withColumn("_v", F.lit(1)))
    cols = [c for c in rows.columns if c not in keys]
    out = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_v").alias("_s")).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in cols])
    return out if removed is None else out.join(removed.select(*keys), list(keys), "left_anti")


def out_of_range(rows: DataFrame, table: str, *keys: str) -> DataFrame:
    """Violations of the ranges of a stored table: its keys, the column, and what it holds; a null is none."""
    columns = V.RANGES[table]
    at = F.filter(F.array(*[F.when(~F.col(c).between(lo, hi), F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))) for c, (lo, hi) in columns.items()]), lambda x: x.isNotNull())
    return rows.select(F.lit(table).alias("table"), *keys, F.explode(at).alias("_x")).select("table", *keys, "_x.*")


def validate(found: DataFrame) -> DataFrame:
    """Violations of the ranges of scores and of the domains of names, one row each."""
    rules = {
        "confidence_range": ~F.col("confidence").between(0, 1), "raw_score_range": ~F.col("raw_score").between(0, 1), "corroboration_least": F.col("corroboration") < 1,
        "severity_domain": ~F.col("severity").isin(*V.SEVERITIES), "signal_type_domain": ~F.col("signal_type").isin(*V.SIGNAL_TYPES),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return found.select("company_id", "signal_type", F.explode(broken).alias("violation"))
