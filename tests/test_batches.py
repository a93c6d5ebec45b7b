"""Results that must not hang on how the input arrives or how it is dealt: batches, tails, blocks, hubs, files."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import entity_graph as G
from tidemark.operators import history as H
from tidemark.operators import ingest as I
from tidemark.operators import score as S
from tidemark.sources import store
from tidemark.streaming import jobs as J

TYPES = ("leadership_change", "debt_restructuring", "regulatory_action", "credit_risk", "earnings_surprise")
RUN = "run_id long, company_id long, run_date date, severity string, top_alpha double"
SIGNAL = "run_id long, company_id long, run_date date, signal_type string, severity string, alpha double"


def runs_of(spark, n_runs=60, companies=3):
    pick, day = random.Random(5), dt.date(2024, 1, 1)
    runs, signals = [], []
    for i in range(n_runs):
        c, at = i % companies, day + dt.timedelta(days=i // 4)
        runs.append((i, c, at, pick.choice(("low", "medium", "high", "critical")), pick.choice((None, 0.0, 35.0, 71.5, 99.9))))
        signals += [(i, c, at, t, pick.choice(("low", "medium", "high", "critical")), float(pick.randint(0, 90))) for t in pick.sample(TYPES, pick.randint(0, 4))]
    return spark.createDataFrame(runs, RUN), spark.createDataFrame(signals, SIGNAL)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("tail", [3, 17])
def test_tails_give_the_whole_fold(spark, tail):
    runs, signals = runs_of(spark)
    assert rows(H.company_memory(runs, signals, tail=tail)) == rows(H.company_memory(runs, signals))


def test_profiles_go_on_over_batches(spark):
    runs, signals = runs_of(spark)
    whole = H.company_memory(runs, signals)
    first = H.company_memory(runs.filter("run_id < 23"), signals.filter("run_id < 23"))
    second = H.company_memory(runs.filter("run_id >= 23"), signals.filter("run_id >= 23"), store.cut(first), tail=5)
    assert rows(second) == rows(whole) and sum(r["n_signals"] for r in second.collect()) == signals.count()


@pytest.mark.parametrize("right", [0.5, 1.0])
def test_reliability_by_tails(spark, right):
    pick = random.Random(3)
    votes = [(f"s{i % 3}", pick.random() < right, i) for i in range(900)] + [(None, True, 1000)]
    feedback = spark.createDataFrame(votes, "source_name string, was_correct boolean, k long")
    got = {r["source_name"]: (r["votes"], r["reliability"]) for r in H.source_reliability(feedback, ["k"], tail=4).collect()}
    for s in ("s0", "s1", "s2", None):
        value, n = 0.70, 0
        for name, ok, _ in votes:
            if name == s:
                value, n = float(round(10_000 * (value + 0.15 * ((1.0 if ok else 0.0) - value)) + 1e-7)) / 10_000, n + 1
        assert got[s] == (n, pytest.approx(value, abs=1e-9))


def test_audit_chain(spark):
    events = [(c, i + 1, f"p{c}-{i}") for c in range(3) for i in range(7 * c + 1)]
    got = {(r["chain"], r["seq"]): (r["prev_hash"], r["data_hash"]) for r in H.audit_build(spark.createDataFrame(events, "chain long, seq long, payload string")).collect()}
    last = {}
    for c, i, p in events:
        before = last.get(c, "GENESIS")
        last[c] = hashlib.sha256(f"{p}|{before}".encode()).hexdigest()
        assert got[c, i] == (before, last[c])
    assert len(got) == len(events)


def test_chains_go_on_over_batches(spark):
    events = spark.createDataFrame([(c, i + 1, f"p{c}-{i}") for c in range(4) for i in range(5 * c + 1)] + [(None, 1, "x"), (None, 7, "y")], "chain long, seq long, payload string")
    whole, parts, heads = rows(H.audit_build(events)), [], None
    for own in ("seq <= 2", "seq between 3 and 6", "seq > 6"):
        part = store.cut(H.audit_build(events.filter(own), heads))
        assert all(r["links_hold"] and r["first_change"] is None for r in H.audit_verify(part, heads).collect())
        if heads is not None:  # without the heads the first link of a batch looks broken
            assert not all(r["links_hold"] for r in H.audit_verify(part).collect())
        parts += rows(part)
        new = H.audit_heads(part)
        heads = store.cut(new if heads is None else heads.join(new.select("chain"), "chain", "left_anti").unionByName(new))
    assert sorted(parts, key=str) == whole


def random_graph(spark, seed=9):
    pick = random.Random(seed)
    nodes = spark.createDataFrame([(f"c{i}", "company") for i in range(40)] + [(f"s{i}", "lender") for i in range(6)] + [("r0", "regulator"), ("r1", "regulator")], "node_id string, node_type string")
    links = {tuple(sorted(x)) for x in [(f"c{pick.randrange(40)}", f"s{pick.randrange(6)}") for _ in range(45)] + [(f"c{i}", f"r{i % 2}") for i in range(0, 40, 3)] + [(f"c{pick.randrange(40)}", f"c{pick.randrange(40)}") for _ in range(12)] if x[0] != x[1]}
    edges = spark.createDataFrame([(a, b, a, b, "lends_to", "x") for a, b in links], "a string, b string, src string, dst string, edge_type string, detail string")
    return nodes, edges


@pytest.mark.parametrize(("hub", "depth"), [(2, 2), (4, 2), (1000, 2), (4, 1), (3, 3), (5, 4)])
def test_reach_equals_all_pairs(spark, hub, depth):
    nodes, edges = random_graph(spark, seed=9 + hub)
    # a source without a node, and a source that is a hub, are asked for too
    sources = nodes.select(nodes["node_id"].alias("company")).unionByName(spark.createDataFrame([("c99",)], "company string"))
    near = {}
    for r in G.connected_companies(nodes, edges, sources, depth).collect():
        near.setdefault(r["company"], set()).add(r["other"])
    got = {r["company"]: (r["connected"], r["second_order"]) for r in G.reach(nodes, edges, sources, hub=hub, depth=depth).collect()}
    assert got == {c: (len(o), ",".join(sorted(o)[:10])) for c, o in near.items()}


@pytest.mark.parametrize(("hub", "giant", "depth"), [(2, 1, 3), (3, 2, 3), (2, 3, 4), (4, 1, 2)])
def test_reach_with_giants_equals_all_pairs(spark, monkeypatch, hub, giant, depth):
    """Lists pass through hubs behind the first hop, but not through giants; unions are made in small pieces."""
    monkeypatch.setattr(G, "GIANT", giant)
    monkeypatch.setattr(G, "_SALT", 2)
    nodes, edges = random_graph(spark, seed=30 + hub + giant)
    sources = nodes.select(nodes["node_id"].alias("company"))
    near = {}
    for r in G.connected_companies(nodes, edges, sources, depth).collect():
        near.setdefault(r["company"], set()).add(r["other"])
    got = {r["company"]: (r["connected"], r["second_order"]) for r in G.reach(nodes, edges, sources, hub=hub, depth=depth).collect()}
    assert got == {c: (len(o), ",".join(sorted(o)[:10])) for c, o in near.items()}


@pytest.mark.parametrize(("hub", "giant"), [(1000, 16), (4, 16), (4, 1)])
def test_near_companies_equal_all_pairs(spark, monkeypatch, hub, giant):
    monkeypatch.setattr(G, "GIANT", giant)
    monkeypatch.setattr(G, "BLOCK", 7)
    nodes, edges = random_graph(spark, seed=70 + giant)
    sources = nodes.select(nodes["node_id"].alias("company")).unionByName(spark.createDataFrame([("c99",)], "company string"))
    pairs, holds, members = G.near_companies(nodes, edges, sources, hub=hub)
    of = lambda rows: [tuple(r) for r in rows.collect()]
    listed, inside = of(pairs), {}
    for h, m in of(members):
        inside.setdefault(h, set()).add(m)
    got, near = {(c, o): n for c, o, n in listed}, {(r["company"], r["other"]): r["hops"] for r in G.connected_companies(nodes, edges, sources).collect()}
    assert len(got) == len(listed) and got.items() <= near.items()
    behind = {(c, m) for c, h in of(holds) for m in inside[h] if m != c}
    assert got.keys() | behind == near.keys()
    assert {p for p, n in near.items() if n == 1} <= got.keys() and (bool(behind) == (hub == 4))


def test_pairs_are_not_exchanged(spark):
    """No exchange comes after a neighbour's list is met with its sources but the one by blocks, unless a source is wide."""
    nodes, edges = random_graph(spark, seed=5)
    pairs, _, _ = G.near_companies(nodes, edges, nodes.select(nodes["node_id"].alias("company")), hub=1000)
    blocks = [line for line in pairs._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    by_pair = [line for line in blocks if "(company#" in line and ", other#" in line]
    assert len(by_pair) == 1 and pairs.filter("hops = 2").count() > 0  # that of the wide ones, of which there are none
    assert any("hashpartitioning(_block#" in line for line in blocks) and not any("(_block#" in line and ", company#" in line for line in blocks)


def test_reach_makes_no_row_a_pair(spark, monkeypatch):
    """30 lenders of 30 companies each: 300 companies have 22,000 pairs within two hops, and far more nodes within three; the rows grow with the edges."""
    pick, sizes = random.Random(2), []
    cut = G.cut
    monkeypatch.setattr(G, "cut", lambda df: sizes.append(cut(df)) or sizes[-1])
    nodes = spark.createDataFrame([(f"c{i:03}", "company") for i in range(300)] + [(f"s{i}", "lender") for i in range(30)], "node_id string, node_type string")
    links = [(f"c{i:03}", f"s{k}") for i in range(300) for k in pick.sample(range(30), 3)]
    edges = spark.createDataFrame([(a, b, b, a, "lends_to", "x") for a, b in links], "a string, b string, src string, dst string, edge_type string, detail string")
    for depth in (2, 3):
        got = G.reach(nodes, edges, nodes.filter("node_type = 'company'").selectExpr("node_id company"), depth=depth)
        assert got.agg(F.sum("connected")).first()[0] > 20_000
    assert max(df.count() for df in sizes) <= 2 * len(links)


def test_hub_classes_do_not_list_members(spark):
    """Three hubs a company out of twelve, 4,500 edges: 220 classes at most, and every one has a few bitmaps, not its members."""
    pick = random.Random(1)
    nodes = spark.createDataFrame([(f"c{i:04}", "company") for i in range(1500)] + [(f"s{i}", "lender") for i in range(12)], "node_id string, node_type string")
    links = [(f"c{i:04}", f"s{k}") for i in range(1500) for k in pick.sample(range(12), 3)]
    edges = spark.createDataFrame([(a, b, b, a, "lends_to", "x") for a, b in links], "a string, b string, src string, dst string, edge_type string, detail string")
    members = {}
    for c, k in links:
        members.setdefault(k, set()).add(c)
    want = {c: set() for c, _ in links}
    for c, k in links:
        want[c] |= members[k]
    got = {r["company"]: r["connected"] for r in G.reach(nodes, edges, nodes.filter("node_type = 'company'").selectExpr("node_id company")).collect()}
    assert got == {c: len(o) - 1 for c, o in want.items()}


def test_acquisition_chains_with_a_cycle(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("x", "y"), ("y", "z"), ("z", "x"), ("a", "d"), ("q", "q")]
    edges = spark.createDataFrame([(min(p), max(p), *p, "acquired", "") for p in pairs] + [("a", "k", "a", "k", "lends_to", "")], "a string, b string, src string, dst string, edge_type string, detail string")
    got = {(r["company"], r["other"]): r["hops"] for r in G.acquisition_chains(edges.filter("src <> dst")).collect()}
    want = {}
    for s in {p[0] for p in pairs}:
        seen, at, hop = {s}, [s], 0
        while at:
            hop, at = hop + 1, list({d for a, d in pairs if a in at} - seen)
            for d in at:
                want[s, d] = hop
            seen |= set(at)
    assert got == want


def files(spark, df, folder, key, n=3):
    """``df`` as ``n`` files in order of ``key``, each with a later time, as they would arrive."""
    import os

    cut = sorted(r[key] for r in df.select(key).collect())
    bounds = [cut[len(cut) * i // n] for i in range(n)] + [None]
    for i in range(n):
        part = df.filter(df[key] >= bounds[i]) if bounds[i + 1] is None else df.filter((df[key] >= bounds[i]) & (df[key] < bounds[i + 1]))
        part.coalesce(1).write.mode("append").parquet(str(folder))
        for f in os.listdir(folder):
            path = os.path.join(folder, f)
            if os.path.getmtime(path) > 2e9 or f.startswith(("_", ".")):
                continue
            if os.path.getmtime(path) > 1.2e9:
                os.utime(path, (1e9 + i, 1e9 + i))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_streams_of_three_files_equal_their_batches(spark, tmp_path):
    runs, signals = runs_of(spark)
    watch = spark.createDataFrame([(0, "high", 60.0), (2, "low", 99.0)], "company_id long, alert_severity string, alert_alpha double")
    stream = lambda name: files(spark, runs, tmp_path / name, "run_id")
    told = files(spark, J.briefs(runs, signals), tmp_path / "a", "run_id", n=20)
    assert rows(J.memory(told, str(tmp_path / "memory"))) == rows(H.company_memory(runs, signals))
    assert rows(J.alerts(stream("b"), watch, str(tmp_path / "alerts"))) == rows(H.alerts(runs, watch))
    whole = H.merged_counters(H.watch_counters(runs, watch))
    assert rows(J.watch_counters(stream("c"), watch, str(tmp_path / "watch"))) == rows(whole)


def test_hit_and_dedup_streams_of_three_files(spark, small, tmp_path):
    from tidemark.sources.projections import view

    news = view(spark, small, "v_news")
    found = J.run(J.hits(files(spark, news, tmp_path / "news", "doc_no")), str(tmp_path / "hits"))
    assert rows(found) == rows(J.hits(news))
    filings = view(spark, small, "v_filing")
    assert rows(J.run(J.filing_hits(files(spark, filings, tmp_path / "filings", "doc_no")), str(tmp_path / "filing-hits"))) == rows(J.filing_hits(filings))
    once = J.run(J.dedup(files(spark, news, tmp_path / "again", "published_at")), str(tmp_path / "dedup")).select("company_id", "title")
    pairs = [tuple(r) for r in once.collect()]
    assert set(pairs) == {tuple(r) for r in news.select("company_id", "title").collect()}  # no title is lost, and one comes again only after its state was dropped
    assert len(pairs) < news.count()


def test_streams_of_nothing(spark, tmp_path):
    runs, signals = runs_of(spark, 1)
    watch = spark.createDataFrame([(0, "high", 60.0)], "company_id long, alert_severity string, alert_alpha double")
    (tmp_path / "none").mkdir()
    none = lambda df: spark.readStream.schema(df.schema).parquet(str(tmp_path / "none"))
    assert J.memory(none(J.briefs(runs, signals)), str(tmp_path / "m")).collect() == []
    assert J.alerts(none(runs), watch, str(tmp_path / "a")).collect() == []
    assert J.watch_counters(none(runs), watch, str(tmp_path / "w")).collect() == []


def test_two_sources_of_three_files_equal_their_batch(spark, small, tmp_path):
    from tidemark.sources.projections import view

    news = view(spark, small, "v_news").withColumn("published_at", F.col("published_at").cast("timestamp"))
    filings = view(spark, small, "v_filing").withColumn("filing_date", F.expr("date_add(date'2024-01-01', int(doc_no % 40))"))
    wide = ("4000 days", "4000 days")
    streams = files(spark, filings, tmp_path / "filings", "doc_no"), files(spark, news, tmp_path / "news", "doc_no")
    found = J.newest_windows(J.corroboration_of_both(*streams, delays=wide, slide="10 days"), str(tmp_path / "both"))
    whole = J.corroboration_of_both(filings, news, delays=wide, slide="10 days")
    assert rows(found) == rows(whole) and {r["sources"] for r in whole.collect()} - {1}


def test_late_rows_are_kept(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    df = spark.createDataFrame([(1, at(10)), (2, at(11)), (3, at(20)), (4, at(21)), (5, at(12)), (6, at(20))], "doc_no long, published_at timestamp")
    got = J.late_rows(files(spark, df, tmp_path / "in", "doc_no"), str(tmp_path / "late"), delay="2 days")
    assert [(r["doc_no"], r["watermark"]) for r in got.collect()] == [(5, at(19))]


def test_a_failed_rewrite_leaves_the_run(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "company_id long, x string")
    store.store_run({"filings": df}, str(tmp_path), "r1")
    spoiled = df.withColumn("x", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.store_run({"filings": spoiled}, str(tmp_path), "r1")
    assert rows(store.read_table(spark, str(tmp_path), "filings", "r1").select("company_id", "x")) == rows(df)
    store.store_run({"filings": df.limit(0)}, str(tmp_path), "r1")
    assert store.read_table(spark, str(tmp_path), "filings", "r1").count() == 0


def test_spoiled_rows_and_files_leave_the_others(spark, tmp_path):
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v"\n{"k": "x", "v": "c"}\n\n{"k": 4, "v": "d"}\n')
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("1,a\nx,b\n3,c\n")
    spark.createDataFrame([(7, "p"), (8, "q")], "k long, v string").coalesce(1).write.parquet(str(tmp_path / "table"))
    (tmp_path / "table" / "part-9.parquet").write_bytes(b"PAR1 this is none PAR1")
    kinds = ("json", "csv", "parquet")
    readers = {kind: lambda kind=kind: store.landed(spark, str(tmp_path / ("table" if kind == "parquet" else kind)), kind, "k bigint, v string") for kind in kinds}
    got, errors = store.gather(spark, readers, {"k": "bigint", "v": "string"})
    assert sorted(tuple(r) for r in got.collect()) == [("csv", 1, "a"), ("csv", 3, "c"), ("json", 1, "a"), ("json", 4, "d"), ("parquet", 7, "p"), ("parquet", 8, "q")]
    told = sorted((r["source"], r["error"], r["detail"]) for r in errors.collect())
    assert [t[:2] for t in told] == [("csv", "corrupt row"), ("json", "corrupt row"), ("json", "corrupt row"), ("parquet", "no rows could be read")]
    assert told[0][2] == "x,b" and told[3][2].endswith("part-9.parquet")


def test_whole_files_without_rows_are_no_errors(spark, tmp_path):
    """A first partition without rows is a Parquet file of its own."""
    folder, some = str(tmp_path / "a table [1]"), spark.createDataFrame([(7, "p"), (8, "q")], "k long, v string")
    for part in (some.limit(0), some.coalesce(1), some.limit(0).withColumn("k", F.lit("x")), spark.range(1, 40, 1, 2).select(F.col("id").alias("k"), F.lit("r").alias("v")).filter("k > 30")):
        part.write.mode("append").parquet(folder)
    for name, text in (("part-9.parquet", b"PAR1 this is none PAR1"), ("part-a.parquet", b"not a table")):
        (tmp_path / "a table [1]" / name).write_bytes(text)
    rows, errors = store.landed(spark, folder.replace("[", "\\[").replace("]", "\\]"), "parquet", "k bigint, v string")
    assert sorted(r["k"] for r in rows.collect()) == [7, 8, *range(31, 40)]
    assert sorted(r["detail"].rpartition("/")[2] for r in errors.collect()) == ["part-9.parquet", "part-a.parquet"]


def test_feed_files(spark, tmp_path):
    good = "<item><title>{}</title><link>http://x/{}</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><description>&lt;b&gt;A deal&lt;/b&gt;</description></item>"
    (tmp_path / "a.xml").write_text("<rss><channel>" + good.format("one", 1) + "<item><title>two</link></item>" + good.format("three", 3) + "</channel></rss>")
    (tmp_path / "b.xml").write_text("<rss><channel>" + good.format("four", 4) + "<item><title>cut o")
    items, errors = I.landed_feed(spark, str(tmp_path))
    assert sorted((r["title"], r["link"], r["snippet"]) for r in items.collect()) == [(t, f"http://x/{n}", "A deal") for t, n in (("four", 4), ("one", 1), ("three", 3))]
    assert sorted(r["detail"] for r in errors.collect()) == ["<item><title>cut o", "<item><title>two</link></item>"]


def test_very_many_phrases_equal_contains(spark):
    pick = random.Random(4)
    vocab = ["".join(pick.choice("abcd") for _ in range(pick.randint(1, 4))) for _ in range(60)] + ["Zoë", "x-y"]
    texts = [(i, " ".join(pick.choice(vocab) for _ in range(pick.randint(0, 9)))) for i in range(200)] + [(200, None), (201, "a  b ")]
    phrases = {t[a : a + pick.randint(1, 9)] for _, t in texts for a in [pick.randint(0, 9)] if t} | {"nowhere at all", " ", "a  b", "ZOË", ""}
    phrases |= {f"{pick.choice(vocab)} {pick.choice(vocab)} {i}" for i in range(10_000)}
    got = {tuple(r) for r in I.phrase_hits(spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"), "k", "t").collect()}
    few = [p for p in phrases if p.strip() and any(p.lower() in (t or "").lower() for _, t in texts)]
    assert got == {(k, p) for k, t in texts for p in few if p.lower() in (t or "").lower()}


def test_runs_are_stored_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "company_id long, x string")
    for _ in range(2):
        store.store_run({"filings": df, "news_items": df.limit(0)}, str(tmp_path), "r1")
    store.store_run({"filings": df.limit(1)}, str(tmp_path), "r2")
    assert store.read_table(spark, str(tmp_path), "filings").count() == 3 and store.read_table(spark, str(tmp_path), "filings", "r1").count() == 2
    assert store.read_table(spark, str(tmp_path), "news_items").count() == 0
    with pytest.raises(ValueError):
        store.store_run({"other": df}, str(tmp_path), "r1")


def test_a_failed_source_leaves_the_others(spark, tmp_path):
    good = spark.createDataFrame([(1, "a")], "k long, v string")
    got, errors = store.gather(spark, {"good": lambda: good, "gone": lambda: spark.read.parquet(str(tmp_path / "none")), "narrow": lambda: good.select("k")}, {"k": "bigint", "v": "string"})
    assert [tuple(r) for r in got.collect()] == [("good", 1, "a")] and sorted(r["source"] for r in errors.collect()) == ["gone", "narrow"]


def test_signal_without_candidate_has_no_score(spark):
    company = spark.createDataFrame([(1, "AAPL", "NYSE", "mining")], "company_id long, ticker string, exchange string, sector string")
    found = spark.createDataFrame([(1, "credit_risk", "critical", 0.9), (1, "insider_activity", "critical", 0.9)], "company_id long, signal_type string, severity string, confidence double")
    cand = spark.createDataFrame([(1, "credit_risk", "8-K", 2, dt.date(2024, 1, 1))], "company_id long, signal_type string, source_name string, corroboration int, doc_date date")
    got = {r["signal_type"]: r for r in S.score_all(found, cand, company, as_of=dt.datetime(2024, 2, 1)).collect()}
    assert got["credit_risk"]["alpha"] > 70 and got["credit_risk"]["review"]
    assert got["insider_activity"]["alpha"] is None and not got["insider_activity"]["review"]


def test_filings_by_number_or_address(spark):
    cols = "company_id long, doc_no long, accession_number string, document_url string, filing_date date"
    day = dt.date(2024, 1, 1)
    a = spark.createDataFrame([(1, 1, "A", "u1", day), (1, 2, None, "u2", day), (1, 3, "", "u3", day)], cols)
    b = spark.createDataFrame([(1, 4, "A", "u9", day), (1, 5, None, "u2", day), (1, 6, None, "u4", day)], cols)
    assert sorted(r["doc_no"] for r in I.merge_filings([a, b]).collect()) == [1, 2, 3, 6]
