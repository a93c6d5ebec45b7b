"""A run's tables are made from those already stored."""

from tidemark.plans.queries import QUERIES
from tidemark.sources import store


def test_what_follows_the_candidates_is_made_from_stored_tables(spark, small, monkeypatch):
    read, write = {}, store.write_partition

    def spy(rows, folder, table, run_id):
        read.setdefault((run_id, table), []).append({f.rpartition("/")[2] if small in f else "stored" for f in rows.inputFiles()})
        write(rows, folder, table, run_id)

    monkeypatch.setattr(store, "write_partition", spy)
    counted = {r["table"]: r["rows"] for r in QUERIES["warehouse_write"](spark, small).collect()}
    assert set(counted) == set(store.RUN_TABLES) and counted["filings"] == spark.read.parquet(f"{small}/orders.parquet").count()
    assert all(len(read["run-1", t]) == 2 and read["run-1", t][1] == {"stored"} for t in store.RUN_TABLES)
    assert not any({"orders.parquet", "events.parquet"} & read["run-1", t][0] for t in ("signal_candidates", "detected_signals", "compound_events", "analyst_briefs", "replay_runs", "scoring_history"))


def test_ranges_of_five_tables_search_the_texts_once(spark, small):
    """Scores, compounds and confidence are made from stored candidates: no rule is left in the plan."""
    plan = QUERIES["validate_ranges"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "named_struct(signal_type" not in plan and "RLIKE" not in plan
