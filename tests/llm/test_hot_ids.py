"""Samples, ranges and places where one id, or none, has very many rows."""

from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, toxicity, winnow
from tidemark.llm.common import drawn

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_no_share_rounds_to_nothing(spark):
    draws = spark.range(1 << 16).select(F.shiftleft("id", 48).alias("d"))
    # evenly spread draws: 600 of 2^16 come, and of 10^10 and 10^14 rows the share is that small, not none
    assert draws.filter(drawn(F.col("d"), 600, 1 << 16)).count() == 600
    for n in (10**10, 10**14):
        least = spark.range(1).select(F.shiftleft(F.lit(((600 << 62) // n) - 1), 2).alias("d"))
        assert least.filter(drawn(F.col("d"), 600, n)).count() == 1 and least.filter(drawn(F.col("d") + 8, 600, n)).count() == 0
    assert draws.filter(drawn(F.col("d"), 600, 10)).count() == 1 << 16


def test_samples_keep_their_bound_with_a_hot_id(spark, monkeypatch):
    hot = next(i for i in range(100) if not spark.range(1).select(langid.held_out(F.lit(i)) | toxicity.held_out(F.lit(i))).first()[0])
    rows = [(hot if i % 3 == 0 else 1000 + i, f"wort{i} der die das und" if i % 2 else f"word{i} the of and to", "de" if i % 2 else "en", "s", 1) for i in range(3_000)]
    rows += [(hot, "the same text again", "en", "s", 1)] * 500
    docs = spark.createDataFrame(rows, DOCS)
    seen = {}
    fit_rows = langid.train
    monkeypatch.setattr(langid, "train", lambda windows, n, **k: seen.update(windows=len(windows)) or fit_rows(windows, n, rounds=1))
    assert langid.fit(docs, 100) is not None and 20 <= seen["windows"] <= 400
    labels = docs.select("doc_id").distinct().withColumn("toxic", F.pmod("doc_id", F.lit(2)))
    weights = toxicity.fit_weights
    monkeypatch.setattr(toxicity, "fit_weights", lambda own, counts, y, r: seen.update(rows=len(own)) or weights(own, counts, y, r, rounds=1))
    toxicity.fit(docs, labels.filter(F.col("doc_id") == hot).unionByName(labels.filter(F.col("doc_id") != hot)), 10_000)
    assert seen["rows"] <= 2_000 + toxicity.TEXTS_OF_ID


def ranges_of(spark, docs):
    """Rows of each range that ``with_next`` deals, halo rows left out."""
    rows = winnow.with_next(docs)
    assert rows.count() == docs.count()
    return rows.select(F.spark_partition_id().alias("p"), "next_text").groupBy("p").agg(F.count("next_text").alias("count")).collect()


def test_ids_that_begin_alike_are_dealt(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for ids in (F.format_string("doc-%09d", "id"), F.lit(None).cast("string"), F.lit(7)):
            docs = spark.range(20_000).select(ids.alias("doc_id") if ids is not None else "id", F.format_string("text %d", "id").alias("text"))
            if docs.schema["doc_id"].dataType.simpleString() == "string" and docs.first()["doc_id"] is None:
                docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
            sizes = [r["count"] for r in ranges_of(spark, docs)]
            assert len(sizes) > 20 and max(sizes) < 5_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_next_of_prefixed_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(winnow, "RANGE_ROWS", 16)
    names = [f"doc-{i:06}" for i in range(300)]
    got = {r["doc_id"]: r["next_text"] for r in winnow.with_next(spark.createDataFrame([(n, f"t {n}") for n in names], "doc_id string, text string")).collect()}
    assert got == {n: f"t {names[i - 1]}" for i, n in enumerate(names)}
    rows = [(i if i % 2 else None, f"t{i}") for i in range(400)]
    got = winnow.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    nexts = {r["text"]: r["next_text"] for r in got}
    assert len(nexts) == 400 and sorted(nexts.values()) == sorted(nexts)  # one ring over all rows
    at, seen = "t399", []
    for _ in range(400):
        seen.append(at)
        at = nexts[at]
    assert at == "t399" and seen[:200] == [f"t{i}" for i in range(399, 0, -2)] and len(set(seen)) == 400


def test_places_where_half_the_ids_are_null(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_ROWS", 64)
    rows = [(None if i % 2 else i, f"text {i}", None, "a" if i % 4 < 2 else "b", 1) for i in range(2_000)] + [(None, "same", None, "a", 1)] * 300 + [(None, "same", "x", "a", 1)] * 3
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.placed(docs, {"a": 1, "b": 1}, ["position", "slot"]).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    assert sorted((str(r["doc_id"]), r["text"], str(r["lang"]), r["source"]) for r in got) == sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in rows)
    done = {"a": 0, "b": 0}
    for r in sorted(got, key=lambda r: r["position"])[:1_900]:  # neither source ends before
        done[r["source"]] += 1
        assert abs(done["a"] - done["b"]) <= 2 * mixing.BLOCK_ROWS
    same = sorted(r["position"] for r in got if r["text"] == "same" and r["lang"] is None)
    assert len(same) == 300
