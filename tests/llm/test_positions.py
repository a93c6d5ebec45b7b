"""The mixed order in the pipeline's result."""

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_last_stage_gives_positions_by_weight(spark):
    rows = [(i, f"text {i}", None, s, 1) for i, s in enumerate(["src0"] * 700 + ["src1"] * 170 + ["src2"] * 170)]
    rows += [(None, "one", None, "src0", 3), (None, "two", None, "src1", 3), (5, "another five", None, "src1", 12)]
    docs = spark.createDataFrame(rows, DOCS)
    result = corpus_pipeline.token_stage(spark, corpus_pipeline.mixing_stage(spark, docs, ""), "").cache()
    assert sorted(r["position"] for r in result.collect()) == list(range(len(rows)))
    assert sorted((r["doc_id"] for r in result.collect()), key=str) == sorted((r[0] for r in rows), key=str)
    source = {r[0]: r[3] for r in rows}
    slots = {r["slot"]: source[r["doc_id"]] for r in result.collect() if r["doc_id"] not in (None, 5)}
    done = {"src0": 0, "src1": 0, "src2": 0}
    for t in range(40):  # weights 20, 5, 5; no source ends before
        done[slots[t]] += 1
        assert all(abs(n - (t + 1) * {"src0": 20}.get(s, 5) / 30) < 1 for s, n in done.items())
    again = corpus_pipeline.token_stage(spark, docs.repartition(3, "n_chars", "text"), "")
    assert sorted((r["position"], str(r["ids"])) for r in again.collect()) == sorted((r["position"], str(r["ids"])) for r in result.collect())
