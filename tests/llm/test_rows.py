"""Which rows stay when ids are null or repeated."""

import corpus_pipeline
import pytest

from tidemark.llm import quality, similar, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "a", len(t or "")) for i, t in rows], DOCS)


@pytest.mark.parametrize("stage", [simhash.keep_one, lambda d: simhash.keep_least(d, similar.classes(d))])
def test_rows_without_an_id_of_their_own_stay_apart(spark, stage):
    own = lambda k: " ".join(f"own{k}x{i}" for i in range(80))
    rows = [(None, own(1)), (None, own(2)), (None, own(2)), (7, own(3)), (7, own(4)), (8, own(4)), (9, own(1)), (None, None)]
    got = sorted(((r["doc_id"], r["text"]) for r in stage(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(9, own(1)), (None, own(2)), (7, own(3)), (7, own(4)), (None, None)], key=str)
    assert stage(frame(spark, rows).limit(0)).count() == 0


def test_rejected_row_leaves_others_of_its_id(spark):
    good = lambda k: " ".join(f"own{k}x{i}" for i in range(80))
    rows = [(None, good(1)), (None, "bad"), (None, good(2)), (3, "bad"), (3, good(3))]
    got = sorted((r["text"] for r in quality.keep_good(frame(spark, rows)).collect()))
    assert got == [good(1), good(2), good(3)]


def test_quality_stage_removes_shared_lines(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))  # noqa: E731  digits count as equal in lines
    own = lambda i: " ".join(f"own{name(i)}x{name(k)}" for k in range(200))
    menu = "home about contact imprint"
    rows = [(i if i else None, f"{own(i)}\n{menu}\n{own(500 + i)}", None, "h", 0) for i in range(30)]
    rows += [(40, f"{own(40)}\n{menu}", None, "other", 7), (41, "bad", None, "h", 3), (None, own(42), None, "h", 9), (1, own(43), None, None, 9)]
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in corpus_pipeline.quality_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    expected = {(i if i else None, t := f"{own(i)}\n{own(500 + i)}", len(t)) for i in range(30)}
    assert got == expected | {(40, f"{own(40)}\n{menu}", 7), (None, own(42), 9), (1, own(43), 9)}


HELPERS = ("_k", "_id", "_c", "_spans", "_own", "_hits", "_content", "_gone", "_kept", "_out", "_cuts", "_position", "content", "words", "host", "line", "pos", "n", "key", "hit", "fp", "root", "base", "added", "node", "kind", "start", "end", "slot", "mix_source", "rows", "n_words", "kept", "ID", "_ID")


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:4]])
def test_columns_of_any_name_stay(spark, stage):
    """Each helper name as a caller's column keeps its values."""
    from pyspark.sql import functions as F

    text = lambda k: " ".join(f"own{k}x{i}" for i in range(80)) + f" mail a{k}@b.org now"
    plain = frame(spark, [(k, text(k)) for k in range(6)] + [(None, text(9))])
    own = plain.withColumns({f"{h}" if h not in ("ID",) else "ID": F.concat(F.lit(h), F.coalesce("doc_id", F.lit(-1)).cast("string")) for h in HELPERS if h != "_ID"})
    got = stage(spark, own, "")
    assert got.columns == own.columns
    rows = got.collect()
    assert len(rows) == 7 and all(r[h] == f"{h}{-1 if r['doc_id'] is None else r['doc_id']}" for r in rows for h in HELPERS if h != "_ID")
