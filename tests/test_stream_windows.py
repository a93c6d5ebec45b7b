"""The streamed windows equal the batch aggregation over all events."""

import pytest

from tidemark.plans.queries import QUERIES
from tidemark.sources.projections import view
from tidemark.streaming import jobs


def test_stream_corroboration_has_every_window(spark, small):
    got = sorted(map(tuple, QUERIES["stream_corroboration"](spark, small).collect()))
    expected = sorted(map(tuple, jobs.corroboration(view(spark, small, "v_news")).collect()))
    assert got == expected and len({r[0] for r in got}) > 50


def test_batches_write_steps_and_not_windows(spark, small, tmp_path):
    """A hit is stored once, not for each of its 30 windows; three batches give what one does."""
    news = view(spark, small, "v_news")
    news.repartitionByRange(3, "doc_no").write.parquet(str(tmp_path / "news"))
    stream = spark.readStream.schema(news.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "news"))
    for length, slide in (("30 days", "1 day"), ("6 hours", "2 hours")):
        folder = str(tmp_path / slide)
        got = sorted(map(tuple, jobs.newest_corroboration(stream, folder, length=length, slide=slide).collect()))
        assert got == sorted(map(tuple, jobs.corroboration(news, length=length, slide=slide).collect()))
        assert spark.read.parquet(f"{folder}/*/batch=*").count() <= jobs.hits(news).count() < len(got)
    with pytest.raises(ValueError):
        jobs.newest_corroboration(stream, str(tmp_path / "odd"), length="3 days", slide="2 days")
