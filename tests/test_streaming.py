"""A stream gives what the batch gives."""

import pytest
from pyspark.sql import functions as F

from pagemill import streaming as S

PATH = "/root/testdata/sf0.001"


@pytest.fixture()
def stream(spark):
    return S.file_stream(spark, f"{PATH}/events*.parquet", S.EVENT_ROWS)


@pytest.fixture()
def batch(spark):
    return spark.read.parquet(f"{PATH}/events.parquet")


def rows(df):
    return sorted(map(str, df.collect()))


def test_windows(spark, stream, batch, tmp_path):
    make = lambda df: S.windowed(df, ["event_type"], "value", "1 hour").withColumn("total", F.round("total", 6))
    assert rows(S.run_once(make(stream), "w1", str(tmp_path), "complete")) == rows(make(batch))


def test_append_holds_back_the_open_tail(spark, stream, batch, tmp_path):
    closed = S.run_once(S.windowed(stream, ["event_type"], "value", "1 hour"), "w2", str(tmp_path)).agg(F.sum("n")).first()[0]
    assert 0.9 * batch.count() < closed < batch.count()


def test_sessions_and_duplicates(spark, stream, batch, tmp_path):
    assert rows(S.run_once(S.sessions(stream, "user_id"), "s1", str(tmp_path / "a"), "complete")) == rows(S.sessions(batch, "user_id"))
    twice = stream.union(stream)
    assert S.run_once(S.once(twice, ["event_id"]), "s2", str(tmp_path / "b")).count() == batch.count()


def test_stateful_streaks(spark, stream, batch, tmp_path):
    from pagemill.operators import telemetry

    failed = F.col("event_type").isin("error", "view")
    out = S.failures_in_a_row(stream.withColumn("failed", failed), "user_id", "failed", "event_id")
    got = {(r.user_id, r.longest, r.current) for r in S.run_once(out, "st", str(tmp_path), "update").collect()}
    assert got == {(r.user_id, r.longest, r.current) for r in telemetry.streaks(batch, "user_id", failed, ["event_id"]).collect()}


def test_messages_skip_what_is_malformed(spark, tmp_path):
    lines = spark.createDataFrame([('{"job_id": "1", "success": true, "elapsed_ms": 5}',), ("{broken",), (None,)], "value string")
    got = S.messages(lines, S.CRAWL_RESULT)
    assert [(r.job_id, r.success, r.elapsed_ms, r.url) for r in got.collect()] == [("1", True, 5, None)]
    assert S.keyed_messages(got).first().key == "1"


def test_sink(spark, stream, batch, tmp_path):
    query = S.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["event_type"])
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_stream_stream_join_gives_what_the_batch_gives(spark, stream, batch, tmp_path):
    side = lambda df, kind: df.where(F.col("event_type") == kind).select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias(f"{kind}_id"))
    joined = lambda df: S.attempts_of_jobs(side(df, "view"), side(df, "click"), wait="6 hours")
    got = S.run_once(joined(stream), "ss", str(tmp_path)).collect()
    want = joined(batch).collect()
    paired = lambda found: sorted((r.view_id, r.click_id) for r in found if r.click_id is not None)
    assert paired(got) == paired(want) and len(paired(want)) > 0
    assert {r.view_id for r in got if r.click_id is None} <= {r.view_id for r in want if r.click_id is None}


def test_malformed_lines_are_kept_apart(spark):
    lines = spark.createDataFrame([('{"job_id": "a"}',), ("{bad",), (None,), ("[]",)], "value string")
    good, bad = S.messages(lines, S.CRAWL_RESULT), S.malformed(lines, S.CRAWL_RESULT)
    assert good.count() + bad.count() == 4 and good.first().job_id == "a"


def test_processing_time_trigger(spark, stream, tmp_path):
    q = S.write_stream(stream.select("event_id", "event_type"), str(tmp_path / "out"), str(tmp_path / "cp"), ["event_type"], every="1 second")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{PATH}/events.parquet").count()
