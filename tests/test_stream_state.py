"""Streams with state: replays, timers, expiry, the message log, late rows. Each against the batch or a loop."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from pagemill import streaming as S
from pagemill.operators import state
from pagemill.streaming import late, log, machines

PATH = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def outcomes(spark, tmp_path_factory):
    """The events in nine files in the order of time, and the rows as a table."""
    folder = str(tmp_path_factory.mktemp("outcomes"))
    bad = F.col("event_type").isin("error", "view")
    df = spark.read.parquet(f"{PATH}/events.parquet").select((F.col("user_id") % 7).alias("k"), F.col("ts").cast("timestamp").alias("ts"), "event_id", bad.alias("failed"), (~bad).alias("ok"), (F.col("event_type") == "error").alias("blocked"))
    rows = df.orderBy("ts", "event_id").collect()
    for i in range(9):  # neighbours in time are shuffled over three files
        part = [r for j, r in enumerate(rows) if j * 9 // len(rows) // 3 == i // 3 and j % 3 == i % 3]
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{folder}/{i}")
        time.sleep(0.01)
    return f"{folder}/*", df


def all_of(query, checkpoint, **trigger):
    """All rows that a stream gives now; a run that does not end fails."""
    out = []
    running = query.writeStream.foreachBatch(lambda batch, _: out.extend(batch.collect())).option("checkpointLocation", str(checkpoint)).trigger(**(trigger or {"availableNow": True})).start()
    try:
        assert running.awaitTermination(60)
    finally:
        running.stop()
    return out


def test_replays_of_a_stream_are_those_of_the_table(spark, outcomes, tmp_path):
    path, df = outcomes
    kind = "k long, ts timestamp, event_id long, failed boolean, ok boolean, blocked boolean"
    make = lambda: S.file_stream(spark, path, kind, files_per_trigger=2)
    got = all_of(machines.breaker_stream(make(), "k", "ts", ["event_id"], "failed", recovery=3600.0, late="12 days"), tmp_path / "b")
    want = {(r.k, r.event_id): (r.allowed, r.state, r.failures) for r in state.circuit_breaker(df, "k", "ts", ["event_id"], "failed", recovery=3600.0).collect()}
    assert len({(r.k, r.event_id) for r in got}) == len(got) and all(want[r.k, r.event_id] == (r.allowed, r.state, r.failures) for r in got)
    assert 0.2 * df.count() < len(got) < df.count()  # the watermark has not passed the last days
    got = all_of(machines.tier_stream(make(), "k", "ts", ["event_id"], "ok", "blocked", late="12 days"), tmp_path / "t")
    want = {(r.k, r.event_id): (r.tier, r.circuit_open, r.failures, r.success_rate) for r in state.domain_tiers(df, "k", "ts", ["event_id"], "ok", "blocked").collect()}
    assert len(got) > 0.2 * df.count() and all(want[r.k, r.event_id] == (r.tier, r.circuit_open, r.failures, r.success_rate) for r in got)


def feed(spark, folder, i, rows):
    spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), n, f) for k, s, n, f in rows], "k string, ts timestamp, n long, failed boolean").coalesce(1).write.parquet(f"{folder}/{i}")


def test_half_open_is_announced_and_idle_keys_start_anew(spark, tmp_path):
    folder, kind = str(tmp_path / "in"), "k string, ts timestamp, n long, failed boolean"
    make = lambda: machines.breaker_stream(S.file_stream(spark, f"{folder}/*", kind), "k", "ts", ["n"], "failed", threshold=2, recovery=30.0, late="0 seconds", announce=True, idle=500.0)
    feed(spark, folder, 0, [("a", 0, 1, True), ("a", 1, 2, True), ("b", 0, 3, True), ("z", 5, 4, False)])
    first = all_of(make(), tmp_path / "cp")
    assert {(r.n, r.state) for r in first} == {(1, "closed"), (2, "open"), (3, "closed"), (4, "closed")}
    feed(spark, folder, 1, [("z", 100, 5, False)])  # the watermark passes 31 s
    second = all_of(make(), tmp_path / "cp")
    assert {(r.k, r.n, r.state) for r in second} == {("a", None, "half_open"), ("z", 5, "closed")}
    feed(spark, folder, 2, [("z", 2000, 6, False)])
    all_of(make(), tmp_path / "cp")
    feed(spark, folder, 3, [("b", 2001, 7, True), ("z", 2100, 8, False)])  # a second failure, but the first is forgotten
    last = all_of(make(), tmp_path / "cp")
    assert {(r.k, r.n, r.state, r.failures) for r in last} == {("b", 7, "closed", 1), ("z", 8, "closed", 0)}


def test_values_expire(spark, tmp_path):
    folder = str(tmp_path / "in")
    put = lambda i, rows: spark.createDataFrame(rows, "k string, v string, n long").coalesce(1).write.parquet(f"{folder}/{i}")
    make = lambda: machines.kept_values(S.file_stream(spark, f"{folder}/*", "k string, v string, n long"), "k", "v", "n", 4.0)
    put(0, [("a", "token", 1), ("b", None, 2)])
    assert [tuple(r) for r in all_of(make(), tmp_path / "cp", once=True)] == [("b", 2, None)]
    put(1, [("b", "other", 3)])
    all_of(make(), tmp_path / "cp", once=True)
    time.sleep(5)
    put(2, [("a", None, 4), ("b", "new", 5), ("b", None, 6)])
    assert sorted(tuple(r) for r in all_of(make(), tmp_path / "cp", once=True)) == [("a", 4, None), ("b", 6, "new")]


def test_a_log_loses_and_repeats_nothing_over_restarts(spark, tmp_path):
    topic, folder = str(tmp_path / "topic"), str(tmp_path / "in")
    sent = []

    def put(i, n):
        rows = [(f"k{j % 5}", i * 100 + j) for j in range(n)]
        sent.extend(rows)
        spark.createDataFrame(rows, "job_id string, n long").coalesce(1).write.parquet(f"{folder}/{i}")

    def run():
        stream = S.file_stream(spark, f"{folder}/*", "job_id string, n long", files_per_trigger=1)
        keyed = S.keyed_messages(stream).withColumn("n", F.get_json_object("value", "$.n").cast("long"))
        log.send_stream(keyed, topic, str(tmp_path / "out"), partitions=3, order=["n"]).awaitTermination()

    put(0, 20)
    run()
    reader = lambda: all_of(log.received(spark, topic), tmp_path / "cp")
    first = reader()
    put(1, 30)
    put(2, 7)
    run()
    run()  # nothing new
    second = reader()
    assert reader() == []
    got = [(r.key, json.loads(r.value)["n"]) for r in first + second]
    assert sorted(got) == sorted(sent)
    for k in {k for k, _ in sent}:  # one partition, in order
        own = sorted((r.offset, r.partition, json.loads(r.value)["n"]) for r in first + second if r.key == k)
        assert [n for *_, n in own] == [n for kk, n in sent if kk == k] and len({p for _, p, _ in own}) == 1
    for p in {r.partition for r in first + second}:
        assert sorted(r.offset for r in first + second if r.partition == p) == list(range(sum(r.partition == p for r in first + second)))
    table = log.received(spark, topic, stream=False)
    assert table.count() == len(sent) and table.select("partition", "offset").distinct().count() == len(sent)


def test_a_batch_that_is_committed_again_counts_once(tmp_path):
    topic = log.Topic(str(tmp_path))
    rows = [{"key": "a", "value": str(i), "partition": i % 2, "offset": None} for i in range(5)]
    writer = log.LogStreamWriter(topic, 2, "p")
    lost = writer.write(iter(rows))  # a task that failed after it wrote
    kept = writer.write(iter(rows))
    writer.commit([kept], 0)
    writer.commit([lost], 0)  # the same batch after a restart
    writer.commit([writer.write(iter(rows[:1])), None], 1)
    assert topic.latest() == 2 and topic.read(2)["ends"] == {"0": 4, "1": 2}
    assert [(s.partition, s.first, s.count) for s in topic.segments(0, 2)] == [(0, 0, 3), (1, 0, 2), (0, 3, 1)]
    reader = log.LogStreamReader(topic, True)
    assert reader.initialOffset() == {"commits": 0} and reader.latestOffset() == {"commits": 2}
    found = [v for s in reader.partitions({"commits": 1}, {"commits": 2}) for b in reader.read(s) for v in b.to_pylist()]
    assert found == [{"key": "a", "value": "0", "partition": 0, "offset": 3}]
    assert log.LogStreamReader(topic, False).initialOffset() == {"commits": 2}


def test_batches_appended_to_a_log(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i % 4}", str(i)) for i in range(40)], "key string, value string")
    for _ in range(2):
        log.send(rows, str(tmp_path), partitions=2, order=["value"])
    got = log.received(spark, str(tmp_path), stream=False).collect()
    assert len(got) == 80 and {(r.partition, r.offset) for r in got} == {(r.partition, i) for r in got for i in range(sum(x.partition == r.partition for x in got))}
    log.send(rows.limit(0), str(tmp_path), partitions=2)
    assert log.received(spark, str(tmp_path), stream=False).count() == 80


def test_rows_on_time_and_late_are_all_rows(spark, tmp_path):
    events = spark.read.parquet(f"{PATH}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.collect()
    random.Random(3).shuffle(rows)
    folder = str(tmp_path / "in")
    for i in range(4):
        spark.createDataFrame(rows[i::4], events.schema).coalesce(1).write.parquet(f"{folder}/{i}")
        time.sleep(1.1)  # files are taken in the order of their times
    stream = S.file_stream(spark, f"{folder}/*", S.EVENT_ROWS.replace("timestamp_ntz", "timestamp"), files_per_trigger=1)
    late.part_stream(stream, "ts", dt.timedelta(days=10), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    on_time, behind = (spark.read.parquet(str(tmp_path / "out" / n)) for n in ("on_time", "late"))
    mark, want = None, set()
    for i in range(4):
        want |= {r.event_id for r in rows[i::4] if mark is not None and r.ts < mark - dt.timedelta(days=10)}
        mark = max([r.ts for r in rows[i::4]] + ([mark] if mark else []))
    assert {r.event_id for r in behind.collect()} == want and 0 < len(want) < len(rows)
    assert sorted(r.event_id for r in on_time.union(behind).collect()) == sorted(r.event_id for r in rows)
    # A batch that is run again after it was written changes nothing.
    part = late.with_late_rows("ts", 10 * 86_400_000_000, *(str(tmp_path / "out" / n) for n in ("on_time", "late", "marks")))
    part(spark.createDataFrame(rows[3::4], events.schema), 3)
    assert spark.read.parquet(str(tmp_path / "out" / "late")).count() == len(want) and spark.read.parquet(str(tmp_path / "out" / "on_time")).count() == len(rows) - len(want)
