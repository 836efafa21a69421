"""Streams of events: parsing, windows, sessions, duplicates, and replays with state.

Every function takes a batch or a stream of rows, so the same query runs over either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CRAWL_RESULT = "job_id string, url string, success boolean, status_code int, raw_html_ref string, error string, elapsed_ms int, timestamp timestamp"
EXTRACTION = (
    "job_id string, success boolean, extracted_data string, result_ref string, error string, extraction_method string, model_used string, "
    "tokens_input int, tokens_output int, estimated_cost_usd double, confidence double, timestamp timestamp"
)
CRAWL_REQUEST = "job_id string, url string, priority string, max_retries int, metadata string, timestamp timestamp"
EXTRACTION_REQUEST = "job_id string, url string, raw_html_ref string, extraction_schema string, timestamp timestamp"
EVENTS = {"crawl.requests": CRAWL_REQUEST, "crawl.results": CRAWL_RESULT, "extraction.requests": EXTRACTION_REQUEST, "extraction.results": EXTRACTION}
EVENT_ROWS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """New files of a folder (or glob) as a stream."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_trigger).load(path)


def topic_stream(spark: SparkSession, servers: str, topics: str, starting: str = "earliest") -> DataFrame:
    """A message log's topics as a stream of key and value; needs Spark's connector for it on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", starting)
    return reader.load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", "timestamp")


def malformed(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """The lines that messages() leaves out, to be counted or kept."""
    parsed = F.from_json(F.col(value).cast("string"), schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.where(parsed.isNull() | parsed["_corrupt"].isNotNull())


def messages(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """JSON messages as columns; malformed ones are left out (malformed() has them)."""
    parsed = F.from_json(F.col(value).cast("string"), schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(parsed.alias("m")).where(F.col("m").isNotNull() & F.col("m._corrupt").isNull()).select("m.*").drop("_corrupt")


def keyed_messages(rows: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows as key and JSON value, the form a log sink takes; one key's rows stay in order in one partition."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def timed(rows: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """at as a timestamp with a time zone, and a watermark on it if rows are a stream."""
    rows = rows.withColumn(at, F.col(at).cast("timestamp"))
    return rows.withWatermark(at, late) if rows.isStreaming else rows


def windowed(rows: DataFrame, by: list[str], value: str, width: str, slide: str | None = None, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling (or sliding) windows: start, *by, n, total."""
    out = timed(rows, at, late).groupBy(F.window(at, width, slide) if slide else F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(rows: DataFrame, key: str, gap: str = "30 minutes", at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events with no gap: key, start, end, n."""
    out = timed(rows, at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(rows: DataFrame, keys: list[str], at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows whose keys were not seen within the time that stragglers may take; in a batch, one row of each keys."""
    rows = timed(rows, at, late)
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def failures_in_a_row(rows: DataFrame, key: str, failed: str, order: str, idle: int | None = None) -> DataFrame:
    """A stream's longest and current run of failures of each key, updated as rows come. State: two numbers a key.

    Of a micro-batch a key's rows are held as two arrays, its order and its outcomes, and runs are told apart by array
    operations. idle: keys without rows for so long (in milliseconds of processing time) are forgotten and start anew.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        longest, current = state.get if state.exists else (0, 0)
        parts = [(b[order].to_numpy(), b[failed].to_numpy(dtype=bool)) for b in batches]
        bad = np.concatenate([f for _, f in parts])[np.argsort(np.concatenate([o for o, _ in parts]), kind="stable")]
        stops = np.flatnonzero(~bad)  # successes; a run is what lies between two
        runs = np.diff(np.concatenate(([-1 - current], stops, [len(bad)]))) - 1
        longest, current = max(longest, int(runs.max())), int(runs[-1])
        state.update((longest, current))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({key: [k[0]], "longest": [longest], "current": [current]})

    kind = rows.schema[key].dataType.simpleString()
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return rows.select(key, failed, order).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, longest int, current int", "longest int, current int", "update", timeout)


def attempts_of_jobs(jobs: DataFrame, attempts: DataFrame, key: str = "job_id", at: str = "ts", wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Each job with its attempts that come within `wait` of it, from two streams (or two tables): key, job_at, attempt_at and the other columns.

    Both sides are kept no longer than the wait and their watermarks need. A job without an attempt is told once none can come any more.
    """
    left = timed(jobs, at, late).withColumnRenamed(at, "job_at")
    right = timed(attempts, at, late).select(F.col(key).alias("__key"), F.col(at).alias("attempt_at"), *[c for c in attempts.columns if c not in (key, at)])
    near = (F.col(key) == F.col("__key")) & (F.col("attempt_at") >= F.col("job_at")) & (F.col("attempt_at") <= F.col("job_at") + F.expr(f"INTERVAL {wait}"))
    return left.join(right, near, "left").drop("__key")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, gathered in a table in memory: for tests and small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def write_stream(stream: DataFrame, path: str, checkpoint: str, by: list[str] | None = None, every: str | None = None):
    """A stream into a parquet table, in folders by some columns; starts and returns the query. every: a trigger by processing time ("30 seconds")."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.partitionBy(*by) if by else writer
    return (writer.trigger(processingTime=every) if every else writer).start()


def write_topic(stream: DataFrame, servers: str, topic: str, checkpoint: str, every: str | None = None):
    """keyed_messages() of a stream into a topic; needs Spark's connector for the message log. Acknowledged by all replicas, duplicates suppressed."""
    writer = stream.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)
    writer = writer.option("kafka.acks", "all").option("kafka.enable.idempotence", "true")
    return (writer.trigger(processingTime=every) if every else writer).start()
