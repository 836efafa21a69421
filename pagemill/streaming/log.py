"""A message log over folders, as a data source for batches and streams: keyed messages in partitions, offsets, commits.

A topic is a folder. Tasks write segments, Parquet files of one partition each; a commit names the segments that count,
gives each its place in its partition, and remembers the last batch of each producer, so a batch that is committed
again changes nothing, and what a failed task has left is never read. A reader's offset is the number of commits it has
read. A topic has one committing producer at a time; readers are free.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "key string, value string, partition int, offset long"
PARTITIONS = 8
SEGMENT = pa.schema([("key", pa.string()), ("value", pa.string())])
#: Messages of a segment that are held before they are written.
MESSAGES_AT_ONCE = 10_000


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", uri))


@dataclass
class Segment(InputPartition):
    """Messages of a partition: the file they lie in, and the offset of the first."""

    path: str
    partition: int
    first: int
    count: int


@dataclass
class Written(WriterCommitMessage):
    segments: list[tuple[str, int, int]]  # path, partition, count


class Topic:
    """The commits of a topic's folder. Each states where partitions end, so the last tells where the next begins."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.store, self.base = file_system(self.path)

    def latest(self) -> int:
        """The number of commits. Looks for the last by doubling steps and bisection: commits are numbered without gaps."""
        lo, step = 0, 1
        while self._is(lo + step):
            lo, step = lo + step, step * 2
        hi = lo + step
        while hi - lo > 1:
            m = (lo + hi) // 2
            lo, hi = (m, hi) if self._is(m) else (lo, m)
        return lo

    def _name(self, n: int) -> str:
        return f"{self.base}/commits/{n:012d}.json"

    def _is(self, n: int) -> bool:
        return self.store.get_file_info(self._name(n)).type == pyarrow.fs.FileType.File

    def read(self, n: int) -> dict:
        with self.store.open_input_stream(self._name(n)) as f:
            return json.loads(f.read())

    def segments(self, start: int, end: int) -> list[Segment]:
        return [Segment(*s) for n in range(start + 1, end + 1) for s in self.read(n)["segments"]]

    def commit(self, written: list[Written], producer: str, batch: int | None) -> None:
        n = self.latest()
        before = self.read(n) if n else {"ends": {}, "producers": {}}
        if batch is not None and before["producers"].get(producer, -1) >= batch:
            return  # committed before a restart
        ends, found = dict(before["ends"]), []
        for path, partition, count in sorted(s for w in written if w for s in w.segments):
            first = ends.get(str(partition), 0)
            found.append([path, partition, first, count])
            ends[str(partition)] = first + count
        producers = before["producers"] | ({producer: batch} if batch is not None else {})
        self.store.create_dir(f"{self.base}/commits", recursive=True)
        draft = f"{self.base}/commits/{uuid.uuid4().hex}.draft"
        with self.store.open_output_stream(draft) as f:
            f.write(json.dumps({"segments": found, "ends": ends, "producers": producers}).encode())
        self.store.move(draft, self._name(n + 1))


class _Read:
    def __init__(self, topic: Topic):
        self.topic = topic

    def read(self, segment: Segment) -> Iterator[pa.RecordBatch]:
        store, base = file_system(segment.path)
        with store.open_input_file(base) as f:
            at = segment.first
            for batch in pq.ParquetFile(f).iter_batches(MESSAGES_AT_ONCE):
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([segment.partition] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], ["key", "value", "partition", "offset"])
                at += n


class LogReader(_Read, DataSourceReader):
    def partitions(self) -> list[Segment]:
        return self.topic.segments(0, self.topic.latest())


class LogStreamReader(_Read, DataSourceStreamReader):
    def __init__(self, topic: Topic, earliest: bool):
        super().__init__(topic)
        self.earliest = earliest

    def initialOffset(self) -> dict:
        return {"commits": 0 if self.earliest else self.topic.latest()}

    def latestOffset(self) -> dict:
        return {"commits": self.topic.latest()}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return self.topic.segments(start["commits"], end["commits"])


class _Write:
    def __init__(self, topic: Topic, partitions: int, producer: str):
        self.topic, self.number, self.producer = topic, partitions, producer

    def write(self, rows: Iterator) -> Written:
        """Messages of each partition in the order in which they come."""
        store, base = self.topic.store, self.topic.base
        store.create_dir(f"{base}/segments", recursive=True)
        open_, held = {}, {}

        def flush(p: int) -> None:
            keys, values = zip(*held.pop(p), strict=True)
            if p not in open_:
                name = f"{p:05d}-{uuid.uuid4().hex}.parquet"
                open_[p] = [f"{self.topic.path}/segments/{name}", pq.ParquetWriter(f"{base}/segments/{name}", SEGMENT, filesystem=store), 0]
            open_[p][1].write_table(pa.table([pa.array(keys, pa.string()), pa.array(values, pa.string())], schema=SEGMENT))
            open_[p][2] += len(keys)

        for row in rows:
            mine = held.setdefault(row["partition"], [])
            mine.append((row["key"], row["value"]))
            if len(mine) >= MESSAGES_AT_ONCE:
                flush(row["partition"])
        for p in list(held):
            flush(p)
        for _, writer, _ in open_.values():
            writer.close()
        return Written([(path, p, n) for p, (path, _, n) in open_.items()])


class LogWriter(_Write, DataSourceWriter):
    def commit(self, messages: list[Written]) -> None:
        self.topic.commit(messages, self.producer, None)

    def abort(self, messages: list[Written]) -> None:
        """Segments without a commit are never read."""


class LogStreamWriter(_Write, DataSourceStreamWriter):
    def commit(self, messages: list[Written], batchId: int) -> None:
        self.topic.commit(messages, self.producer, batchId)

    def abort(self, messages: list[Written], batchId: int) -> None:
        """Segments without a commit are never read; the batch is written anew."""


class MessageLog(DataSource):
    """spark.read / readStream / write / writeStream of format "message_log". Options: path, partitions, producer, startingOffsets (earliest or latest)."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return SCHEMA

    def _topic(self) -> Topic:
        return Topic(self.options["path"])

    def reader(self, schema) -> LogReader:
        return LogReader(self._topic())

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self._topic(), self.options.get("startingoffsets", "earliest") == "earliest")

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self._topic(), int(self.options.get("partitions", PARTITIONS)), self.options.get("producer", "batch"))

    def streamWriter(self, schema, overwrite: bool) -> LogStreamWriter:
        return LogStreamWriter(self._topic(), int(self.options.get("partitions", PARTITIONS)), self.options.get("producer", "stream"))


def use(spark: SparkSession) -> None:
    spark.dataSource.register(MessageLog)


def dealt(messages: DataFrame, partitions: int = PARTITIONS, order: list[str] | None = None) -> DataFrame:
    """key, value and partition, as the log takes them: a key's messages in one task, in the order of some columns if asked for."""
    placed = messages.withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))
    placed = placed.repartition(partitions, "partition")
    if order and messages.isStreaming:  # a task's share of a micro-batch is sorted in the task

        def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = list(batches)
            if held:
                yield pd.concat(held).sort_values(["partition", *order], kind="stable", ignore_index=True)

        placed = placed.mapInPandas(in_order, placed.schema)
    elif order:
        placed = placed.sortWithinPartitions("partition", *order)
    return placed.select("key", "value", "partition", F.lit(None).cast("long").alias("offset"))


def send(messages: DataFrame, path: str, partitions: int = PARTITIONS, order: list[str] | None = None) -> None:
    """Append a table of key and value (keyed_messages()) to a topic."""
    use(messages.sparkSession)
    dealt(messages, partitions, order).write.format("message_log").option("path", path).mode("append").save()


def send_stream(messages: DataFrame, path: str, checkpoint: str, partitions: int = PARTITIONS, producer: str | None = None, order: list[str] | None = None, **trigger):
    """Append a stream of key and value to a topic, each message once whatever restarts; starts and returns the query.

    producer names the sender (default: its checkpoint); a batch that it has committed is not committed again.
    """
    use(messages.sparkSession)
    writer = dealt(messages, partitions, order).writeStream.format("message_log").option("path", path).option("producer", producer or checkpoint)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def received(spark: SparkSession, path: str, stream: bool = True, starting: str = "earliest") -> DataFrame:
    """key, value, partition and offset of a topic's messages, as a stream or as a table."""
    use(spark)
    reader = (spark.readStream if stream else spark.read).format("message_log").option("path", path).option("startingOffsets", starting)
    return reader.load()
