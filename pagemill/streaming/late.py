"""Late rows kept apart: a stream in two tables, what is on time and what comes behind the watermark."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _marks(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(batch, latest time in microseconds up to and with it) of the batches seen: a row a batch, of which the last two matter."""
    try:
        found = spark.read.json(path, "batch long, latest long").orderBy(F.desc("batch")).limit(2).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return sorted((r["batch"], r["latest"]) for r in found)


def with_late_rows(at: str, late_micros: int, on_time: str, late: str, marks: str) -> Callable[[DataFrame, int], None]:
    """What foreachBatch takes to part a stream: rows at or after the watermark go to `on_time`, others to `late`, each in folders by batch.

    The watermark of a batch is the latest time of all batches before it less late_micros, as Spark has it for its own
    operators, kept in `marks`. A batch that is run again overwrites its own folders and reads the mark of the batch
    before it, so each row is in one of the tables, once. Rows without a time are late.
    """

    def part(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [m for b, m in _marks(spark, marks) if b < number]
        held = batch.persist()
        try:
            time = F.unix_micros(F.col(at).cast("timestamp"))
            punctual = F.coalesce(time >= F.lit(before[-1] - late_micros), F.lit(False)) if before else time.isNotNull()
            for rows, path in ((held.where(punctual), on_time), (held.where(~punctual), late)):
                rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
            latest = held.agg(F.max(time)).first()[0]
            values = [v for v in (latest, before[-1] if before else None) if v is not None]
            if values:
                spark.createDataFrame([(json.dumps({"batch": number, "latest": max(values)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{marks}/mark={number}")
        finally:
            held.unpersist()

    return part


def part_stream(stream: DataFrame, at: str, late: timedelta, folder: str, checkpoint: str, **trigger):
    """A stream's rows on time and late under `folder` (on_time, late), told apart by a watermark `late` behind the latest time; starts and returns the query."""
    part = with_late_rows(at, late // timedelta(microseconds=1), f"{folder}/on_time", f"{folder}/late", f"{folder}/marks")
    return stream.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
