"""State machines over streams: replays in the order of time, announcements by timers, values that expire.

The machines are those of operators.state, so a stream's rows get what the batch replay of the same log gives them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import Breaker, Machine, Tiers

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_rocks(spark: SparkSession) -> None:
    """The state store that lists, timers and expiry need, for queries that start from now on."""
    spark.conf.set(PROVIDER, ROCKS)


class _Replay(StatefulProcessor):
    """A key's rows wait until the watermark has passed them, then move the machine in the order of (time, order)."""

    def __init__(self, machine: Machine, key: str, order: list[str], columns: list[str], announce: float | None, idle: float | None):
        self.machine, self.key, self.order, self.columns, self.announce, self.idle = machine, key, order, columns, announce, idle
        self.inputs = [*dict.fromkeys([key, *order, *columns]), "__event", "__at"]
        self.names = [c.strip().split()[0] for c in machine.schema.split(",")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "state string, at double")
        self.waiting = handle.getListState("waiting", "at double, place string, moves string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        latest = None
        for batch in rows:
            batch.columns = self.inputs  # Spark passes names that are no identifiers by number
            moves = batch[self.columns].astype(object).where(batch[self.columns].notna(), None).itertuples(index=False, name=None)
            places = batch[self.order].astype(object).where(batch[self.order].notna(), None).itertuples(index=False, name=None)
            found = [(float(t), json.dumps(p, default=str), json.dumps(m)) for t, p, m in zip(batch["__at"], places, moves, strict=True)]
            self.waiting.appendList(found)
            latest = max([t for t, *_ in found], default=latest) if latest is None else max([latest, *(t for t, *_ in found)])
        if latest is not None:
            self.handle.registerTimer(math.ceil(latest * 1000))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        known = self.state.get() if self.state.exists() else None
        state, last = (json.loads(known[0]), known[1]) if known else (self.machine.start(), -math.inf)
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted(((r[0], json.loads(r[1]), json.loads(r[2])) for r in rows if r[0] <= now), key=lambda r: (r[0], r[1]))
        out = []
        for t, place, moves in ready:
            if self.idle is not None and t - last >= self.idle:
                state = self.machine.start()
            out.append((key[0], *place, *self.machine.step(state, t, tuple(moves))))
            last = t
        if self.announce is not None and not ready and state[1] is not None and now >= state[1] + self.announce > last:
            out.append((key[0], *[None] * len(self.order), None, "half_open", state[0]))
        if self.idle is not None and now - last >= self.idle and len(ready) == len(rows):
            self.state.clear()
            self.waiting.clear()
        else:
            self.state.update((json.dumps(state), last))
            if ready:
                self.waiting.clear()
                rest = [tuple(r) for r in rows if r[0] > now]
                if rest:
                    self.waiting.put(rest)
                if self.idle is not None:
                    self.handle.registerTimer(math.ceil((last + self.idle) * 1000))
                if self.announce is not None and state[1] is not None:
                    self.handle.registerTimer(math.ceil((state[1] + self.announce) * 1000))
        if out:
            yield pd.DataFrame(out, columns=[self.key, *self.order, *self.names])

    def close(self) -> None:
        pass


def replayed(rows: DataFrame, key: str, at: str, order: list[str], columns: list[str], machine: Machine, late: str = "10 minutes", announce: float | None = None, idle: float | None = None) -> DataFrame:
    """The replay of a stream: what operators.state.replay() gives for a table, as the watermark passes the rows.

    Rows later than `late` are dropped as by any operator with a watermark (with_late_rows() keeps them). announce: so many
    seconds after a breaker opened a row without order says that it is half open, if nothing has come since. idle: a
    key without rows for so many seconds is forgotten, and starts anew. State: the machine's few numbers and the rows
    that the watermark has not passed yet.
    """
    with_rocks(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ready = rows.withColumn("__event", F.col(at).cast("timestamp")).withWatermark("__event", late)
    ready = ready.select(*dict.fromkeys([key, *order, *columns]), "__event", (F.unix_micros("__event") / 1e6).alias("__at"))
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in [key, *order]) + ", " + machine.schema
    return ready.groupBy(key).transformWithStateInPandas(_Replay(machine, key, order, columns, announce, idle), schema, "Append", "EventTime")


def breaker_stream(rows: DataFrame, key: str, at: str, order: list[str], failed: str, threshold: int = 5, recovery: float = 30.0, late: str = "10 minutes", announce: bool = False, idle: float | None = None) -> DataFrame:
    """operators.state.circuit_breaker() over a stream; announce: also tell when an open breaker is ready for a trial."""
    return replayed(rows, key, at, order, [failed], Breaker(threshold, recovery), late, recovery if announce else None, idle)


def tier_stream(rows: DataFrame, key: str, at: str, order: list[str], ok: str, blocked: str, top: int = 2, threshold: int = 5, rest: float = 60.0, late: str = "10 minutes", idle: float | None = None) -> DataFrame:
    """operators.state.domain_tiers() over a stream."""
    return replayed(rows, key, at, order, [ok, blocked], Tiers(top, threshold, rest), late, None, idle)


class _Kept(StatefulProcessor):
    def __init__(self, key: str, value: str, seconds: float):
        self.key, self.value, self.seconds = key, value, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "value string", int(self.seconds * 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = []
        for batch in rows:
            batch.columns = [self.key, self.value, "__order"]
            for order, value in zip(batch["__order"], batch[self.value], strict=True):
                if pd.isna(value):
                    out.append((key[0], order, self.kept.get()[0] if self.kept.exists() else None))
                else:
                    self.kept.update((value,))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "asked", "value"])

    def close(self) -> None:
        pass


def kept_values(rows: DataFrame, key: str, value: str, asked: str, seconds: float) -> DataFrame:
    """A store of values that expire: a row with a value keeps it for its key; a row without one asks: key, asked, value (null if none or expired).

    Values go `seconds` of processing time after they were last written; Spark removes them from the state itself. Such a
    query runs until it is stopped, or one batch with trigger(once=True): with availableNow it would wait for expiries for ever.
    """
    with_rocks(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ready = rows.select(key, F.col(value).cast("string").alias(value), F.col(asked).alias("__order"))
    return ready.groupBy(key).transformWithStateInPandas(_Kept(key, value, seconds), f"`{key}` {kinds[key]}, asked {kinds[asked]}, value string", "Append", "ProcessingTime")
