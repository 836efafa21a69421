"""Ordered replays of logged outcomes: breakers, tiers, token buckets. Each key's log is folded in the order of time.

Breakers and tiers are replayed over ranges of time, so one key's log is many tasks. What a range does to the state it
meets is a function with few cases, because a success forgets most of the past; each task sums up its range as such a
function, the functions of a key's ranges are applied one after another, which gives the state at the start of each
range, and then all ranges are replayed side by side.

A token bucket keeps its level exactly as it was added up, which no function of few cases does; it is a fold that streams
a key's rows through one task and keeps two numbers.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import materialised

CLOSED, OPEN = "closed", "open"


def fold(rows: DataFrame, key: str, at: str, order: list[str], columns: list[str], schema: str, start: Callable[[], dict], step: Callable[[dict, float, tuple], tuple]) -> DataFrame:
    """key, *order and what step(state, seconds, values) returns for every row, in the order of (at, *order) within each key; null is a key of its own."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [key, *order]
    out_names = [p.strip().split()[0] for p in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current = start(), object()
        for batch in batches:
            out = []
            rows = batch[columns].itertuples(index=False, name=None) if columns else [()] * len(batch)
            for k, t, values in zip(batch["__key"], batch["__at"], rows, strict=True):
                if k != current:
                    state, current = start(), k
                out.append(step(state, t, values))
            yield pd.concat([batch[names], pd.DataFrame(out, columns=out_names)], axis=1)

    ready = rows.select(*dict.fromkeys([*names, *columns]), F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("__key"), F.unix_micros(F.col(at).cast("timestamp")).alias("__us"))
    ready = ready.withColumn("__at", F.col("__us") / 1e6).repartition("__key").sortWithinPartitions("__key", "__us", *order)
    return ready.mapInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", " + schema)


class Machine(Protocol):
    """A state machine over a log whose effect on a range is a function of few cases. States and functions are JSON values."""

    schema: str

    def start(self) -> list: ...

    def step(self, state: list, t: float, values: tuple) -> tuple:
        """Move the state by one row, in place, and return the row's output."""

    def summary(self, times: list[float], values: list[tuple]) -> dict:
        """What these rows do to any state that the rows before them may leave."""

    def after(self, summary: dict, state: list) -> list:
        """The state that a range with this summary leaves of that one."""


class Breaker:
    """A state is [failures, failed_at], failed_at None while the breaker is closed."""

    schema = "allowed boolean, state string, failures int"

    def __init__(self, threshold: int, recovery: float):
        self.threshold, self.recovery = threshold, recovery

    def start(self) -> list:
        return [0, None]

    def step(self, state: list, t: float, values: tuple) -> tuple:
        if state[1] is not None and t - state[1] < self.recovery:
            return False, OPEN, state[0]
        if values[0]:
            state[0] += 1
            state[1] = t if state[0] >= self.threshold else None
        else:
            state[:] = [0, None]
        return True, OPEN if state[1] is not None else CLOSED, state[0]

    def summary(self, times: list[float], values: list[tuple]) -> dict:
        """Exits for 0, 1, .. failures of a closed breaker; for an open one, by the row that first gets through.

        An exit is [failures, failed_at, added]: where `added` holds, failures are those besides the entry's. Backwards
        over the rows: tried[i] is the exit if row i is a trial, closed[i] if the breaker is closed and clean before it.
        """
        n, most = len(times), self.threshold
        bad = [bool(v[0]) for v in values]
        run = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            run[i] = run[i + 1] + 1 if bad[i] else 0
        tried: list[tuple] = [()] * n
        closed: list[tuple] = [(0, None, False)] * (n + 1)
        wakes = [n] * n
        j = n
        for i in range(n - 1, -1, -1):
            while j - 1 > i and times[j - 1] - times[i] >= self.recovery:
                j -= 1
            wakes[i] = j
        if self.recovery <= 0:
            wakes = [i + 1 for i in range(n)]

        def opened(k: int, failures: int) -> tuple:
            """The exit if row k opens the breaker with so many failures."""
            w = wakes[k]
            if w >= n:
                return failures, times[k], False
            return (failures + tried[w][0], tried[w][1], False) if tried[w][2] else tried[w]

        def from_closed(i: int, failures: int) -> tuple:
            need = most - failures
            if run[i] >= need:
                return opened(i + need - 1, most)
            return (failures + run[i], None, False) if i + run[i] == n else closed[i + run[i] + 1]

        for i in range(n - 1, -1, -1):
            if not bad[i]:
                tried[i] = closed[i + 1]
            elif wakes[i] >= n:
                tried[i] = (1, times[i], True)
            else:
                w = tried[wakes[i]]
                tried[i] = (w[0] + 1, w[1], True) if w[2] else w
            closed[i] = from_closed(i, 0)
        waking: list[list] = []  # [time of the last row of a run of equal exits, exit], of rows that may be first
        for i in range(n):
            if waking and waking[-1][1] == list(tried[i]):
                waking[-1][0] = times[i]
            else:
                waking.append([times[i], list(tried[i])])
            if times[i] - times[0] >= self.recovery:  # even what failed just before the range gets through here
                break
        return {"closed": [list(from_closed(0, f)) for f in range(most)], "waking": waking}

    def after(self, summary: dict, state: list) -> list:
        if state[1] is None:
            failures, at, _ = summary["closed"][state[0]]
            return [failures, at]
        k = bisect_left(summary["waking"], True, key=lambda w: w[0] - state[1] >= self.recovery)
        if k == len(summary["waking"]):
            return state
        failures, at, added = summary["waking"][k][1]
        return [failures + state[0] if added else failures, at]


class Tiers:
    """A state is [tier, opened_at, failures, ok, total], opened_at None while the circuit is closed."""

    schema = "tier int, circuit_open boolean, failures int, success_rate double"

    def __init__(self, top: int, threshold: int, rest: float):
        self.top, self.threshold, self.rest = top, threshold, rest

    def start(self) -> list:
        return [0, None, 0, 0, 0]

    def step(self, state: list, t: float, values: tuple) -> tuple:
        if state[1] is not None and t - state[1] > self.rest:
            state[0] = self.top
        state[4] += 1
        if values[0]:
            state[3] += 1
            state[1:3] = [None, 0]
        else:
            state[2] += 1
            if state[2] >= self.threshold and state[1] is None:
                state[1] = t
            if values[1] and state[1] is None:
                state[0] = min(self.top, state[0] + 1)
        return state[0], state[1] is not None, state[2], state[3] / state[4]

    def summary(self, times: list[float], values: list[tuple]) -> dict:
        """Rows up to the first success depend on the failures met; what follows it raises the tier and leaves the rest as it is."""
        first = next((i for i, v in enumerate(values) if v[0]), None)
        before = len(times) if first is None else first
        blocks = [0]
        for v in values[: min(before, self.threshold)]:
            blocks.append(blocks[-1] + bool(v[1]))
        without = Tiers(10**9, self.threshold, self.rest)  # a top that steps alone do not reach
        later = without.start()
        for t, v in zip(times[before:], values[before:], strict=True):
            without.step(later, t, v)
        return {"before": before, "success": first is not None, "blocks": blocks, "times": times[: min(before, self.threshold)], "end": times[first if first is not None else -1], "later": later, "rows": len(times)}

    def after(self, summary: dict, state: list) -> list:
        tier, opened, failures, ok, total = state
        if opened is None:
            at = self.threshold - failures - 1  # the row that opens the circuit, if all are failures until then
            tier += summary["blocks"][min(max(at, 0), summary["before"])]
            opened = summary["times"][at] if at < summary["before"] else None
        if opened is not None and summary["end"] - opened > self.rest:
            tier = self.top
        if summary["success"]:
            tier, opened, failures = tier + summary["later"][0], summary["later"][1], summary["later"][2]
        else:
            failures += summary["before"]
        return [min(self.top, tier), opened, failures, ok + summary["later"][3], total + summary["rows"]]


def replay(rows: DataFrame, key: str, at: str, order: list[str], columns: list[str], machine: Machine, ranges: int | None = None) -> DataFrame:
    """key, *order and the machine's output for every row, in the order of (at, *order) within each key; null is a key of its own.

    Rows are dealt by (key, time) into as many ranges as Spark has shuffle partitions, or as asked for, so a key with
    most rows is most ranges. The driver sees nothing; a key's summaries, one a range, meet in one task.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [key, *order]
    place = ["__key", "__at", *order]
    ready = rows.select(*dict.fromkeys([*names, *columns]), F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("__key"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("__at"))
    number = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialised(ready.repartitionByRange(number, *place).withColumn("__range", F.spark_partition_id()), "ranges")  # bounds are drawn once

    def values_of(batch: pd.DataFrame) -> list[tuple]:
        clean = batch[columns].astype(object).where(batch[columns].notna(), None)
        return list(clean.itertuples(index=False, name=None))

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, times, values = None, [], []
        for batch in batches:
            out = []
            for r, k, t, v in zip(batch["__range"], batch["__key"], batch["__at"], values_of(batch), strict=True):
                if (r, k) != current:
                    if current is not None:
                        out.append((*current, json.dumps(machine.summary(times, values))))
                    current, times, values = (r, k), [], []
                times.append(t)
                values.append(v)
            yield pd.DataFrame(out, columns=["__range", "__key", "summary"])
        if current is not None:
            yield pd.DataFrame([(*current, json.dumps(machine.summary(times, values)))], columns=["__range", "__key", "summary"])

    def entries(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("__range", ignore_index=True)
        state, out = machine.start(), []
        for text in found["summary"]:
            out.append(json.dumps(state))
            state = machine.after(json.loads(text), state)
        return found[["__range", "__key"]].assign(entry=out)

    # Only a key that goes on in another range needs a scan; ranges are runs of keys, so these are few.
    spans = dealt.groupBy("__key").agg(F.min("__range").alias("lo"), F.max("__range").alias("hi")).where("lo < hi").select("__key")
    met = dealt.join(spans, "__key", "left_semi").repartition(number, "__range").sortWithinPartitions("__range", *place)
    scanned = met.mapInPandas(summaries, "__range int, __key string, summary string").groupBy("__key").applyInPandas(entries, "__range int, __key string, entry string")
    opening = scanned.select("__range", "__key", "entry", F.lit(0).alias("__kind"))
    marked = dealt.withColumn("__kind", F.lit(1)).unionByName(opening, allowMissingColumns=True)
    marked = marked.repartition(number, "__range").sortWithinPartitions("__range", "__key", "__kind", "__at", *order)
    out_names = [p.strip().split()[0] for p in machine.schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current = machine.start(), None
        for batch in batches:
            out = []
            for r, k, t, entry, kind, v in zip(batch["__range"], batch["__key"], batch["__at"], batch["entry"], batch["__kind"], values_of(batch), strict=True):
                if (r, k) != current:
                    state, current = machine.start() if kind else json.loads(entry), (r, k)
                if kind:
                    out.append(machine.step(state, t, v))
            yield pd.concat([batch.loc[batch["__kind"] == 1, names].reset_index(drop=True), pd.DataFrame(out, columns=out_names)], axis=1)

    return marked.mapInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", " + machine.schema)


def circuit_breaker(rows: DataFrame, key: str, at: str, order: list[str], failed: str, threshold: int = 5, recovery: float = 30.0, ranges: int | None = None) -> DataFrame:
    """Whether each call was let through, and the breaker's state after it.

    `threshold` failures in a row open it; `recovery` seconds after the last failure it lets a call through; a success
    closes it, a failure opens it again. Calls that are refused change nothing. A null outcome is a success.
    """
    return replay(rows, key, at, order, [failed], Breaker(threshold, recovery), ranges)


def domain_tiers(rows: DataFrame, key: str, at: str, order: list[str], ok: str, blocked: str, top: int = 2, threshold: int = 5, rest: float = 60.0, ranges: int | None = None) -> DataFrame:
    """The service tier a key's log had reached after each outcome: tier, circuit_open, failures in a row, success_rate.

    A block raises the tier by one while the circuit is closed; `threshold` failures in a row open it; after `rest`
    seconds the next request is at the top tier; a success closes it. A null outcome is a failure, not blocked.
    """
    return replay(rows, key, at, order, [ok, blocked], Tiers(top, threshold, rest), ranges)


def token_bucket(rows: DataFrame, key: str, at: str, order: list[str], rate: float, burst: int) -> DataFrame:
    """Whether each request passes a limit of `rate` a second with bursts of `burst`, and the tokens left."""

    def step(s: dict, t: float, values: tuple) -> tuple:
        s["tokens"] = float(burst) if s["at"] is None else min(float(burst), s["tokens"] + (t - s["at"]) * rate)
        s["at"] = t
        allowed = s["tokens"] >= 1.0
        s["tokens"] -= allowed
        return bool(allowed), s["tokens"]

    return fold(rows, key, at, order, [], "allowed boolean, tokens double", lambda: {"tokens": 0.0, "at": None}, step)


def router_stats(states: DataFrame, key: str, order: str | list[str]) -> DataFrame:
    """The last state of each key's replay, by one column or several in turn."""
    last = states.groupBy(key).agg(F.max_by(F.struct("tier", "circuit_open", "success_rate"), F.struct(order)).alias("s"), F.count(F.lit(1)).alias("total"))
    return last.select(key, F.col("s.tier").alias("tier"), F.col("s.circuit_open").alias("circuit_open"), F.round("s.success_rate", 3).alias("success_rate"), "total")
