"""State machines over ranges of time against a loop over the whole log."""

import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.operators import state

T0 = dt.datetime(2024, 1, 1)
MACHINES = [state.Breaker(3, 5.0), state.Breaker(1, 2.0), state.Breaker(2, 0.0), state.Tiers(2, 3, 4.0), state.Tiers(5, 1, 0.0), state.Tiers(3, 4, 100.0)]


def loop(machine, rows):
    now, out = machine.start(), []
    for t, v in rows:
        out.append(machine.step(now, t, v))
    return out, now


rows = st.lists(st.tuples(st.sampled_from([0, 0, 1, 1, 2, 3, 6, 20]), st.booleans(), st.booleans()), min_size=1, max_size=40)


@settings(max_examples=500, deadline=None)
@given(rows, st.lists(st.integers(1, 39), max_size=5), st.sampled_from(MACHINES))
def test_summaries_of_ranges_give_the_state_of_a_loop(log, cuts, machine):
    t, timed = 0, []
    for gap, a, b in log:
        t += gap
        timed.append((float(t), (a, b)))
    now, at = machine.start(), 0
    for cut in [*sorted({c for c in cuts if c < len(timed)}), len(timed)]:
        part = timed[at:cut]
        now = machine.after(json.loads(json.dumps(machine.summary([t for t, _ in part], [v for _, v in part]))), now)
        assert now == loop(machine, timed[:cut])[1]
        at = cut


def log(spark, n, keys):
    rng = random.Random(4)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 1, 2, 9, 40])
        rows.append((rng.choice(keys), T0 + dt.timedelta(seconds=t), i, rng.random() < 0.6, rng.random() < 0.4, rng.random() < 0.5))
    return rows, spark.createDataFrame(rows, "k string, ts timestamp, i int, failed boolean, ok boolean, blocked boolean").repartition(3)


@pytest.mark.parametrize("keys", [["hot"], ["a", "b", None, "hot", "hot", "hot", "hot"]])
def test_one_key_is_many_tasks(spark, keys):
    rows, df = log(spark, 900, keys)
    breaker = state.circuit_breaker(df, "k", "ts", ["i"], "failed", threshold=3, recovery=20.0, ranges=8)
    tiers = state.domain_tiers(df, "k", "ts", ["i"], "ok", "blocked", top=4, threshold=3, rest=15.0, ranges=8)
    got = {r.i: (r.allowed, r.state, r.failures) for r in breaker.collect()}, {r.i: (r.tier, r.circuit_open, r.failures, r.success_rate) for r in tiers.collect()}
    for machine, found, columns in ((state.Breaker(3, 20.0), got[0], (3,)), (state.Tiers(4, 3, 15.0), got[1], (4, 5))):
        for k in set(keys):
            own = [((r[1] - T0).total_seconds(), tuple(r[c] for c in columns), r[2]) for r in rows if r[0] == k]
            want, _ = loop(machine, [(t, v) for t, v, _ in own])
            assert [found[i] for _, _, i in own] == want
    if keys == ["hot"]:  # eight tasks had rows, none more than a third
        sizes = [r["n"] for r in breaker.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(sizes) >= 4 and max(sizes) < 900 / 2


def test_no_rows_and_null_outcomes(spark):
    _, df = log(spark, 5, ["a"])
    assert state.circuit_breaker(df.limit(0), "k", "ts", ["i"], "failed").collect() == []
    nulls = df.withColumn("failed", F.lit(None).cast("boolean")).withColumn("ok", F.lit(None).cast("boolean")).withColumn("blocked", F.lit(None).cast("boolean"))
    assert {(r.allowed, r.state) for r in state.circuit_breaker(nulls, "k", "ts", ["i"], "failed").collect()} == {(True, "closed")}
    assert [r.failures for r in state.domain_tiers(nulls, "k", "ts", ["i"], "ok", "blocked").orderBy("i").collect()] == [1, 2, 3, 4, 5]
