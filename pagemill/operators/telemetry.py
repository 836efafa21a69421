"""Counters, gauges, histograms and health roll-ups over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered

# Upper bounds of histogram buckets by metric.
BUCKETS = {
    "crawl_seconds": (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0),
    "response_bytes": (1000, 10000, 50000, 100000, 500000, 1000000, 5000000),
    "extraction_seconds": (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 5.0),
    "fields": (1, 5, 10, 25, 50, 100),
    "confidence": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0),
    "proxy_seconds": (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0),
    "model_seconds": (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0),
    "vision_seconds": (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0),
    "segments": (1, 5, 10, 25, 50, 100),
}


def histogram(rows: DataFrame, value: str, bounds: tuple[float, ...], labels: list[str]) -> DataFrame:
    """Cumulative counts by label set and bound (le; null: unbounded), with the sum and count, in one aggregation."""
    counted = rows.groupBy(*labels).agg(
        *[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("n"), F.sum(value).alias("total")
    )
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("n").alias("count")))
    return counted.withColumn("b", F.explode(F.array(*pairs))).select(*labels, "b.le", "b.count", "n", "total")


def counters(rows: DataFrame, labels: list[str], value: Column | None = None) -> DataFrame:
    return rows.groupBy(*labels).agg((F.count(F.lit(1)) if value is None else F.sum(value)).alias("value"))


def gauges(rows: DataFrame, labels: list[str], value: str, at: str, tiebreak: str) -> DataFrame:
    """The latest value of each label set."""
    return rows.groupBy(*labels).agg(F.max_by(value, F.struct(at, tiebreak)).alias("value"))


def feed_counts(rows: DataFrame, kind: str, kinds: tuple[str, ...]) -> DataFrame:
    """One row with a count for each kind and all."""
    return rows.agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds], F.count(F.lit(1)).alias("n_all"))


def latest(rows: DataFrame, order: list, n: int = 50) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def rates(rows: DataFrame, by: str, success: Column, blocked: Column) -> DataFrame:
    """Encounters, passed, blocked and the share passed."""
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("encounters"), F.count_if(success).alias("passed"), F.count_if(blocked).alias("blocked"))
    return out.withColumn("pass_rate", F.try_divide(F.col("passed"), F.col("encounters")))


def bars(rows: DataFrame, value: str) -> DataFrame:
    """Each value as a share of the largest."""
    return rows.crossJoin(F.broadcast(rows.agg(F.max(value).alias("__most")))).withColumn("bar", F.try_divide(F.col(value), F.col("__most"))).drop("__most")  # one row


def extraction_health(results: DataFrame, ok: Column, elapsed: str, cost: str) -> DataFrame:
    return results.agg(F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"), F.avg(elapsed).alias("avg_elapsed_ms"), F.sum(cost).alias("total_cost"), F.bool_and(ok).alias("all_ok"))


def recent(rows: DataFrame, at: str, hours: int = 72) -> DataFrame:
    """Rows within some hours of the latest: the retention rule of log tables."""
    last = rows.agg(F.max(at).alias("__last"))
    return rows.join(F.broadcast(last), F.col(at) > F.col("__last") - F.expr(f"INTERVAL {hours} HOURS")).drop("__last")  # one row


def streaks(rows: DataFrame, key: str, failed: Column, order: list) -> DataFrame:
    """Longest and current run of failures of each key: a run is what lies between two successes."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.select(key, *order, failed.alias("__failed")).withColumn("__island", F.sum(F.when(F.col("__failed"), 0).otherwise(1)).over(w))
    sizes = runs.groupBy(key, "__island").agg(F.count_if("__failed").alias("n"))
    return sizes.groupBy(key).agg(F.max("n").alias("longest"), F.max_by("n", "__island").alias("current"))


def proxy_health(outcomes: DataFrame, key: str, ok: Column, blocked: Column, latency: Column, order: list) -> DataFrame:
    """Health score and status of each proxy.

    0.4 of the success rate, 0.3 of the share not challenged, 0.3 of 1 - mean latency of successes / 10 s. Quarantined
    after a current run of 5 failures, degraded under half successes or after 3.
    """
    marked = outcomes.select("*", ok.alias("__ok"), blocked.alias("__blocked"), latency.alias("__latency"))
    totals = marked.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("__ok").alias("n_ok"), F.count_if("__blocked").alias("n_blocked"),
        F.coalesce(F.avg(F.when(F.col("__ok"), F.col("__latency"))), F.lit(0.0)).alias("avg_latency"),
    )
    both = totals.join(streaks(marked, key, ~F.col("__ok"), order), key)
    rate = F.try_divide(F.col("n_ok"), F.col("total"))
    score = 0.4 * rate + 0.3 * (1 - F.try_divide(F.col("n_blocked"), F.col("total"))) + 0.3 * F.greatest(F.lit(0.0), 1 - F.col("avg_latency") / 10000)
    status = F.when(F.col("current") >= 5, "quarantined").when((rate < 0.5) | (F.col("current") >= 3), "degraded").otherwise("healthy")
    return both.select(key, "total", score.alias("health"), F.col("current").alias("failures_in_a_row"), status.alias("status"))


def pool_stats(health: DataFrame, tier: Column) -> DataFrame:
    return health.groupBy(tier.alias("tier")).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("healthy", "degraded", "quarantined")], F.round(F.avg("health"), 3).alias("avg_health")
    )


def best_proxies(health: DataFrame, tier: Column, key: str, n: int = 3) -> DataFrame:
    """The n healthiest of each tier that are not quarantined; ties go to the smaller key."""
    place = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("health"), key))
    return health.where("status <> 'quarantined'").withColumn("tier", tier).withColumn("place", place).where(F.col("place") <= n).select("tier", "place", key, "health")


def time_to_live(records: DataFrame, key: str, at: str, now: Column, seconds: int = 1800) -> DataFrame:
    """Age, refresh count and expiry of each key's latest record: expired beyond the lifetime, due beyond 0.8 of it."""
    out = records.groupBy(key).agg(F.max(at).alias("last_at"), (F.count(F.lit(1)) - 1).alias("refreshes"))
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("last_at").cast("timestamp"))
    return out.withColumn("age", age).withColumn("expired", F.col("age") > seconds).withColumn("due", F.col("age") > 0.8 * seconds)


def batches(rows: DataFrame, by: list[str], order: list[str], size: int = 100, ranges: int | None = None) -> DataFrame:
    """Rows of a log as the batches an exporter sends: by, batch, n and rows (JSON, in order), at most `size` rows each; a key's rows are numbered in ranges."""
    placed = numbered(rows, by, order, "__place", ranges)
    tagged = placed.withColumn("batch", F.floor((F.col("__place") - 1) / size).cast("int")).withColumn("__json", F.to_json(F.struct(*rows.columns)))
    out = tagged.groupBy(*by, "batch").agg(F.array_sort(F.collect_list(F.struct(*order, "__json"))).alias("r"))
    return out.select(*by, "batch", F.size("r").alias("n"), F.transform("r", lambda x: x["__json"]).alias("rows"))
