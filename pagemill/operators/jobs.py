"""Jobs as an append-only log: latest state, versions, attempts, pages of a listing.

Parquet has no updates, so inserts, status changes and retries are rows; the current table is the latest row of each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A job's states in the order it may pass through them, and those that end it.
STATUSES = ("pending", "queued", "running", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")
MOVES = {"pending": ("queued", "running", "failed", "cancelled"), "queued": ("running", "failed", "cancelled"), "running": ("completed", "failed", "cancelled")}


def latest_state(log: DataFrame, key: str = "job_id", at: str = "at", tiebreak: str = "seq") -> DataFrame:
    """The latest row of each key, with retries so far and completed_at where it ended. log has status among its columns.

    One aggregation with map-side combining: no sort of a key's rows.
    """
    order = F.struct(F.col(at), F.col(tiebreak))
    others = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(
        F.max_by(F.struct(*others), order).alias("last"),
        F.count_if(F.col("status") == "retry").alias("retry_count"),
        F.max(F.when(F.col("status").isin(*TERMINAL), F.col(at))).alias("ended_at"),
    )
    return last.select(key, *[F.col(f"last.{c}").alias(c) for c in others], "retry_count", F.when(F.col("last.status").isin(*TERMINAL), F.col("ended_at")).alias("completed_at"))


def illegal_moves(log: DataFrame, key: str = "job_id", at: str = "at", tiebreak: str = "seq") -> DataFrame:
    """Rows of the log whose status may not follow the one before."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy(at, tiebreak))
    allowed = F.lit(False)
    for status, following in MOVES.items():
        allowed = allowed | (F.col("before") == status) & F.col("status").isin(*following)
    return log.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col("status")) & ~allowed)


def can_cancel(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("status").isin(*TERMINAL))


def by_status(jobs: DataFrame, status: str | None = None) -> DataFrame:
    return jobs if status is None else jobs.where(F.col("status") == status)


def get(rows: DataFrame, **keys) -> DataFrame:
    """Rows by key: a filter that reaches the scan."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == value)
    return rows


def page_of(rows: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a listing; `order` must end in a unique key. limit is kept within 1 to 200."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit)))


def with_versions(entities: DataFrame, keys: list[str], order: list) -> DataFrame:
    """version from 1 in the order of creation, with the previous and next version's hash."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return entities.withColumn("version", F.row_number().over(w)).withColumn("previous_hash", F.lag("schema_hash").over(w)).withColumn("next_hash", F.lead("schema_hash").over(w))


def next_version(entities: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The version that the next insert of each key takes."""
    return entities.groupBy(*keys).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def with_attempts(jobs: DataFrame, attempts: DataFrame, key: str, how: str = "left") -> DataFrame:
    """jobs with their attempts (left), only those that have some (left_semi) or none (left_anti)."""
    return jobs.join(attempts, key, how)


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """left with the latest value of right at or before each of its times, by key.

    Both sides are laid in one order and the last value is carried on: one shuffle by key and a sort, no range join.
    """
    columns = [c for c in left.columns if c not in (key, left_at)]
    blank = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns]
    rows = left.select(key, F.col(left_at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("__value"), *columns)
    marks = right.select(key, F.col(right_at).alias("at"), F.lit(0).alias("side"), F.col(value).alias("__value"), *blank)
    w = Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks).withColumn("__value", F.last("__value", ignorenulls=True).over(w))
    return both.where("side = 1").select(key, F.col("at").alias(left_at), *columns, F.col("__value").alias(f"last_{value}"))


def ordered_attempts(attempts: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """key and its attempts as an array of structs, the first first. An array holds one job's attempts."""
    rows = attempts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("attempts"))
    return rows
