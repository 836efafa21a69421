"""Schema drift from extraction metrics, and the history of schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAILURE_RATE, DROPPED_FIELDS, SIMILARITY, DIVERGENCE, MIN_SAMPLES, HISTORY = 0.30, 3, 0.80, 0.20, 5, 100


def metric_rows(records: DataFrame, keep: list[str], fields: dict[str, Column], required: set[str], confidence: Column, content: Column) -> DataFrame:
    """A metric row for each extraction, appended to a log rather than counted up: keep, passed, confidence, field_status, content_hash.

    field_status: map of field name to whether it was filled (not null, not blank). passed: all required fields are.
    content_hash: of the content, null for an empty or missing one, which has none. Windows over the log take the last
    HISTORY rows of a key.
    """
    filled = {n: F.coalesce(F.trim(c.cast("string")) != "", F.lit(False)) for n, c in fields.items()}
    status = F.create_map(*[x for n, c in filled.items() for x in (F.lit(n), c)])
    passed = F.lit(True)
    for name in sorted(required):
        passed = passed & filled[name]
    hashed = F.when(content != "", F.sha2(content, 256))
    return records.select(*keep, passed.alias("passed"), confidence.cast("double").alias("confidence"), status.alias("field_status"), hashed.alias("content_hash"))


def validation_failures(metrics: DataFrame, keys: list[str], passed: str = "passed") -> DataFrame:
    """Failure rate over all records of a key; triggered above FAILURE_RATE from MIN_SAMPLES on."""
    out = metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.count_if(~F.col(passed)).alias("failures"))
    out = out.withColumn("value", F.col("failures") / F.col("samples"))
    return out.withColumn("triggered", (F.col("samples") >= MIN_SAMPLES) & (F.col("value") > FAILURE_RATE))


def field_completeness(metrics: DataFrame, keys: list[str], order: list, fields: str = "field_status") -> DataFrame:
    """Fields filled in over 0.8 of the first half of the last HISTORY records and in under 0.3 of the second half.

    fields: map of field name to whether it was filled. triggered from DROPPED_FIELDS dropped fields on.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    last = metrics.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= HISTORY)
    last = last.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    last = last.withColumn("split", F.greatest(F.lit(1), F.floor(F.col("n") / 2))).withColumn("early", F.col("n") - F.col("back") < F.col("split"))
    sizes = last.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.count_if("early").alias("n_early"), F.count_if(~F.col("early")).alias("n_late"))
    filled = last.select(*keys, "early", F.explode(fields).alias("field", "filled"))
    counts = filled.groupBy(*keys, "field").agg(F.count_if(F.col("filled") & F.col("early")).alias("in_early"), F.count_if(F.col("filled") & ~F.col("early")).alias("in_late"))
    rates = counts.join(sizes, keys)
    dropped = (F.col("in_early") / F.col("n_early") > 0.8) & (F.coalesce(F.try_divide(F.col("in_late"), F.col("n_late")), F.lit(0.0)) < 0.3)
    found = rates.groupBy(*keys).agg(F.max("samples").alias("samples"), F.count_if(dropped).alias("value"))
    return found.withColumn("value", F.when(F.col("samples") >= MIN_SAMPLES, F.col("value")).otherwise(0)).withColumn("triggered", F.col("value") >= DROPPED_FIELDS)


def recent_hashes(metrics: DataFrame, keys: list[str], order: list[str], n: int = 10) -> DataFrame:
    """keys and the content hashes of the last n records of each, the latest first."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    rows = metrics.select(*keys, "content_hash", back.alias("back")).where(F.col("back") <= n)
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("back", "content_hash"))), lambda x: x["content_hash"]).alias("hashes"))


def content_similarity(metrics: DataFrame, keys: list[str], order: list, content_hash: str = "content_hash") -> DataFrame:
    """The latest record against the one before: 1 if their contents agree, else 0.5; triggered under SIMILARITY."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    rows = metrics.select(*keys, content_hash, F.row_number().over(w).alias("back"), F.lead(content_hash).over(w).alias("before"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("samples"))
    value = F.when((F.col("samples") < 3) | (F.col(content_hash) == F.col("before")), 1.0).otherwise(0.5)
    return rows.where("back = 1").select(*keys, "samples", value.alias("value")).withColumn("triggered", F.col("value") < SIMILARITY)


def schema_divergence(current: Column, found: Column) -> Column:
    """1 - Jaccard index of two arrays of field names; 0 if either is null or both are empty."""
    union = F.size(F.array_union(current, found))
    return F.when(current.isNull() | found.isNull() | (union == 0), 0.0).otherwise(1 - F.size(F.array_intersect(current, found)) / F.greatest(union, F.lit(1)))


def severity(signals: DataFrame, triggered: list[str]) -> DataFrame:
    """n_triggered, drift (two signals agree), severity and confidence from boolean columns."""
    n = sum((F.coalesce(F.col(t).cast("int"), F.lit(0)) for t in triggered), F.lit(0))
    name = F.when(F.col("n_triggered") == 0, "none").when(F.col("n_triggered") == 1, "minor").when(F.col("n_triggered") == 2, "moderate").otherwise("major")
    return signals.withColumn("n_triggered", n).withColumn("drift", F.col("n_triggered") >= 2).withColumn("severity", name).withColumn("confidence", F.col("n_triggered") / len(triggered))


def versions(changes: DataFrame, keys: list[str], order: list, schema: str = "schema_data") -> DataFrame:
    """Schema versions from 1, each with its hash and the one before it. schema: map of field to type."""
    w = Window.partitionBy(*keys).orderBy(*order)
    entries = F.array_sort(F.map_entries(F.col(schema)))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return changes.withColumn("version", F.row_number().over(w)).withColumn("hash", F.substring(F.sha2(text, 256), 1, 16)).withColumn("before", F.lag(schema).over(w))


def schema_diff(rows: DataFrame, old: str, new: str) -> DataFrame:
    """added, removed, modified and unchanged field names of two maps of field to type, each sorted."""
    a, b = F.coalesce(F.col(old), F.create_map().cast("map<string,string>")), F.coalesce(F.col(new), F.create_map().cast("map<string,string>"))
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    same = lambda f: F.element_at(a, f).eqNullSafe(F.element_at(b, f))
    return rows.withColumns({
        "added": F.array_sort(F.array_except(F.map_keys(b), F.map_keys(a))), "removed": F.array_sort(F.array_except(F.map_keys(a), F.map_keys(b))),
        "modified": F.array_sort(F.filter(common, lambda f: ~same(f))), "unchanged": F.array_sort(F.filter(common, same)),
    })


def rollback(versioned: DataFrame, keys: list[str], target: int) -> DataFrame:
    """The history with a copy of version `target` on top of each key that has it."""
    top = versioned.groupBy(*keys).agg(F.max("version").alias("__top"))
    old = versioned.where(F.col("version") == target).join(top, keys).withColumn("version", F.col("__top") + 1).withColumn("change_type", F.lit("rollback")).drop("__top")
    return versioned.unionByName(old.select(*versioned.columns))


def timeline(versioned: DataFrame, keys: list[str], at: str, schema: str = "schema_data") -> DataFrame:
    """The history of each key as text: a line a version with its kind, time and fields."""
    line = F.concat(F.lit("v"), F.col("version").cast("string"), F.lit(" ["), "change_type", F.lit("] "), F.col(at).cast("string"), F.lit(": "), F.array_join(F.array_sort(F.map_keys(F.col(schema))), ", "))
    rows = versioned.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("version", line.alias("line")))).alias("lines"))
    return rows.select(*keys, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("timeline"))


def summary(results: DataFrame, found: str = "drift") -> DataFrame:
    """What a monitor reports: checked, found, and how many of each severity."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return results.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col(found)).alias("found"), n("minor"), n("moderate"), n("major"))


def accept_repair(proposals: DataFrame, confidence: str = "confidence", least: float = 0.6) -> DataFrame:
    """Proposed schemas with their differences to the old ones and whether they are taken."""
    return schema_diff(proposals, "old_schema", "new_schema").withColumn("accepted", F.col(confidence) > least)
