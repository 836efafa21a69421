"""Merge two extractions of the same items field by field, with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dice, is_empty, numbers_match


def values_match(a: Column, b: Column, similarity: float = 0.85, tolerance: float = 0.01) -> Column:
    """Whether two extracted strings agree: as numbers within the tolerance, else as text, case and outer space aside, or by bigrams."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    nx, ny = x.try_cast("double"), y.try_cast("double")
    return F.when(nx.isNotNull() & ny.isNotNull(), numbers_match(nx, ny, tolerance)).otherwise((x == y) | (dice(x, y) >= similarity))


def merge_fields(html: DataFrame, vision: DataFrame, prefer_html: bool = True, similarity: float = 0.85) -> DataFrame:
    """item_id, field, merged, source of two long tables (item_id, field, value): a full outer join on item and field.

    source is html, vision, agreed, conflict_html or conflict_vision; where neither has a value merged is null.
    """
    both = html.withColumnRenamed("value", "h").join(vision.withColumnRenamed("value", "v"), ["item_id", "field"], "full_outer")
    no_h, no_v = is_empty(F.col("h")), is_empty(F.col("v"))
    source = (
        F.when(no_h & no_v, "html").when(no_h, "vision").when(no_v, "html").when(values_match(F.col("h"), F.col("v"), similarity), "agreed")
        .otherwise("conflict_html" if prefer_html else "conflict_vision")
    )
    out = both.withColumn("source", source)
    merged = F.when(no_h & no_v, F.lit(None)).when(F.col("source").isin("vision", "conflict_vision"), F.col("v")).otherwise(F.col("h"))
    return out.select("item_id", "field", merged.alias("merged"), "source")


def merge_summary(merged: DataFrame) -> DataFrame:
    """Counts by source and the confidence of each item: the share filled, plus a tenth of the share agreed, at most 1."""
    out = merged.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("total_fields"), F.count_if(~is_empty(F.col("merged"))).alias("populated"),
        F.count_if((F.col("source") == "html") & F.col("merged").isNotNull()).alias("from_html"), F.count_if(F.col("source") == "vision").alias("from_vision"),
        F.count_if(F.col("source") == "agreed").alias("agreed"), F.count_if(F.startswith("source", F.lit("conflict"))).alias("conflicted"),
    )
    score = F.col("populated") / F.col("total_fields") + 0.1 * F.col("agreed") / F.col("total_fields")
    return out.withColumn("merge_confidence", F.least(F.lit(1.0), score))


def enforce_schema(entities: DataFrame, fields: dict[str, str], key: str, values: str) -> DataFrame:
    """A map column of strings as typed columns: those of `fields` (name to type), null where absent or not of the type."""
    return entities.select(key, *[F.element_at(F.col(values), F.lit(n)).try_cast(t).alias(n) for n, t in fields.items()])
