"""Row numbers and look-back within keys of any size: rows are dealt into ranges of (key, order), what ranges owe each other is carried over.

A window over a key is one task. Here a key with most rows is most ranges: each range numbers its own rows, and the
counts (or last rows) of a key's ranges, one row a range, are prefixed and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import materialised


def ranged(rows: DataFrame, by: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """rows with __range, the number of the range of (by, order) that each lies in, stored once so that bounds stay."""
    number = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialised(rows.repartitionByRange(number, *by, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def _same(by: list[str]) -> Column:
    found = F.col("__range") == F.col("__r")
    for c in by:
        found = found & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return found


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "place", ranges: int | None = None) -> DataFrame:
    """rows with their number (from 1) among those of their key in the order of some columns, nulls first; null is a key."""
    dealt = ranged(rows, by, order, ranges)
    counts = dealt.groupBy("__range", *by).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = counts.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__by_{c}") for c in by], before.alias("__start"))
    own = F.row_number().over(Window.partitionBy("__range", *by).orderBy(*order))
    return dealt.withColumn("__own", own).join(starts, _same(by)).select(*rows.columns, (F.col("__start") + F.col("__own")).alias(name))


def looked_back(rows: DataFrame, by: list[str], order: list[str], columns: list[str], prefix: str = "old_", ranges: int | None = None) -> DataFrame:
    """rows with some columns of the row before them in their key, in the order of some columns; nulls on a key's first row."""
    dealt = ranged(rows, by, order, ranges)
    w = Window.partitionBy("__range", *by).orderBy(*order)
    last = dealt.groupBy("__range", *by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last"))
    carried = last.withColumn("carried", F.lag("last").over(Window.partitionBy(*by).orderBy("__range")))  # a row a range
    carried = carried.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__by_{c}") for c in by], "carried")
    own = dealt.withColumn("__own", F.row_number().over(w)).withColumn("__lag", F.lag(F.struct(*columns)).over(w))
    joined = own.join(carried, _same(by)).withColumn("__old", F.when(F.col("__own") == 1, F.col("carried")).otherwise(F.col("__lag")))
    return joined.select(*rows.columns, *[F.col("__old")[c].alias(f"{prefix}{c}") for c in columns])


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], name: str = "quantiles", ranges: int | None = None, around: str | None = None) -> DataFrame:
    """Each key's exact quantiles of a number, interpolated, as an array in the order of shares; null is a key, null values do not count.

    around: a column for the values that each lies between, as structs of low and high.

    A key's values are numbered over ranges and only those at the wanted places are kept, so no task holds a key's values.
    A key without values has no row.
    """
    kept = rows.select(*by, F.col(value).cast("double").alias("__value")).where("__value IS NOT NULL")
    placed = numbered(kept, by, ["__value"], "__place", ranges)
    at = F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1) * (F.col("n") - 1)
    ask = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(shares) - 1)))).withColumn("at", at)
    low = F.floor("at")
    spots = F.array(F.struct((low + 1).alias("spot"), (1 - (F.col("at") - low)).alias("weight")), F.struct((low + 2).alias("spot"), (F.col("at") - low).alias("weight")))
    spots = ask.select(*[F.col(c).alias(f"__by_{c}") for c in by], "i", F.inline(spots)).where("weight > 0")
    same = F.col("__place") == F.col("spot")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    met = {"v": F.sum(F.col("weight") * F.col("__value")), "low": F.min("__value"), "high": F.max("__value")}
    found = placed.join(spots, same).groupBy(*by, "i").agg(*[c.alias(n) for n, c in met.items()])
    found = found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", *met))).alias("met"))
    of = {name: lambda x: x["v"]} | ({around: lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"))} if around else {})
    return found.select(*by, *[F.transform("met", f).alias(n) for n, f in of.items()])
