"""Mix sources to target weights by hash-random order and distributed prefix sums.

Every row gets a hash-random key. Within a source, rows are ranged by that key into buckets of equal key width (keys
are uniform, so a source's buckets are even and need no sampling, and none has more than about ROWS_PER_BUCKET rows). Sums are prefixed on three levels:
rows inside their bucket, buckets inside groups of BUCKETS_PER_GROUP, and groups inside their source; each source is
cut at its exact budget. A budget beyond one pass over the source repeats whole epochs first. No step gathers a source
in one task but for the sums of its groups, a row for every quarter million of all rows. Sources themselves are taken to be few:
their targets are dealt in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, unused

#: Weights dealt to the sources in the order of their code points, null last, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MAX_EPOCHS, SEED = 1.5, 2, "mix-1"
ROWS_PER_BUCKET, BUCKETS_PER_GROUP = 256, 1024


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(src, source, source_size) with one row a source -> the same with target.

    Targets are the water level times the weight, cut at max_epochs times the source's size. The level is found in
    closed form: sources fill up in the order of cap / weight, and the level is that of the first that does not.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = (F.row_number().over(by_name) - 1) % len(weights)
    t = totals.withColumn("w", F.get(F.array(*[F.lit(int(w)).cast("long") for w in weights]), n)).withColumn("cap", F.col("source_size") * max_epochs)
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    t = t.withColumn("total", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    t = t.withColumn("level", (F.col("total") * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0))))
    # The level is that of the first source, in the order in which they fill up, that it does not fill.
    t = t.withColumn("rank", F.row_number().over(filling))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("rank", "level"))).over(every)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double")))
    return t.select("src", "source", "source_size", target.alias("target"))


def mixing_key(key: Column, text: Column, seed: str = SEED) -> Column:
    """60 random bits of a row's id and text."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.floor(key / F.lit(float(16**15)) * buckets)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    buckets_per_group: int = BUCKETS_PER_GROUP,
    row_col: str | None = None,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, passes.

    size counts words (null text: 0). taken is the number of words the mix takes of the row, repeats counted; the row
    at the cut is taken in part, so the words taken of a source are exactly its target, rounded. passes is taken in
    whole copies, for mixes of whole documents: the row at the cut counts if at least half of it lies before the cut.
    A null source is a source of its own. The key hashes id and text, so rows that share an id, or have none, are spread
    like others as long as their texts differ; rows that are alike in both follow each other, ordered by row_col, or
    arbitrarily. An empty table gives an empty table. Other columns are ignored.
    row_col: a column with a different long in every row. It is returned too and orders rows that are alike.
    """
    source = F.col(source_col).cast("string")
    key = mixing_key(F.col(id_col), F.col(text_col), seed)
    sizes = stored(
        docs.select(
            F.col(id_col).alias("id"),
            source.alias("source"),
            F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("src"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            key.alias("key"),
            *([F.col(row_col).alias("row")] if row_col else []),
        ),
        "mix-sizes",
    )
    buckets = max(1, -(-sizes.count() // rows_per_bucket))
    sizes = sizes.withColumn("bucket", bucket_of(F.col("key"), buckets))
    sums = sizes.groupBy("src", "source", "bucket").agg(F.sum("size").alias("bucket_size"), F.floor(F.first("bucket") / F.lit(buckets_per_group)).alias("part"))
    parts = sums.groupBy("src", "source", "part").agg(F.sum("bucket_size").alias("part_size"))
    totals = parts.groupBy("src", "source").agg(F.sum("part_size").alias("source_size"))
    targets = source_targets(totals, weights, share, max_epochs).drop("source")
    ahead = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(ahead("part", "src")), F.lit(0))).select("src", "part", "part_start")
    within = F.coalesce(F.sum("bucket_size").over(ahead("bucket", "src", "part")), F.lit(0))
    starts = sums.withColumn("within", within).join(parts, ["src", "part"]).select("src", "bucket", (F.col("part_start") + F.col("within")).alias("start")).join(targets, "src")
    inside = Window.partitionBy("src", "bucket").orderBy("key", "id", "size", *(["row"] if row_col else [])).rowsBetween(Window.unboundedPreceding, 0)
    rows = sizes.join(starts, ["src", "bucket"]).withColumn("before", F.col("start") + F.sum("size").over(inside) - F.col("size"))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("budget", budget).withColumn("epochs", epochs)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before")))
    rows = rows.withColumn("part", part)
    passes = F.col("epochs") + F.when((F.col("part") * 2 >= F.col("size")) & (F.col("size") > 0) & (F.col("part") > 0), 1).otherwise(0)
    return rows.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), passes.cast("int").alias("passes"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each row of docs as often as `passes` says of that row, with the columns of docs.

    Rows are matched by a key that is stored with them, so ids may be null or repeat.
    """
    row, key, passes = unused(docs, "__row"), unused(docs, "__key"), unused(docs, "__passes")
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    mix = mix_sources(keyed, id_col=id_col, row_col=row, **options)
    taken = mix.where("passes > 0").select(F.col(row).alias(key), F.col("passes").alias(passes))
    joined = keyed.join(taken, keyed[row] == taken[key])
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(passes))).alias(key)).drop(key)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src,
         CAST(COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || SUBSTR(MD5('mix-1:' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || COALESCE(MD5(text), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT src, source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY src, source),
r AS (SELECT *, CASE (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
             2 * source_size AS cap FROM s),
l AS (SELECT *, cap / CAST(w AS DOUBLE) AS ratio,
             (1.5::DOUBLE * SUM(source_size) OVER () - COALESCE(SUM(cap) OVER b, 0)) / (SUM(w) OVER () - COALESCE(SUM(w) OVER b, 0))::DOUBLE AS level
      FROM r WINDOW b AS (ORDER BY cap / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT level AS lev FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT src, source_size, LEAST(cap::DOUBLE, COALESCE((SELECT lev FROM m) * w, cap::DOUBLE)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             SUM(size) OVER (PARTITION BY d.src ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead,
             FLOOR(t.target + 0.5) AS budget,
             CASE WHEN t.source_size > 0 THEN FLOOR(FLOOR(t.target + 0.5) / t.source_size) ELSE 0 END AS epochs
      FROM d JOIN t USING (src))
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + GREATEST(0, LEAST(size, budget - epochs * source_size - ahead)) AS BIGINT) AS taken
FROM p
"""
