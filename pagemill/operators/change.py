"""Change between two snapshots: structure, text, pictures, entities, and their weighted sum."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags that are noise to structure, and how much a change of the others matters.
NOISE_TAGS = ("script", "style", "noscript", "iframe", "svg", "path", "meta", "link", "head")
HIGH_TAGS = ("table", "tr", "td", "th", "ul", "ol", "li", "article", "section", "main", "h1", "h2", "h3", "h4", "p", "a")
MEDIUM_TAGS = ("div", "span", "form", "nav", "header", "footer", "aside")
LOW_TAGS = ("br", "hr", "img", "picture", "source", "figure", "figcaption")
#: Letters for the distinct tags of two sequences, more than two cut ones can have.
MOST_TAGS = 500
ALPHABET = "".join(chr(0x4E00 + i) for i in range(2 * MOST_TAGS))
IGNORED_FIELDS = ("_id", "timestamp", "crawl_id")


def tags_of(html: Column, noise: tuple[str, ...] = NOISE_TAGS) -> Column:
    """Start tags in document order, lower case, without noise."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r"<(\w+)[\s>]"), 1), F.lower)
    return F.filter(found, lambda t: ~t.isin(*noise))


def tag_letters(tags: Column, names: Column) -> Column:
    """A sequence of tags as a string, for each the letter of its place in names, so that string distances are distances of sequences."""
    return F.array_join(F.transform(tags, lambda t: F.substring(F.lit(ALPHABET), F.array_position(names, t).cast("int"), F.lit(1))), "")


def structural_distance(a: Column, b: Column, most: int = MOST_TAGS) -> Column:
    """Edit distance of two tag sequences, each cut to `most` (MOST_TAGS at most), over the longer one's whole length, at most 1."""
    x, y = F.slice(a, 1, most), F.slice(b, 1, most)
    # The names of the pair are made once a row, not once a tag.
    letters = F.transform(F.array(F.array_distinct(F.concat(x, y))), lambda names: F.levenshtein(tag_letters(x, names), tag_letters(y, names)))
    return F.least(F.lit(1.0), F.get(letters, F.lit(0)) / F.greatest(F.size(a), F.size(b), F.lit(1)))


def tag_significance(tag: Column) -> Column:
    return F.when(tag.isin(*HIGH_TAGS), 1.0).when(tag.isin(*MEDIUM_TAGS), 0.5).when(tag.isin(*LOW_TAGS), 0.3).otherwise(0.4)


def tag_changes(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """A row for each tag whose count differs: key, tag, n_old, n_new, change, significance. a, b: arrays of tags."""
    side = lambda c, sign: pairs.select(key, F.explode(c).alias("tag"), F.lit(sign).alias("old"))
    counts = side(a, 1).union(side(b, 0)).groupBy(key, "tag").agg(F.sum("old").alias("n_old"), F.sum(1 - F.col("old")).alias("n_new"))
    changed = counts.where("n_old <> n_new")
    return changed.withColumn("change", F.when(F.col("n_new") > F.col("n_old"), "added").otherwise("removed")).withColumn("significance", tag_significance(F.col("tag")))


def nested_equal(tolerance: float):
    """Whether two JSON values agree: numbers within the tolerance, strings but for case and outer space, lists and objects member by member."""

    def same(x, y) -> bool:
        todo = [(x, y)]
        while todo:
            x, y = todo.pop()
            number = isinstance(x, (int, float)) and isinstance(y, (int, float))
            if x == y or number and abs(x - y) / max(abs(x), abs(y), 1e-10) <= tolerance or isinstance(x, str) and isinstance(y, str) and x.strip().lower() == y.strip().lower():
                continue
            if isinstance(x, list) and isinstance(y, list) and len(x) == len(y):
                todo += zip(x, y, strict=True)
            elif isinstance(x, dict) and isinstance(y, dict) and x.keys() == y.keys():
                todo += [(x[k], y[k]) for k in x]
            else:
                return False
        return True

    @F.pandas_udf(T.BooleanType())
    def equal(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y) -> bool:
            try:
                return x == y or x is not None and y is not None and same(json.loads(x), json.loads(y))
            except ValueError:
                return False

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return equal


def field_changes(old: DataFrame, new: DataFrame, key: str, tolerance: float = 0.01, nested: bool = True) -> DataFrame:
    """Differences of entities, from long tables (key, pos, field, type, value): key, pos, field, change, significance.

    Entities are paired by position. Values differ in type, or by more than the tolerance for numbers, or beyond case
    and outer space for strings; lists and objects arrive as JSON and are compared member by member by the same rules.
    """
    keep = lambda df, n: df.where(~F.col("field").isin(*IGNORED_FIELDS)).select(key, "pos", "field", F.col("type").alias(f"t{n}"), F.col("value").alias(f"v{n}"))
    both = keep(old, 0).join(keep(new, 1), [key, "pos", "field"], "full_outer")
    numeric = F.col("t0").isin("int", "float")
    x, y = F.col("v0").try_cast("double"), F.col("v1").try_cast("double")
    close = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-10)) <= tolerance
    equal = (F.col("v0") == F.col("v1")) | F.when(numeric, F.coalesce(close, F.lit(False))).when(F.col("t0") == "str", F.lower(F.trim("v0")) == F.lower(F.trim("v1"))).otherwise(F.lit(False))
    if nested:  # a column of its own: only such tables need Python
        both = both.withColumn("__same", nested_equal(tolerance)(F.when(F.col("t0").isin("list", "dict"), F.col("v0")), F.when(F.col("t0").isin("list", "dict"), F.col("v1"))))
        equal = equal | F.col("t0").isin("list", "dict") & F.col("__same")
    change = F.when(F.col("t0").isNull(), "added").when(F.col("t1").isNull(), "removed").when(F.col("t0") != F.col("t1"), "type_changed").when(~equal, "modified").otherwise("unchanged")
    names = F.lower("field")
    has = lambda words: F.rlike(names, F.lit("|".join(words)))
    text = F.when((F.length("v0") > 100) | (F.length("v1") > 100), 0.4).otherwise(0.6)
    modified = F.when(has(["price", "cost", "amount", "total"]), 1.0).when(has(["name", "title", "url", "status", "type"]), 0.8).when(numeric, 0.7).when(F.col("t0") == "str", text).otherwise(0.5)
    weight = F.when(F.col("change") == "added", 0.7).when(F.col("change") == "removed", 0.8).when(F.col("change") == "type_changed", 0.9).when(F.col("change") == "modified", modified)
    return both.withColumn("change", change).withColumn("significance", weight).select(key, "pos", "field", "change", "significance")


def entity_similarity(changes: DataFrame, key: str) -> DataFrame:
    """Share of unchanged fields; a field name that changed in any entity of the key is unchanged in none."""
    n = lambda c: F.count_if(F.col("change") == c)
    by_name = changes.groupBy(key, "field").agg(n("unchanged").alias("same"), n("added").alias("added"), n("removed").alias("removed"), (n("modified") + n("type_changed")).alias("changed"))
    steady = F.when((F.col("added") + F.col("removed") + F.col("changed")) == 0, F.col("same")).otherwise(0)
    out = by_name.groupBy(key).agg(F.sum(steady).alias("unchanged"), F.sum("changed").alias("changed"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    return out.withColumn("similarity", F.coalesce(F.try_divide(F.col("unchanged"), F.col("unchanged") + F.col("changed") + F.col("added") + F.col("removed")), F.lit(1.0)))


def change_score(signals: DataFrame, weights: dict[str, float] | None = None, no_change: float = 0.10, major: float = 0.60) -> DataFrame:
    """signals with columns dom, semantic, visual, entity (null: not measured) -> overall, category, n_signals.

    Weights are shared among the signals that are there; in the rules a missing signal counts as 0.
    """
    weights = weights or {"dom": 0.25, "semantic": 0.25, "visual": 0.25, "entity": 0.25}
    total = sum((F.when(F.col(s).isNotNull(), F.lit(w)).otherwise(0.0) for s, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(s), F.lit(0.0)) * w for s, w in weights.items()), F.lit(0.0))
    out = signals.withColumn("overall", F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(value, total))), F.lit(0.0)))
    out = out.withColumn("n_signals", sum((F.when(F.col(s).isNotNull(), 1).otherwise(0) for s in weights), F.lit(0)))
    dom, sem, ent = (F.coalesce(F.col(s), F.lit(0.0)) for s in ("dom", "semantic", "entity"))
    category = (
        F.when((F.col("n_signals") == 0) | (F.col("overall") < no_change), "no_change").when(F.col("overall") > major, "major_redesign").when((dom > 0.4) & (sem < 0.3), "layout_change")
        .when((ent > 0.3) & (dom < 0.2), "content_update").when(ent > 0.5, "new_content").otherwise("content_update")
    )
    return out.withColumn("category", category)


def average_hash(pixels: Column) -> Column:
    """Bits of a grey 8 x 8 picture (array of 64): 1 where brighter than the mean."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, p: s + p) / F.size(pixels)
    return F.transform(pixels, lambda p: F.when(p > mean, 1).otherwise(0))


def hash_similarity(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(average_hash(a), average_hash(b), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    return same / F.size(a)


@F.pandas_udf(T.DoubleType())
def structural_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """SSIM of two grey pictures of equal size over their whole area, by the usual constants; -1 where sizes differ."""

    def one(x, y) -> float:
        if x is None or y is None or len(x) != len(y) or not len(x):
            return -1.0
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
        cov = ((x - x.mean()) * (y - y.mean())).mean()
        return float((2 * x.mean() * y.mean() + c1) * (2 * cov + c2) / ((x.mean() ** 2 + y.mean() ** 2 + c1) * (x.var() + y.var() + c2)))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.LongType())
def perceptual_hash(pixels: pd.Series) -> pd.Series:
    """64 bits of a grey 32 x 32 picture (array of 1,024): which of its 8 x 8 lowest frequencies exceed their median, the lowest first; null for other sizes."""
    k, n = np.arange(8)[:, None], np.arange(32)[None, :]
    waves = np.cos(np.pi * k * (2 * n + 1) / 64)

    def one(x) -> int | None:
        if x is None or len(x) != 1024:
            return None
        low = waves @ np.asarray(x, dtype=float).reshape(32, 32) @ waves.T
        bits = (low > np.median(low)).ravel()
        return int(np.packbits(bits, bitorder="little").view(np.int64)[0])

    return pd.Series([one(x) for x in pixels], dtype="Int64")


def perceptual_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two perceptual hashes."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def windowed_similarity(width: int, window: int = 7):
    """SSIM of two grey pictures of some width: the mean over all windows inside, with sample covariances; -1 where sizes differ or no window fits."""

    def means(x: np.ndarray) -> np.ndarray:
        s = np.pad(x.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        return (s[window:, window:] - s[:-window, window:] - s[window:, :-window] + s[:-window, :-window]) / window**2

    @F.pandas_udf(T.DoubleType())
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
        sample = window**2 / (window**2 - 1)

        def one(x, y) -> float:
            if x is None or y is None or len(x) != len(y) or len(x) % width or min(width, len(x) // width) < window:
                return -1.0
            x, y = (np.asarray(v, dtype=float).reshape(-1, width) for v in (x, y))
            mx, my = means(x), means(y)
            vx, vy, vxy = sample * (means(x * x) - mx * mx), sample * (means(y * y) - my * my), sample * (means(x * y) - mx * my)
            return float(((2 * mx * my + c1) * (2 * vxy + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return similarity


def visual_similarity(hash_score: Column, ssim: Column) -> Column:
    """0.3 of the hash's and 0.7 of the structural similarity; the hash's alone where the other is negative."""
    return F.when(ssim < 0, hash_score).otherwise(0.3 * hash_score + 0.7 * ssim)
