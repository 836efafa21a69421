"""Complexity, model tier, cost and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import token_estimate


def structure_score(markdown: Column) -> Column:
    """Share of the lines that are headings, table rows or list items."""
    rows = F.split(markdown, "\n")
    return F.least(F.size(F.filter(rows, lambda x: F.rlike(F.trim(x), F.lit(r"^(#|\||- |\* |\d+\.\s)")))) / F.greatest(F.size(rows), F.lit(1)), F.lit(1.0))


def repeated_headings(markdown: Column) -> Column:
    """The largest number of headings on one level."""
    count = lambda n: F.regexp_count(markdown, F.lit(rf"(?m)^#{{{n}}}\s"))
    return F.greatest(*[count(n) for n in range(1, 7)])


def obfuscated(markdown: Column) -> Column:
    """Signs that markup hides its text: short text without structure, drawn text, or runs of numeric references."""
    text = F.regexp_replace(markdown, r"^\s+|\s+$", "")
    plain = (F.length(text) < 200) & ~F.contains(markdown, F.lit("![")) & ~F.rlike(text, F.lit(r"(?m)^[#\-*\d]")) & ~F.rlike(text, F.lit(r"[.!?]\s"))
    return plain | F.rlike(markdown, F.lit(r"(?i)canvas|webgl|svg.*text")) | F.rlike(markdown, F.lit(r"&#\d{4,};"))


def complexity(docs: DataFrame, text: str, history: str | None = None) -> DataFrame:
    """docs with tokens, structure, repeats, has_tables, is_obfuscated, complexity and tier; a tier in `history` overrides."""
    md = F.col(text)
    docs = docs.withColumns({"tokens": token_estimate(md), "structure": structure_score(md), "repeats": repeated_headings(md), "has_tables": F.rlike(md, F.lit(r"(?m)^\|.*\|$")), "is_obfuscated": obfuscated(md)})
    tokens, repeats = F.col("tokens"), F.col("repeats")
    score = (
        F.when(tokens < 1000, 0.05).when(tokens < 3000, 0.15).when(tokens < 10000, 0.25).otherwise(0.40)
        + (1 - F.col("structure")) * 0.25 - F.when(repeats > 5, 0.10).when(repeats > 2, 0.05).otherwise(0.0) + F.when(F.col("is_obfuscated"), 0.25).otherwise(0.0)
    )
    docs = docs.withColumn("complexity", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))
    tier = (
        F.when(F.col("is_obfuscated"), "vision").when((F.col("complexity") <= 0.3) & (tokens <= 3000), "local")
        .when((F.col("complexity") <= 0.6) & (tokens <= 15000), "fast").otherwise("frontier")
    )
    return docs.withColumn("tier", F.coalesce(F.col(history), tier) if history else tier)


def start_tier(tier: Column, mode: Column) -> Column:
    """Where a cascade starts: by cost mode, else by complexity."""
    return F.when(mode == "minimize", "local").when(mode == "accuracy", "frontier").otherwise(tier)


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "local", 0).when(tier == "fast", 1).when(tier == "frontier", 2).otherwise(3)


def cascade_order(registry: DataFrame, start: str = "local") -> DataFrame:
    """The models a cascade tries from a tier on: by tier, then by price. Vision models stand apart."""
    from ..sources import TIERS

    least = TIERS.index(start)
    ranked = registry.withColumn("rank", tier_rank(F.col("tier")))
    kept = ranked.where((F.col("rank") >= least) & ((F.col("tier") != "vision") | F.lit(start == "vision")))
    return kept.withColumn("place", F.row_number().over(Window.orderBy("rank", "usd_in", "seq"))).drop("rank")


def estimated_cost(calls: DataFrame, prices: DataFrame, model: str = "model", tokens_in: str = "tokens_in", tokens_out: str = "tokens_out") -> DataFrame:
    """calls with cost_usd. prices: seq, model_id (provider/name), usd_in, usd_out.

    A model without a price of its own is priced as the first in order whose provider its name begins with, else at 0.
    The price table is gathered into one row and sent to all tasks: it is a list of models, not data.
    """
    listed = prices.agg(F.array_sort(F.collect_list(F.struct("seq", "model_id", "usd_in", "usd_out"))).alias("__prices"))
    own = F.filter("__prices", lambda p: p["model_id"] == F.col(model))
    kin = F.filter("__prices", lambda p: F.startswith(F.col(model), F.split_part(p["model_id"], F.lit("/"), F.lit(1))))
    priced = calls.crossJoin(F.broadcast(listed)).withColumn("__price", F.coalesce(F.get(own, F.lit(0)), F.get(kin, F.lit(0))))
    price = lambda name: F.coalesce(F.col("__price")[name], F.lit(0.0))
    cost = (F.col(tokens_in) * price("usd_in") + F.col(tokens_out) * price("usd_out")) / 1_000_000
    return priced.withColumn("cost_usd", cost).drop("__prices", "__price")


def cascade_outcome(attempts: DataFrame, key: str, ceiling: float = 0.10, accept: float = 0.5) -> DataFrame:
    """How each page's cascade ends, from a table of what every attempt would give (key, place, model_id, confidence, cost_usd).

    An attempt is made while the sum spent before it is below the ceiling and none before it was accepted. The accepted
    attempt wins, else the most confident (the first of ties).
    """
    before = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    tried = attempts.withColumn("spent", F.coalesce(F.sum("cost_usd").over(before), F.lit(0.0))).withColumn("done", F.coalesce(F.max((F.col("confidence") >= accept).cast("int")).over(before), F.lit(0)))
    made = tried.where((F.col("spent") < ceiling) & (F.col("done") == 0))
    return made.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("cost_usd").alias("total_cost"),
        F.max_by("model_id", F.struct(F.col("confidence"), -F.col("place"))).alias("final_model"), F.max("confidence").alias("confidence"),
    ).withColumn("all_failed", F.col("confidence") < accept)


def reattempt(first_missing: Column, second_missing: Column, first: Column, second: Column) -> Column:
    """The second of two extractions if it misses fewer fields, else the first."""
    return F.when(second_missing < first_missing, second).otherwise(first)


def needs_vision(confidence: Column, threshold: float = 0.5) -> Column:
    return F.coalesce(confidence < threshold, F.lit(True))


# Dollars for each kind of challenge.
CHALLENGE_USD = {"recaptcha_v2": 0.003, "hcaptcha": 0.003, "image_grid": 0.002, "text_math": 0.001, "slider": 0.002, "geetest": 0.004, "rotate": 0.002, "funcaptcha": 0.005}


def challenge_cost(kind: Column) -> Column:
    """What a challenge of some kind is charged at; 0.003 for others."""
    out = F.lit(0.003)
    for name, usd in CHALLENGE_USD.items():
        out = F.when(kind == name, usd).otherwise(out)
    return out
