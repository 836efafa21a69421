"""Ad-hoc SQL and the roll-ups over extraction results."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domain_of


@dataclass
class QueryResult:
    """Columns and rows of a small result, or the error instead of them."""

    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    error: str | None = None

    def to_dicts(self) -> list[dict[str, Any]]:
        return [dict(zip(self.columns, r, strict=True)) for r in self.rows]

    def to_markdown(self) -> str:
        if not self.columns:
            return "_No results_"
        line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
        return "\n".join([line(self.columns), line(["---"] * len(self.columns)), *map(line, self.rows)])


def query(spark: SparkSession, sql: str, most: int | None = None) -> QueryResult:
    """Run SQL over the registered views; a failure is told in the result. All rows reach the driver, or an error beyond `most`."""
    try:
        df = spark.sql(sql)
        rows = [tuple(r) for r in (df if most is None else df.limit(most + 1)).collect()]
        if most is not None and len(rows) > most:
            return QueryResult(df.columns, error=f"more than {most} rows")
        return QueryResult(df.columns, rows)
    except Exception as e:  # noqa: BLE001  the caller asked for errors as values
        return QueryResult(error=str(e))


def accuracy_by_model(results: DataFrame) -> DataFrame:
    return results.groupBy("model_used").agg(
        F.count(F.lit(1)).alias("total_extractions"), F.avg("confidence").alias("avg_confidence"), F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"), F.sum("estimated_cost_usd").alias("total_cost_usd"), F.avg(F.col("tokens_input") + F.col("tokens_output")).alias("avg_tokens"),
    ).orderBy(F.desc("avg_confidence"), "model_used")


def cost_per_field(results: DataFrame) -> DataFrame:
    return results.where("field_count > 0").groupBy("model_used").agg(
        F.count(F.lit(1)).alias("extractions"), F.sum("estimated_cost_usd").alias("total_cost"),
        F.try_divide(F.sum("estimated_cost_usd"), F.sum("field_count")).alias("cost_per_field"), F.avg("elapsed_ms").alias("avg_latency_ms"),
    ).orderBy("cost_per_field", "model_used")


def domain_success_rates(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    return results.groupBy(domain_of(F.col("source_url")).alias("domain")).agg(
        F.count(F.lit(1)).alias("total_crawls"), F.count_if(F.col("confidence") > threshold).alias("successful"), F.avg("confidence").alias("avg_confidence"),
    ).orderBy(F.desc("total_crawls"), "domain")


def completeness_report(results: DataFrame, fields: int) -> DataFrame:
    """Fields found of all expected, by model."""
    return results.groupBy("model_used").agg(
        F.sum("field_count").alias("found"), (F.count(F.lit(1)) * fields).alias("expected"),
    ).withColumn("completeness", F.coalesce(F.try_divide(F.col("found"), F.col("expected")), F.lit(0.0)))
