"""Tables, views, references to stored blobs, and the sinks that write them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(df: DataFrame, name: str) -> DataFrame:
    """df, also under a name for SQL. Names are plain identifiers, so none can smuggle SQL in."""
    if not NAME.match(name):
        raise ValueError(f"not a view name: {name!r}")
    df.createOrReplaceTempView(name)
    return df


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    for name in names:
        view(table(spark, sf_dir, name), name)


def load_json(spark: SparkSession, name: str, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """JSON lines (or whole documents) as a view; a schema spares the pass that infers one."""
    reader = spark.read.option("multiLine", multi_line)
    return view((reader.schema(schema) if schema else reader).json(path), name)


def load_parquet(spark: SparkSession, name: str, path: str) -> DataFrame:
    return view(spark.read.parquet(path), name)


def load_records(spark: SparkSession, name: str, records: list[dict], schema: str | None = None) -> DataFrame | None:
    """Records in memory as a view; nothing happens if there are none."""
    return view(spark.createDataFrame(records, schema), name) if records else None


def parse_reference(ref: Column, scheme: str = "minio") -> Column:
    """bucket and path of a blob reference such as scheme://bucket/path; nulls where it is malformed."""
    pattern = rf"^{scheme}://([^/]+)/(.+)$"
    part = lambda n: F.nullif(F.regexp_extract(ref, pattern, n), F.lit(""))
    return F.struct(part(1).alias("bucket"), part(2).alias("path"))


def blob_path(kind: str, job_id: Column, at: Column, extension: str, scheme: str = "minio", bucket: str = "raw-html") -> Column:
    """The reference under which a payload of a job is kept."""
    return F.concat(F.lit(f"{scheme}://{bucket}/{kind}/"), job_id.cast("string"), F.lit("/"), F.date_format(at, "yyyyMMdd'T'HHmmss"), F.lit(f".{extension}"))


def resolve_references(rows: DataFrame, blobs: DataFrame, ref_col: str = "raw_html_ref", key_col: str = "ref", value_col: str = "content") -> DataFrame:
    """rows with the payloads their references name; payloads join last, so earlier steps move keys alone."""
    return rows.join(blobs.select(F.col(key_col).alias(ref_col), F.col(value_col)), ref_col, "left")


def read_blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as rows of ref and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("ref"), "content")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir or the context names it.

    Where neither is set, a session on one machine gets a new temporary folder; on a cluster that is an error, for each
    executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='pagemill-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that this process has written, oldest first; and the lists of those who asked, in this thread, for what is written meanwhile.
STORED: list[str] = []
_RECORDERS: ContextVar[tuple[list[str], ...]] = ContextVar("recorders", default=())


@contextmanager
def recording() -> Iterator[list[str]]:
    """The folders written inside the block, by this thread alone: what discard() may remove without touching another run's tables."""
    paths: list[str] = []
    token = _RECORDERS.set((*_RECORDERS.get(), paths))
    try:
        yield paths
    finally:
        _RECORDERS.reset(token)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in (STORED, *_RECORDERS.get()):
        paths.append(path)
    return path


def materialised(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written once to the shared folder (with options of the writer) and read back. The folder stays until discard(), forget() or the caller removes it."""
    path = fresh_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of any file system that Spark reaches."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders that recording() has named; tables read from there can no longer be read."""
    remove(spark, paths)
    for path in paths:
        if path in STORED:
            STORED.remove(path)


def forget(spark: SparkSession, since: int = 0, upto: int | None = None) -> None:
    """Remove what this process has stored from number `since` on, up to but not including number `upto`; for a process with one run at a time."""
    discard(spark, STORED[since:upto])


def store_blobs(rows: DataFrame, path: str, ref: str = "ref", content: str = "content") -> None:
    """Payloads (screenshots, markup) as a table of ref and content that resolve_references() joins: many small blobs in few files."""
    rows.select(F.col(ref).alias("ref"), F.col(content).cast("binary").alias("content")).write.mode("append").parquet(path)


def store_results(rows: DataFrame, path: str, key: str = "job_id") -> DataFrame:
    """Extraction results as JSON payloads under a reference each, stored as blobs; returns rows with result_ref."""
    refs = rows.withColumn("result_ref", F.concat(F.lit("minio://extraction-results/results/"), F.col(key).cast("string"), F.lit(".json")))
    store_blobs(refs.select(F.col("result_ref").alias("ref"), F.to_json(F.struct(*rows.columns)).alias("content")), path)
    return refs


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """A parquet table in folders by some columns, one file a folder and task group."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


# Models with tier, context window, dollars per million tokens in and out, and usual latency, in order.
MODELS = (
    ("ollama/qwen3:32b", "local", 32768, 0.0, 0.0, 3000),
    ("ollama/qwen3:8b", "local", 32768, 0.0, 0.0, 1500),
    ("ollama/gemma3:27b", "local", 128000, 0.0, 0.0, 2500),
    ("gemini/gemini-2.5-flash", "fast", 1048576, 0.15, 0.60, 2000),
    ("gemini/gemini-2.0-flash", "fast", 1048576, 0.10, 0.40, 1500),
    ("gemini/gemini-2.5-pro", "frontier", 1048576, 1.25, 10.0, 5000),
    ("ollama/qwen3-vl:32b", "vision", 32768, 0.0, 0.0, 4000),
)
TIERS = ("local", "fast", "frontier", "vision")


def models(spark: SparkSession) -> DataFrame:
    """The registry: a handful of rows, so it may be sent to every task."""
    rows = [(i, *m) for i, m in enumerate(MODELS)]
    return spark.createDataFrame(rows, "seq int, model_id string, tier string, context_window int, usd_in double, usd_out double, latency_ms int")


# Dollars per million tokens in and out, by model, in the order in which a provider's first is looked for.
PRICES = (
    ("gemini/gemini-2.5-pro", 1.25, 10.0),
    ("gemini/gemini-2.5-flash", 0.15, 0.60),
    ("gemini/gemini-2.0-flash", 0.10, 0.40),
    ("openai/gpt-4o", 2.50, 10.0),
    ("openai/gpt-4o-mini", 0.15, 0.60),
    ("openai/o3-mini", 1.10, 4.40),
    ("anthropic/claude-sonnet-4-20250514", 3.0, 15.0),
    ("anthropic/claude-haiku-3.5", 0.80, 4.0),
    ("ollama/qwen3:32b", 0.0, 0.0),
    ("ollama/qwen3:8b", 0.0, 0.0),
    ("ollama/llama4-scout", 0.0, 0.0),
    ("ollama/phi-4", 0.0, 0.0),
    ("ollama/gemma3:27b", 0.0, 0.0),
)


def prices(spark: SparkSession) -> DataFrame:
    """The price table, apart from the registry: it has models that no cascade tries."""
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PRICES)], "seq int, model_id string, usd_in double, usd_out double")


#: The same relation in ANSI SQL, for queries that run elsewhere.
MODELS_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{m[0]}', '{m[1]}', {m[2]}, CAST({m[3]} AS DOUBLE), CAST({m[4]} AS DOUBLE), {m[5]})" for i, m in enumerate(MODELS)) + ") AS m(seq, model_id, tier, context_window, usd_in, usd_out, latency_ms))"

#: Synthetic: what extracting four fields from each page would log, derived from the page alone. Runs on both engines.
EXTRACTION_RESULTS_SQL = f"""
SELECT e.page_id, e.source_url, e.model_used, e.title, e.heading, e.lang, e.paragraph, e.tokens_input, 40 * e.field_count AS tokens_output,
       e.field_count, CAST(e.field_count AS DOUBLE) / 4 AS confidence, 100 + e.page_id % 900 AS elapsed_ms,
       (e.tokens_input * m.usd_in + 40 * e.field_count * m.usd_out) / 1000000 AS estimated_cost_usd
FROM (SELECT page_id, source_url, title, heading, lang, paragraph, tokens_input, seq,
             CASE seq WHEN 0 THEN 'ollama/qwen3:32b' WHEN 1 THEN 'gemini/gemini-2.5-flash' WHEN 2 THEN 'gemini/gemini-2.0-flash' ELSE 'gemini/gemini-2.5-pro' END AS model_used,
             CASE WHEN title <> '' THEN 1 ELSE 0 END + CASE WHEN heading <> '' THEN 1 ELSE 0 END
             + CASE WHEN lang <> '' THEN 1 ELSE 0 END + CASE WHEN LENGTH(paragraph) > 120 THEN 1 ELSE 0 END AS field_count
      FROM (SELECT page_id, url AS source_url, page_id % 4 AS seq, CAST(FLOOR(LENGTH(html) / 4.0) AS BIGINT) AS tokens_input,
                   REGEXP_EXTRACT(html, '<title>([^<]*)</title>', 1) AS title, REGEXP_EXTRACT(html, '<h1>([^<]*)</h1>', 1) AS heading,
                   REGEXP_EXTRACT(html, '<html lang="([^"]*)"', 1) AS lang, REGEXP_EXTRACT(html, '<p>([^<]*)', 1) AS paragraph
            FROM pages) p) e
JOIN {MODELS_SQL} m ON m.model_id = e.model_used
"""


def extraction_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ("pages",))
    return spark.sql(EXTRACTION_RESULTS_SQL)
