"""Queries over jobs, models, telemetry and the star schema, each with the SQL that gives the same rows."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import streaming
from ..functions import backoff_seconds, domain_of, http_class, netloc, png_size
from ..operators import analytics, jobs, ranges, telemetry
from ..sources import EXTRACTION_RESULTS_SQL, extraction_results, fresh_folder, load_json, load_records, parse_reference, register, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


WITH_RESULTS = f"WITH extraction_results AS ({EXTRACTION_RESULTS_SQL}) "


@query(WITH_RESULTS + """SELECT REGEXP_EXTRACT(source_url, '^https?://([^/]+)', 1) AS domain, COUNT(*) AS total_crawls,
  SUM(CASE WHEN confidence > 0.5 THEN 1 ELSE 0 END) AS successful, AVG(confidence) AS avg_confidence FROM extraction_results GROUP BY 1""")
def domain_success_rates(spark: SparkSession, d: str) -> DataFrame:
    return analytics.domain_success_rates(extraction_results(spark, d))


@query(WITH_RESULTS + """SELECT model_used, COUNT(*) AS total_extractions, AVG(confidence) AS avg_confidence, MIN(confidence) AS min_confidence,
  MAX(confidence) AS max_confidence, SUM(estimated_cost_usd) AS total_cost_usd, AVG(tokens_input + tokens_output) AS avg_tokens FROM extraction_results GROUP BY 1""")
def accuracy_by_model(spark: SparkSession, d: str) -> DataFrame:
    return analytics.accuracy_by_model(extraction_results(spark, d))


@query(WITH_RESULTS + """SELECT model_used, COUNT(*) AS extractions, SUM(estimated_cost_usd) AS total_cost, SUM(estimated_cost_usd) / NULLIF(SUM(field_count), 0) AS cost_per_field,
  AVG(elapsed_ms) AS avg_latency_ms FROM extraction_results WHERE field_count > 0 GROUP BY 1""")
def cost_per_field(spark: SparkSession, d: str) -> DataFrame:
    return analytics.cost_per_field(extraction_results(spark, d))


@query(WITH_RESULTS + """SELECT model_used, CAST(SUM(field_count) AS BIGINT) AS found, COUNT(*) * 4 AS expected, SUM(field_count) / (COUNT(*) * 4.0) AS completeness FROM extraction_results GROUP BY 1""")
def completeness_report(spark: SparkSession, d: str) -> DataFrame:
    return analytics.completeness_report(extraction_results(spark, d), 4)


@query(WITH_RESULTS + """SELECT SUM(CASE WHEN confidence >= 0.5 THEN 1 ELSE 0 END) AS completed, SUM(CASE WHEN confidence < 0.5 THEN 1 ELSE 0 END) AS failed,
  AVG(elapsed_ms) AS avg_elapsed_ms, SUM(estimated_cost_usd) AS total_cost, BOOL_AND(confidence >= 0.5) AS all_ok FROM extraction_results""")
def extraction_health(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.extraction_health(extraction_results(spark, d), F.col("confidence") >= 0.5, "elapsed_ms", "estimated_cost_usd")


@query(WITH_RESULTS + """SELECT model_used, avg_confidence, avg_confidence / MAX(avg_confidence) OVER () AS bar FROM (SELECT model_used, AVG(confidence) AS avg_confidence FROM extraction_results GROUP BY 1)""")
def model_bars(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.bars(extraction_results(spark, d).groupBy("model_used").agg(F.avg("confidence").alias("avg_confidence")), "avg_confidence")


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS quantity FROM lineitem WHERE l_quantity > 10 GROUP BY ALL")
def ad_hoc_sql(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, ("lineitem",))
    return spark.sql("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS quantity FROM lineitem WHERE l_quantity > 10 GROUP BY ALL")


@query("SELECT page_id, url FROM pages WHERE url LIKE '%/de/%'")
def parquet_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(F.col("url").like("%/de/%")).select("page_id", "url")


@query("SELECT event_id, JSON_EXTRACT_STRING(props, '$.k') AS k FROM events WHERE JSON_EXTRACT_STRING(props, '$.k') > '5'")
def event_props_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k > '5'")


# Synthetic: orders as jobs. An order passes through states by its status letter, so the log has two or three rows a job.
JOB_LOG = """SELECT o_orderkey AS job_id, o_custkey AS owner, s.seq, s.status, o_orderdate + s.days AS changed_at FROM orders,
  (VALUES (1, 'pending', INTERVAL '0' DAY), (2, 'running', INTERVAL '1' DAY), (3, 'completed', INTERVAL '2' DAY)) AS s(seq, status, days)
  WHERE s.seq <= CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END"""


def job_log(spark: SparkSession, d: str) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(s).alias("status")) for i, s in ((1, "pending"), (2, "running"), (3, "completed"))])
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("owner"), "o_orderstatus", "o_orderdate", F.explode(steps).alias("s"))
    last = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(3)
    at = F.col("o_orderdate") + F.make_dt_interval(F.col("s.seq") - 1)
    return o.where(F.col("s.seq") <= last).select("job_id", "owner", "s.seq", "s.status", at.alias("changed_at"))


@query(f"""WITH log AS ({JOB_LOG}) SELECT job_id, owner, seq, status, changed_at, CASE WHEN status = 'completed' THEN changed_at END AS completed_at, 0 AS retry_count
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY changed_at DESC, seq DESC) AS r FROM log) WHERE r = 1""")
def job_status_latest(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest_state(job_log(spark, d), at="changed_at")


@query(f"WITH log AS ({JOB_LOG}) SELECT status, COUNT(*) AS n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY changed_at DESC, seq DESC) AS r FROM log) WHERE r = 1 AND status NOT IN ('completed', 'failed', 'cancelled') GROUP BY 1")
def cancellable_jobs(spark: SparkSession, d: str) -> DataFrame:
    return jobs.can_cancel(jobs.latest_state(job_log(spark, d), at="changed_at")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH log AS ({JOB_LOG}), b AS (SELECT *, LAG(status) OVER (PARTITION BY job_id ORDER BY changed_at, seq) AS before FROM log WHERE seq <> 2)
  SELECT job_id, owner, seq, status, changed_at, before FROM b WHERE before = 'pending' AND status = 'completed'""")
def illegal_job_moves(spark: SparkSession, d: str) -> DataFrame:
    return jobs.illegal_moves(job_log(spark, d).where("seq <> 2"), at="changed_at")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20")
def job_page(spark: SparkSession, d: str) -> DataFrame:
    kept = jobs.by_status(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), "F")
    return jobs.page_of(kept, [F.desc("o_orderdate"), "o_orderkey"], 50, 20).select("o_orderkey", "o_totalprice")


@query("""SELECT o_custkey, o_orderkey, version, LAG(h) OVER w AS previous_hash, LEAD(h) OVER w AS next_hash, h AS schema_hash FROM
  (SELECT o_custkey, o_orderkey, o_orderdate, SUBSTR(SHA256(o_orderpriority), 1, 16) AS h, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders)
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def entity_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("schema_hash", F.substring(F.sha2("o_orderpriority", 256), 1, 16))
    return jobs.with_versions(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "version", "previous_hash", "next_hash", "schema_hash")


@query("SELECT o_custkey, COALESCE(MAX(o_orderkey), 0) + 1 AS next_version FROM orders GROUP BY 1")
def next_entity_version(spark: SparkSession, d: str) -> DataFrame:
    return jobs.next_version(table(spark, d, "orders"), ["o_custkey"], "o_orderkey")


@query("SELECT o.o_orderkey, COUNT(l.l_orderkey) AS attempts FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1")
def job_attempt_join(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("attempts"))  # counted before the join
    return jobs.with_attempts(table(spark, d, "orders").select("o_orderkey"), counted, "o_orderkey").fillna(0, ["attempts"])


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jobs_with_attempts(spark: SparkSession, d: str) -> DataFrame:
    return jobs.with_attempts(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jobs_without_attempts(spark: SparkSession, d: str) -> DataFrame:
    return jobs.with_attempts(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT p.event_id, p.user_id, p.ts, c.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
  ASOF LEFT JOIN (SELECT user_id, ts, MAX(value) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts) c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def asof_last_click(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return jobs.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "ts", "value")


@query("""SELECT 'ref' || o_orderkey AS ref_id, REGEXP_EXTRACT('minio://raw-html/raw/' || o_orderkey || '.html', '^minio://([^/]+)/(.+)$', 1) AS bucket,
  REGEXP_EXTRACT('minio://raw-html/raw/' || o_orderkey || '.html', '^minio://([^/]+)/(.+)$', 2) AS path FROM orders""")
def reference_parse(spark: SparkSession, d: str) -> DataFrame:
    ref = F.concat(F.lit("minio://raw-html/raw/"), F.col("o_orderkey").cast("string"), F.lit(".html"))
    return table(spark, d, "orders").select(F.concat(F.lit("ref"), F.col("o_orderkey").cast("string")).alias("ref_id"), parse_reference(ref).alias("r")).select("ref_id", "r.bucket", "r.path")


@query("SELECT REGEXP_EXTRACT(url, '^https?://([^/]+)', 1) AS domain, COUNT(*) AS n FROM pages GROUP BY 1")
def pages_by_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(domain_of(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 500 WHEN 5 THEN 302 END AS status,
  CASE l_linenumber % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'retry' WHEN 2 THEN 'fatal' WHEN 3 THEN 'retry' WHEN 4 THEN 'error' WHEN 5 THEN 'ok' ELSE 'network' END AS outcome,
  LEAST(60.0, POW(2.0, l_linenumber - 1)) AS wait FROM lineitem""")
def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    status = F.get(F.array(*[F.lit(x) for x in (200, 403, 404, 429, 500, 302)]), F.col("l_linenumber") % 7)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", status.alias("status"))
    return rows.withColumn("outcome", http_class(F.col("status"))).withColumn("wait", backoff_seconds(F.col("l_linenumber")))


@query("""SELECT event_type, le, COUNT(*) FILTER (WHERE value <= le OR le IS NULL) AS count, COUNT(*) AS n, SUM(value) AS total
  FROM events, (VALUES (0.1), (0.25), (0.5), (1.0), (2.5), (5.0), (10.0), (25.0), (NULL)) AS b(le) GROUP BY event_type, le""")
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.histogram(table(spark, d, "events"), "value", telemetry.BUCKETS["crawl_seconds"], ["event_type"])


@query("SELECT event_type, user_id, COUNT(*) AS value FROM events GROUP BY ALL")
def label_counters(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.counters(table(spark, d, "events"), ["event_type", "user_id"])


@query("SELECT user_id, ARG_MAX(value, STRUCT_PACK(ts := ts, id := event_id)) AS value FROM events GROUP BY 1")
def label_gauges(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.gauges(table(spark, d, "events"), ["user_id"], "value", "ts", "event_id")


@query("""SELECT COUNT(*) FILTER (WHERE event_type = 'click') AS n_click, COUNT(*) FILTER (WHERE event_type = 'error') AS n_error, COUNT(*) FILTER (WHERE event_type = 'purchase') AS n_purchase,
  COUNT(*) FILTER (WHERE event_type = 'view') AS n_view, COUNT(*) AS n_all FROM events""")
def feed_counts(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.feed_counts(table(spark, d, "events"), "event_type", ("click", "error", "purchase", "view"))


@query("SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def feed_ring(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.latest(table(spark, d, "events"), [F.desc("ts"), F.desc("event_id")]).select("event_id", "event_type", "ts")


@query("""SELECT p_brand, COUNT(*) AS encounters, COUNT(*) FILTER (WHERE p_size > 20) AS passed, COUNT(*) FILTER (WHERE p_size <= 5) AS blocked,
  COUNT(*) FILTER (WHERE p_size > 20) / COUNT(*)::DOUBLE AS pass_rate FROM part GROUP BY 1""")
def vendor_rates(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.rates(table(spark, d, "part"), "p_brand", F.col("p_size") > 20, F.col("p_size") <= 5)


@query("SELECT event_type, COUNT(*) AS n FROM events WHERE ts > (SELECT MAX(ts) FROM events) - INTERVAL 72 HOUR GROUP BY 1")
def retention_72h(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.recent(table(spark, d, "events"), "ts").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


ISLANDS = """SELECT user_id, island, SUM(f) AS n FROM (SELECT user_id, f, SUM(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, CASE WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END AS f FROM events)) GROUP BY ALL"""


@query(f"SELECT user_id, MAX(n) AS longest, ARG_MAX(n, island) AS current FROM ({ISLANDS}) GROUP BY 1")
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.streaks(table(spark, d, "events"), "user_id", F.col("event_type").isin("error", "view"), ["ts", "event_id"])


PROXIES = f"""WITH s AS (SELECT user_id, ARG_MAX(n, island) AS current FROM ({ISLANDS}) GROUP BY 1),
  t AS (SELECT user_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE event_type NOT IN ('error', 'view')) AS n_ok, COUNT(*) FILTER (WHERE event_type = 'error') AS n_blocked,
    COALESCE(AVG(value * 100) FILTER (WHERE event_type NOT IN ('error', 'view')), 0) AS latency FROM events GROUP BY 1),
  h AS (SELECT user_id, total, 0.4 * n_ok / total::DOUBLE + 0.3 * (1 - n_blocked / total::DOUBLE) + 0.3 * GREATEST(0.0, 1 - latency / 10000) AS health, current AS failures_in_a_row,
    CASE WHEN current >= 5 THEN 'quarantined' WHEN n_ok / total::DOUBLE < 0.5 OR current >= 3 THEN 'degraded' ELSE 'healthy' END AS status FROM t JOIN s USING (user_id)) """


def _proxies(spark: SparkSession, d: str) -> DataFrame:
    ok = ~F.col("event_type").isin("error", "view")
    return telemetry.proxy_health(table(spark, d, "events"), "user_id", ok, F.col("event_type") == "error", F.col("value") * 100, ["ts", "event_id"])


@query(PROXIES + "SELECT user_id, total, ROUND(health, 9) AS health, failures_in_a_row, status FROM h")
def proxy_health(spark: SparkSession, d: str) -> DataFrame:
    return _proxies(spark, d).withColumn("health", F.round("health", 9))


@query(PROXIES + """SELECT user_id % 3 AS tier, COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'healthy') AS healthy, COUNT(*) FILTER (WHERE status = 'degraded') AS degraded,
  COUNT(*) FILTER (WHERE status = 'quarantined') AS quarantined, ROUND(AVG(health), 3) AS avg_health FROM h GROUP BY 1""")
def proxy_pool_stats(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.pool_stats(_proxies(spark, d), F.col("user_id") % 3)


@query(PROXIES + """SELECT tier, place, user_id, ROUND(health, 9) AS health FROM (SELECT user_id % 3 AS tier, user_id, health, ROW_NUMBER() OVER (PARTITION BY user_id % 3 ORDER BY health DESC, user_id) AS place
  FROM h WHERE status <> 'quarantined') WHERE place <= 3""")
def best_proxies(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.best_proxies(_proxies(spark, d), F.col("user_id") % 3, "user_id").withColumn("health", F.round("health", 9))


@query("""SELECT user_id, last_at, refreshes, age, age > 86400 AS expired, age > 0.8 * 86400 AS due FROM (SELECT user_id, MAX(ts) AS last_at, COUNT(*) - 1 AS refreshes,
  DATE_DIFF('second', DATE_TRUNC('second', MAX(ts)), TIMESTAMP '2024-01-31 00:00:00') AS age FROM events GROUP BY 1)""")
def credential_expiry(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.time_to_live(table(spark, d, "events"), "user_id", "ts", F.to_timestamp(F.lit("2024-01-31 00:00:00")), 86400)


@query("SELECT DATE_TRUNC('hour', ts) AS start, event_type, COUNT(*) AS n, SUM(value) AS total FROM events GROUP BY ALL")
def tumbling_activity(spark: SparkSession, d: str) -> DataFrame:
    return streaming.windowed(table(spark, d, "events"), ["event_type"], "value", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT DATE_TRUNC('hour', ts) - k.h * INTERVAL 1 HOUR AS start, event_type, COUNT(*) AS n, SUM(value) AS total FROM events, (VALUES (0), (1), (2)) AS k(h) GROUP BY ALL""")
def sliding_activity(spark: SparkSession, d: str) -> DataFrame:
    return streaming.windowed(table(spark, d, "events"), ["event_type"], "value", "3 hours", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH m AS (SELECT user_id, ts, event_id, CASE WHEN ts >= LAG(ts) OVER w + INTERVAL 30 MINUTE OR LAG(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m)
  SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL 30 MINUTE AS "end", COUNT(*) AS n FROM s GROUP BY user_id, session""")
def session_activity(spark: SparkSession, d: str) -> DataFrame:
    out = streaming.sessions(table(spark, d, "events"), "user_id")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT COUNT(DISTINCT STRUCT_PACK(u := user_id, t := event_type)) AS n FROM events")
def deduplicated_events(spark: SparkSession, d: str) -> DataFrame:
    return streaming.once(table(spark, d, "events"), ["user_id", "event_type"]).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT r_name, n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup_revenue(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    joined = joined.join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, GROUPING(o_orderstatus) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, d, "orders").groupingSets([[a], [b]], a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping("o_orderstatus").cast("long").alias("g"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("SELECT l_returnflag, QUANTILE_CONT(l_extendedprice, 0.5) AS p50, QUANTILE_CONT(l_extendedprice, 0.95) AS p95, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles by places over ranges: no task holds a group's values."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_suppkey")
    found = ranges.quantiles(rows, ["l_returnflag"], "l_extendedprice", [0.5, 0.95], "q").select(F.col("l_returnflag").alias("flag"), "q")
    counts = rows.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"))
    both = counts.join(found, F.col("l_returnflag").eqNullSafe(F.col("flag")), "left")
    return both.select("l_returnflag", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), "suppliers")


def with_exact(about: DataFrame, rows: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """The estimates `about` and `median` of each group beside the exact count of keys and median, with whether they are within 5 % and between the 45th and 55th percentile.

    Exact counts shuffle distinct keys, exact percentiles are told by places over ranges: no task holds a group. An estimated
    median is one of the values, so it is held to the values around those percentiles. What is no number is above all
    numbers, as in the exact percentiles; a group without values has no median and nothing to miss.
    """
    counts = rows.groupBy(F.col(by).alias("__c")).agg(F.count_distinct(key).alias("exact"))
    places = ranges.quantiles(rows, [by], value, [0.45, 0.5, 0.55], "q", around="at").withColumnRenamed(by, "__q")
    both = about.join(counts, F.col(by).eqNullSafe(F.col("__c"))).join(places, F.col(by).eqNullSafe(F.col("__q")), "left")
    close = F.abs(F.col("about") - F.col("exact")) <= 0.05 * F.col("exact")
    low, median, high = (F.nanvl(c, F.lit(float("inf"))) for c in (F.col("at")[0]["low"], F.col("median"), F.col("at")[2]["high"]))
    inside = F.coalesce(median.between(low, high), F.col("q").isNull())
    return both.select(*about.columns, "exact", close.alias("close"), inside.alias("inside"), F.col("q")[1].alias("p50"))


@query("SELECT l_returnflag, COUNT(DISTINCT l_orderkey) AS orders, TRUE AS orders_close, TRUE AS median_close, QUANTILE_CONT(l_extendedprice::DOUBLE, 0.5) AS p50 FROM lineitem GROUP BY 1")
def approximate_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts of orders and median prices, and whether the estimates (2 % standard error) come near them."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", F.col("l_extendedprice").cast("double").alias("price"))
    about = rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("about"), F.approx_percentile("price", 0.5).alias("median"))
    found = with_exact(about, rows, "l_returnflag", "l_orderkey", "price")
    return found.select("l_returnflag", F.col("exact").alias("orders"), F.col("close").alias("orders_close"), F.col("inside").alias("median_close"), "p50")


@query("SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, TRUE AS users_close, TRUE AS median_close, QUANTILE_CONT(value::DOUBLE, 0.5) AS p50 FROM events GROUP BY 1")
def merged_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sketches by type and day, as a rollup would store them, merged by type: distinct users (HLL) and the median value (KLL), held to the exact ones."""
    rows = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "user_id", F.col("value").cast("double").alias("value"))
    daily = rows.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("user_id").alias("users"), F.kll_sketch_agg_double(F.nanvl("value", F.lit(float("inf")))).alias("values"))
    merged = daily.groupBy("event_type").agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("about"), F.kll_merge_agg_double("values").alias("values"))
    median = F.when(F.kll_sketch_get_n_double("values") > 0, F.kll_sketch_get_quantile_double("values", F.lit(0.5)))  # an empty sketch has none
    about = merged.select("event_type", "n", "about", median.alias("median"))
    found = with_exact(about, rows, "event_type", "user_id", "value")
    return found.select("event_type", "n", F.col("exact").alias("users"), F.col("close").alias("users_close"), F.col("inside").alias("median_close"), "p50")


@query("""SELECT c_custkey, o_orderkey, RANK() OVER w AS r, DENSE_RANK() OVER w AS dr, NTILE(4) OVER (PARTITION BY c_custkey ORDER BY o_totalprice, o_orderkey) AS q,
  SUM(o_totalprice) OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving FROM customer JOIN orders ON o_custkey = c_custkey
  WINDOW w AS (PARTITION BY c_custkey ORDER BY o_totalprice)""")
def window_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_custkey")
    moving = F.sum("o_totalprice").over(w.orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0))
    return rows.select("c_custkey", "o_orderkey", F.rank().over(w.orderBy("o_totalprice")).alias("r"), F.dense_rank().over(w.orderBy("o_totalprice")).alias("dr"), F.ntile(4).over(w.orderBy("o_totalprice", "o_orderkey")).alias("q"), moving.alias("moving"))


@query("SELECT c_custkey AS customer, c_name AS name, c_acctbal AS balance FROM customer")
def json_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines and read back under a name."""
    path = fresh_folder(spark, "json")
    table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).write.json(path)
    return load_json(spark, "customers_as_json", path, "customer long, name string, balance double")


LANGUAGES = {"de": "German", "en": "English", "es": "Spanish", "fr": None}


@query("""SELECT t.name AS language, COUNT(*) AS n, CAST(SUM(LENGTH(text)) AS BIGINT) AS chars FROM documents LEFT JOIN (VALUES ('de', 'German'), ('en', 'English'), ('es', 'Spanish'), ('fr', NULL)) AS t(lang, name) USING (lang) GROUP BY 1""")
def records_scan(spark: SparkSession, d: str) -> DataFrame:
    """Records in memory, registered as a view that SQL joins with a table's sums by language: no text is shuffled."""
    load_records(spark, "language_names", [{"lang": k, "name": v} for k, v in LANGUAGES.items()], "lang string, name string")
    table(spark, d, "documents").createOrReplaceTempView("named_documents")
    sums = "SELECT lang, COUNT(*) AS n, SUM(LENGTH(text)) AS chars FROM named_documents GROUP BY lang"
    return spark.sql(f"SELECT name AS language, SUM(n) AS n, SUM(chars) AS chars FROM ({sums}) LEFT JOIN language_names USING (lang) GROUP BY name")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = (SELECT MIN(o_orderkey) FROM orders)")
def job_get(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return jobs.get(orders, o_orderkey=orders.agg(F.min("o_orderkey")).first()[0])


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1920 ELSE 100 + p_size END AS width, CASE WHEN p_partkey % 3 = 0 THEN 1080 ELSE p_size * 300 END AS height FROM part")
def png_sizes(spark: SparkSession, d: str) -> DataFrame:
    word = lambda c: F.lpad(F.hex(c), 8, "0")
    head = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), word(100 + F.col("p_size")), word(F.col("p_size") * 300)))
    size = png_size(F.when(F.col("p_partkey") % 3 == 0, F.lit("no picture").cast("binary")).otherwise(head))
    return table(spark, d, "part").select("p_partkey", size.alias("s")).select("p_partkey", F.col("s.width").alias("width"), F.col("s.height").alias("height"))


@query("SELECT l_orderkey, STRING_AGG(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_shipdate, l_linenumber, l_returnflag) AS attempts FROM lineitem GROUP BY 1")
def attempts_in_order(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.ordered_attempts(table(spark, d, "lineitem"), "l_orderkey", ["l_shipdate", "l_linenumber"], ["l_returnflag"])
    return rows.select("l_orderkey", F.array_join(F.transform("attempts", lambda a: F.concat(a["l_linenumber"].cast("string"), F.lit(":"), a["l_returnflag"])), ",").alias("attempts"))


@query("SELECT event_type, CAST(FLOOR((r - 1) / 100) AS INT) AS batch, COUNT(*) AS n, MIN(event_id) AS least FROM (SELECT event_type, event_id, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) GROUP BY 1, 2")
def export_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = telemetry.batches(table(spark, d, "events").select("event_type", "ts", "event_id"), ["event_type"], ["ts", "event_id"])
    least = F.array_min(F.transform("rows", lambda r: F.get_json_object(r, "$.event_id").cast("long")))
    return rows.select("event_type", "batch", "n", least.alias("least"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN REGEXP_EXTRACT(url, '^https?://([^/]+)', 1) WHEN 1 THEN 'me@h:21' ELSE '' END AS netloc FROM pages")
def netlocs(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, "ftp://me@h:21?x=/").otherwise("mailto:a@b")
    return table(spark, d, "pages").select("page_id", netloc(url).alias("netloc"))
