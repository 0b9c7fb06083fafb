"""The driver's tables in the shapes of the operators: logs, modules, edges, tests, commits and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _level(c: str):
    kinds = {"error": "error", "purchase": "warn", "signup": "info", "view": "debug"}
    e = F.lit("trace")
    for k, v in kinds.items():
        e = F.when(F.col(c) == k, v).otherwise(e)
    return e


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, seq, service, level, message, timestamp`` from events."""
    return log_events_of(table(spark, sf_dir, "events"))


def log_events_of(e: DataFrame) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return e.select(F.col("event_id").alias("id"), F.col("event_id").alias("seq"), F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("service"), _level("event_type").alias("level"), F.col("props").alias("message"), stamp.alias("timestamp"))


LOGS = """logs AS (SELECT event_id AS id, event_id AS seq, 'svc' || (user_id % 5) AS service,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'info' WHEN 'view' THEN 'debug' ELSE 'trace' END AS level,
  props AS message, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp FROM events)"""


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as raw log lines, a file for each service, hour by hour."""
    e = log_events(spark, sf_dir)
    line = F.concat_ws(" ", "timestamp", F.upper("level"), "service", "message")
    rows = e.select("service", F.substring("timestamp", 1, 13).alias("hour"), "seq", line.alias("line"))
    files = rows.groupBy("service", "hour").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("content"))
    path = F.concat_ws("/", F.lit("services"), "service", F.lit("logs"), F.concat("hour", F.lit(".log")))
    return files.select(F.col("service").alias("source_name"), F.lit(None).cast("string").alias("service"), path.alias("path"), F.lit("2024-01-01").alias("mtime"), "content")


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic two-sided graph of parts and suppliers, from every order line: ``source_id, target_id, type``."""
    part, supplier = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    out = F.col("l_linenumber") % 2 == 1
    return table(spark, sf_dir, "lineitem").select(F.when(out, part).otherwise(supplier).alias("source_id"), F.when(out, supplier).otherwise(part).alias("target_id"), F.lit("imports").alias("type")).distinct()


EDGES = """edges AS (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 1 THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS source_id,
  CASE WHEN l_linenumber % 2 = 1 THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS target_id, 'imports' AS type FROM lineitem)"""


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, canonical_path, package_id, language, changed`` from parts; changed are those of size 3 or less."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_type", F.concat("p_name", F.lit("-"), "p_partkey")).alias("canonical_path"), F.col("p_brand").alias("package_id"), F.col("p_type").alias("language"), (F.col("p_size") <= 3).alias("changed"))


MODULES = """modules AS (SELECT 'p' || p_partkey AS id, p_brand || '/' || p_type || '/' || p_name || '-' || p_partkey AS canonical_path,
  p_brand AS package_id, p_type AS language, p_size <= 3 AS changed FROM part)"""


def test_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_id`` (test case) tests ``target_id`` (module): a row for each order line."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("o"), "l_orderkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"), F.lit("tests").alias("type"))


def test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, suite_id, title`` from orders, and ``suite_path`` from their customers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    suites = c.select(F.col("c_custkey").alias("suite_id"), F.concat_ws("/", "c_mktsegment", "c_name").alias("suite_path"))
    cases = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_custkey").alias("suite_id"), F.col("o_orderpriority").alias("title"))
    return cases.join(suites, "suite_id")


TESTS = """tests AS (SELECT 'o' || l_orderkey AS source_id, 'p' || l_partkey AS target_id FROM lineitem),
cases AS (SELECT 'o' || o_orderkey AS id, o_custkey AS suite_id, o_orderpriority AS title, c_mktsegment || '/' || c_name AS suite_path FROM orders JOIN customer ON o_custkey = c_custkey)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sha, author, authored_at, branch`` from orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("authored_at"), F.col("o_orderstatus").alias("branch"))


COMMITS = "commits AS (SELECT o_orderkey AS sha, o_custkey AS author, strftime(o_orderdate, '%Y-%m-%d') AS authored_at, o_orderstatus AS branch FROM orders)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls ``session, seq, tool, success, duration_ms, output`` from conversations."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("role").alias("tool"), (F.length("text") % 7 != 0).alias("success"), (F.length("text") * 3).cast("bigint").alias("duration_ms"), F.col("text").alias("output"))


CALLS = "calls AS (SELECT conv_id AS session, turn AS seq, role AS tool, length(text) % 7 <> 0 AS success, length(text) * 3 AS duration_ms, text AS output FROM conversations)"
