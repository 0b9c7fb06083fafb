"""Call logs: newest entries, filters, statistics and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as t

KEPT = 500


def ring(calls: DataFrame, kept: int = KEPT) -> DataFrame:
    """The newest entries of each session."""
    return calls.withColumn("r", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seq")))).where(F.col("r") <= kept).drop("r")


def filtered(calls: DataFrame, tool: str | None = None, success: bool | None = None, since: int | None = None, limit: int = 50) -> DataFrame:
    """Of what fits, the last ``limit`` entries of each session, in order."""
    if tool is not None:
        calls = calls.where(F.col("tool") == tool)
    if success is not None:
        calls = calls.where(F.col("success") == success)
    if since is not None:
        calls = calls.where(F.col("seq") > since)
    return ring(calls, limit)


def stats(calls: DataFrame) -> DataFrame:
    """For each session: totals, successes, failures, mean duration in whole milliseconds, first and last entry. Filters don't count."""
    mean = F.floor(F.avg("duration_ms") + 0.5).cast("bigint")
    return calls.groupBy("session").agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), mean.alias("mean_ms"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def per_tool(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session", "tool").agg(F.count("*").alias("n"))


def exported(calls: DataFrame) -> DataFrame:
    """The kept entries of each session as one JSON array, in order; outputs are cut at 800 characters."""
    entry = F.struct("seq", "tool", "success", "duration_ms", t.truncated(F.col("output"), 800).alias("output"))
    per = ring(calls).groupBy("session").agg(F.sort_array(F.collect_list(entry)).alias("entries"))  # at most KEPT of a session
    return per.select("session", F.to_json("entries").alias("json"))


def report(calls: DataFrame) -> DataFrame:
    """A markdown line for each entry of a session, joined in order; outputs are cut at 800 characters."""
    line = F.concat_ws(" ", F.lit("-"), F.concat(F.lit("#"), "seq"), "tool", F.when(F.col("success"), "ok").otherwise("failed"), t.truncated(F.col("output"), 800))
    per = ring(calls).groupBy("session").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("lines"))
    return per.select("session", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("markdown"))
