"""Log filters, incident roll-up and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as t

TITLE = 120


def filtered(logs: DataFrame, service: str | None = None, level: str | None = None) -> DataFrame:
    """Events of a service and a level; what is None does not filter. For a pattern see :func:`factloom.operators.search.matching`."""
    if service is not None:
        logs = logs.where(F.col("service") == service)
    if level is not None:
        logs = logs.where(F.col("level") == level)
    return logs


def newest(logs: DataFrame, limit: int = 20) -> DataFrame:
    return logs.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def incidents(logs: DataFrame, workspace: str = "ws") -> DataFrame:
    """Errors and fatals by service and title: counts, first and last time, and the latest event (ties: the later read).

    An incident's id comes from its first event's whole message. ``logs(id, seq, service, level, message, timestamp)``.
    """
    title = F.substring("message", 1, TITLE)
    latest = F.struct("timestamp", "seq")
    found = logs.where(F.col("level").isin("error", "fatal")).groupBy("service", title.alias("title")).agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.max_by("id", latest).alias("latest_event_id"), F.max_by("level", latest).alias("severity"), F.min_by("message", "seq").alias("first_message"),
    )
    return found.select(t.stable_id("incident", F.lit(workspace), "service", "first_message").alias("id"), "service", "title", "n", "first_seen", "last_seen", "latest_event_id", "severity")


def top_incidents(found: DataFrame, limit: int = 10, service: str | None = None) -> DataFrame:
    if service is not None:
        found = found.where(F.col("service") == service)
    return found.orderBy(F.desc("last_seen"), "id").limit(limit)
