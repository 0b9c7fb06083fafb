"""The fixed questions of the service, composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.operators import graph, incidents, relational, review, search, telemetry
from factloom.plans.lineage import cut


def with_confidence(answer: DataFrame, some: float, none: float) -> DataFrame:
    """``answer`` with the confidence of a non-empty answer; an empty one has a single row of nulls and the other confidence.

    The answer is written out once, then looked at.
    """
    answer = cut(answer)
    if answer.isEmpty():
        return answer.sparkSession.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in answer.schema), F.lit(none).alias("confidence"))
    return answer.withColumn("confidence", F.lit(some))


def incident_timeline(logs: DataFrame, commits: DataFrame, changed: DataFrame, tests: DataFrame, limit: int = 20) -> DataFrame:
    """``(kind, key, at)``: the branch's changed modules by package and newest commits, candidate tests, incidents and events.

    ``changed(id, package_id)``, ``tests(id, score, suite_path)``; of every kind the best, all together at most ``limit``:
    branch first, then tests, incidents, events.
    """
    branch = branch_changes(changed, commits).select(F.lit(0).alias("o"), F.concat(F.lit("branch_"), "kind").alias("kind"), "key", F.col("value").alias("at"))
    best = tests.orderBy(F.desc("score"), "suite_path", "id").limit(10).select(F.lit(1).alias("o"), F.lit("test").alias("kind"), F.col("id").alias("key"), F.col("score").cast("string").alias("at"))
    found = incidents.top_incidents(incidents.incidents(logs)).select(F.lit(2).alias("o"), F.lit("incident").alias("kind"), F.col("id").alias("key"), F.col("last_seen").alias("at"))
    events = incidents.newest(logs, limit).select(F.lit(3).alias("o"), F.lit("log").alias("kind"), F.col("id").cast("string").alias("key"), F.col("timestamp").alias("at"))
    return branch.unionByName(best).unionByName(found).unionByName(events).orderBy("o", "kind", F.desc("at"), "key").limit(limit).select("kind", "key", "at")


def query_logs(logs: DataFrame, service: str | None = None, level: str | None = None, pattern: tuple[search.Index, str] | None = None, limit: int = 20) -> DataFrame:
    """Filtered events, newest first, and incidents of the service; level and pattern don't filter incidents.

    ``pattern``: an index of the events by their ids, and what they must match; an error if that is no pattern.
    """
    events = search.matching(logs, "id", *pattern) if pattern else logs
    events = incidents.newest(incidents.filtered(events, service, level), limit).select(F.lit("event").alias("kind"), F.col("id").cast("string").alias("key"))
    found = incidents.top_incidents(incidents.incidents(logs), limit, service).select(F.lit("incident").alias("kind"), F.col("id").alias("key"))
    return events.unionByName(found)


def explain_module(edges: DataFrame, modules: DataFrame, module: str) -> DataFrame:
    """A module's direct neighbours both ways, with their paths: ``(direction, id, canonical_path)``; confidence 0.83, or 0.2 for an unknown module."""
    out = edges.where(F.col("source_id") == module).select(F.lit("out").alias("direction"), F.col("target_id").alias("id"))
    both = out.unionByName(edges.where(F.col("target_id") == module).select(F.lit("in").alias("direction"), F.col("source_id").alias("id")))
    own = modules.where(F.col("id") == module).select(F.lit("self").alias("direction"), "id", "canonical_path")
    return with_confidence(own.unionByName(both.join(modules.select("id", "canonical_path"), "id").select("direction", "id", "canonical_path")), 0.83, 0.2)


def blast_radius(edges: DataFrame, modules: DataFrame, depth: int = 3) -> DataFrame:
    return with_confidence(graph.dependents(edges, modules, depth), 0.88, 0.55)


def branch_changes(changed: DataFrame, commits: DataFrame, recent: int = 5) -> DataFrame:
    """``(kind, key, value)``: the latest change group's packages with their number of modules, and the newest commits."""
    packages = changed.groupBy("package_id").agg(F.count("*").cast("string").alias("value")).select(F.lit("package").alias("kind"), F.col("package_id").alias("key"), "value")
    newest = commits.orderBy(F.desc("authored_at"), "sha").limit(recent).select(F.lit("commit").alias("kind"), F.col("sha").cast("string").alias("key"), F.col("authored_at").alias("value"))
    return packages.unionByName(newest)


def search_code(indexes: dict[str, search.Index], symbols: DataFrame, modules: DataFrame, labels: DataFrame, query: str, limit: int = 10, names: search.Index | None = None) -> DataFrame:
    """Hybrid search over the three indexes; ``labels(id, label)`` of every entity."""
    return with_confidence(search.hybrid(search.hybrid_hits(indexes, symbols, modules, query, limit, names), labels, limit), 0.86, 0.25)


def find_symbol(symbols: DataFrame, modules: DataFrame, edges: DataFrame, query: str, most: int = 10) -> DataFrame:
    """``symbols(id, name, exported, module_id)`` by name with their module's path and at most ``most`` targets of their edges, exported ones first."""
    found = relational.named(symbols, "name", query).join(modules.select(F.col("id").alias("module_id"), "canonical_path"), "module_id", "left")
    first = F.row_number().over(Window.partitionBy("source_id").orderBy("target_id"))  # a top-k per symbol
    near = edges.join(found.select(F.col("id").alias("source_id")), "source_id", "left_semi").withColumn("r", first).where(F.col("r") <= most)
    targets = near.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list("target_id")).alias("targets"))
    rows = found.join(targets, "id", "left").select("id", "name", "exported", "canonical_path", F.coalesce("targets", F.array()).alias("targets"))
    return with_confidence(rows, 0.88, 0.2).orderBy(F.desc("exported"), "name", "id")


def find_module(modules: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    """The module at ``path``, a row for each of its ``symbols(id, name, exported, module_id)``, exported ones first."""
    own = symbols.select(F.col("module_id").alias("id"), F.col("name").alias("symbol"), "exported")
    return with_confidence(relational.one_module(modules, path).join(own, "id", "left"), 0.92, 0.2).orderBy(F.desc("exported"), "symbol")


def module_dependencies(edges: DataFrame, modules: DataFrame, module: DataFrame, depth: int = 3) -> DataFrame:
    """What a module needs, within ``depth`` steps, where it is a known module."""
    return with_confidence(graph.dependencies(edges, module, depth).join(modules, "id").select("id", "canonical_path", "depth"), 0.9, 0.2)


def reverse_dependencies(edges: DataFrame, module: DataFrame, depth: int = 3) -> DataFrame:
    return with_confidence(graph.dependents(edges, module, depth), 0.84, 0.35)


def trace_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    return with_confidence(graph.shortest_path(edges, source, target), 0.87, 0.3)


def architecture_violations(found: DataFrame, severity: str | None = None, modules: DataFrame | None = None) -> DataFrame:
    """Violations by severity and path; with ``modules(id, canonical_path)`` also the ids of both sides, where they are known."""
    if severity is not None:
        found = found.where(F.col("severity") == severity)
    for side in ("source", "target") if modules is not None else ():
        known = modules.groupBy(F.col("canonical_path").alias(f"{side}_path")).agg(F.min("id").alias(f"{side}_id"))
        found = found.join(known, f"{side}_path", "left")
    return with_confidence(found, 0.9, 0.65).orderBy(F.desc("severity"), "source_path", "id")


def review_context(changed: DataFrame, edges: DataFrame, tests: DataFrame, violations: DataFrame, commits: int, depth: int = 2) -> DataFrame:
    """``(kind, id, value)``: the changed modules with their risk, what they reach in ``depth`` steps back, changed modules
    without tests, and violations ``(id, source_id, target_id)`` that touch a changed module on either side."""
    ids = changed.select("id")
    touching = violations.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").unionByName(violations.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*violations.columns)).distinct()
    fan_in = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("fan_in"))
    covered = relational.coverage(changed, tests)
    broken = touching.select("id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("m")).groupBy(F.col("m").alias("id")).agg(F.count("*").alias("violations"))
    scores = review.risk(changed, fan_in, covered, broken, commits)
    legs = [
        scores.select(F.lit("risk").alias("kind"), "id", F.col("risk").alias("value")), graph.dependents(edges, ids, depth).select(F.lit("impacted").alias("kind"), "id", F.col("depth").cast("double").alias("value")),
        covered.where("tests = 0").select(F.lit("gap").alias("kind"), "id", F.lit(0.0).alias("value")), touching.select(F.lit("violation").alias("kind"), "id", F.lit(1.0).alias("value")),
    ]
    return legs[0].unionByName(legs[1]).unionByName(legs[2]).unionByName(legs[3])


def analyze_test_failures(changed: DataFrame, edges: DataFrame, cases: DataFrame, limit: int = 10) -> DataFrame:
    best = relational.test_candidates(changed, edges, cases).orderBy(F.desc("score"), "suite_path", "id").limit(limit)
    return with_confidence(best, 0.79, 0.42)


def context_bundle(source: DataFrame, dependencies: DataFrame, dependents: DataFrame, tests: DataFrame, changes: DataFrame, budget: int = 8000) -> DataFrame:
    """Which chunks go into a module's bundle: ``(kind, id, priority, included)``.

    Each leg has ``(pos, id, text)``. Priorities: the source 1, dependencies from 10 on, dependents from 50, tests from 70, by
    position, and changes 90. By priority each chunk goes in that still fits the budget of tokens.
    """
    legs = []
    for kind, rows, base, step in (("source", source, 1, 0), ("dependency", dependencies, 10, 1), ("dependent", dependents, 50, 1), ("test", tests, 70, 1), ("change", changes, 90, 0)):
        legs.append(rows.select(F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")).alias("id"), (F.lit(base) + step * F.col("pos")).cast("bigint").alias("priority"), t.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens")))
    chunks = legs[0]
    for leg in legs[1:]:
        chunks = chunks.unionByName(leg)
    chunks = cut(chunks.withColumn("bundle", F.lit("module")))
    return review.packed(chunks.select("bundle", "priority", "id", "tokens"), "bundle", budget).join(chunks.select("id", "kind", "priority"), "id").select("kind", "id", "priority", "included")


def retrospect_log(calls: DataFrame, **filters) -> DataFrame:
    """The filtered entries, each with the statistics of all entries of its session."""
    return telemetry.filtered(calls, **filters).join(telemetry.stats(calls), "session")


def index_status(jobs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The latest job of each workspace, how many hashes ``hashes(workspace_id)`` it has, and how sure its state is."""
    sure = F.when(F.col("status") == "completed", 0.95).when(F.col("status") == "running", 0.9).otherwise(0.7)
    known = hashes.groupBy("workspace_id").agg(F.count("*").alias("hashes"))
    return relational.latest(jobs, "workspace_id", "updated_at").join(known, "workspace_id", "left").na.fill(0, ["hashes"]).withColumn("confidence", sure)
