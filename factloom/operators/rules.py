"""Architecture rules over import edges.

``rules(pos, id, kind, from_glob, to_glob, severity, allow_generated, except)``; ``except`` is an array of ``(from, to)``
globs, a missing side matching everything. Edges carry both paths: ``(edge_id, source_path, target_path)``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import conventions as c
from factloom.functions import text as t

SCHEMA = "pos int, id string, kind string, from_re string, to_re string, severity string, allow_generated boolean, excepts array<struct<f:string,t:string>>, word string"


def required_segment(glob: str) -> str:
    """The longest name that a path must have between its slashes to match ``glob``; empty if there is none."""
    names = [] if "?" in glob else [x for x in glob.split("/") if x and "*" not in x]
    return max(names, key=len, default="")


def table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules as a frame of regular expressions. YAML or JSON text is read by :func:`parse`."""
    rows = []
    for pos, r in enumerate(rules):
        excepts = [(t.glob_regex(e.get("from", "**")), t.glob_regex(e.get("to", "**"))) for e in r.get("except", [])]
        rows.append((pos, r.get("id", f"rule{pos}"), r.get("kind"), t.glob_regex(r.get("from", "**")), t.glob_regex(r.get("to", "**")), r.get("severity", "error"), bool(r.get("allowGenerated", False)), excepts, required_segment(r.get("from", "**"))))
    return spark.createDataFrame(rows, SCHEMA)


def _scalar(value: str):
    value = value.strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
        return value[1:-1]
    return {"true": True, "false": False}.get(value, value)


def parsed_entries(content: str, key: str) -> list[dict]:
    """The entries of list ``key`` from JSON, or from YAML of nested lists and scalars."""
    try:
        found = json.loads(content)
        return found.get(key, []) if isinstance(found, dict) else found
    except ValueError:
        pass
    entries: list[dict] = []
    inner: list[dict] | None = None
    base = None
    for line in content.splitlines():
        text = line.split(" #")[0].rstrip()
        if not text.strip() or text.strip().startswith("#") or text.strip() == f"{key}:":
            continue
        depth, text = len(text) - len(text.lstrip()), text.strip()
        if text.startswith("- "):
            base = depth if base is None else base
            entry: dict = {}
            if depth > base and inner is not None:
                inner.append(entry)
            else:
                entries.append(entry)
                inner = None
            text, target = text[2:], entry
        elif not entries:
            continue
        else:
            target = inner[-1] if inner and depth > (base or 0) + 4 else entries[-1]
        name, _, value = text.partition(":")
        if value.strip():
            target[name.strip()] = _scalar(value)
        else:
            inner = target.setdefault(name.strip(), [])
    return entries


def parse(content: str) -> list[dict]:
    """Rules from JSON, or from YAML, where they default to ``forbid``."""
    found = parsed_entries(content, "rules")
    yaml = not content.lstrip().startswith(("{", "["))
    return [{"kind": "forbid", **r} for r in found] if yaml else found


def load(spark: SparkSession, root: str) -> DataFrame | None:
    """The rules of the first rule file below ``root``; None if there is none."""
    from factloom.sources.files import first_config

    content = first_config(spark, root, c.RULE_FILES)
    return None if content is None else table(spark, parse(content))


def generated(column: str) -> F.Column:
    return F.col(column).rlike(t.any_glob(c.GENERATED_GLOBS))


def violations(edges: DataFrame, rules: DataFrame, workspace: str = "ws") -> DataFrame:
    """``id, rule_id, severity, edge_id, source_path, target_path``.

    A forbid rule charges every edge that both its globs match. If allow rules match an edge's source, one of them must
    match its target; else the edge is charged once, to the first of them. Exceptions and generated files are let off.

    An edge meets a rule by a name that the source must have between its slashes, and only then are expressions tried; rules
    without such a name meet all edges. Spark broadcasts the rules if they are few.
    """
    names = F.array_distinct(F.concat(F.array(F.lit("")), F.split("source_path", "/")))
    met = edges.select("edge_id", "source_path", "target_path", F.explode(names).alias("word")).join(rules, "word").drop("word")
    matched = met.where("source_path RLIKE from_re AND (kind = 'allow' OR target_path RLIKE to_re)")
    listed = F.exists("excepts", lambda e: F.regexp_like("source_path", e["f"]) & F.regexp_like("target_path", e["t"]))
    excused = listed | (F.col("allow_generated") & (generated("source_path") | generated("target_path")))
    forbidden = matched.where("kind = 'forbid'").where(~excused).select("edge_id", "source_path", "target_path", F.col("id").alias("rule_id"), "severity")
    ok = F.expr("target_path RLIKE to_re") | excused
    allowed = matched.where("kind = 'allow'").groupBy("edge_id", "source_path", "target_path").agg(F.bool_or(ok).alias("ok"), F.min(F.struct("pos", "id", "severity")).alias("r"))
    charged = allowed.where("NOT ok").select("edge_id", "source_path", "target_path", F.col("r.id").alias("rule_id"), "r.severity")
    found = forbidden.unionByName(charged)
    return found.select(t.stable_id("violation", F.lit(workspace), "rule_id", "edge_id").alias("id"), "rule_id", "severity", "edge_id", "source_path", "target_path")
