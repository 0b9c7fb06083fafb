"""Bounded walks and shortest paths over an edge table, one join for each step.

The edges are written once, dealt by the node they leave, and every step joins them where they lie: only what the last step
found moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.lineage import cut, dealt

#: What a step over an edge of each type costs (fixed values).
WEIGHTS = {"contains": 3, "belongs_to_package": 3, "declares": 2, "exports": 2, "imports": 1, "references": 2, "calls": 1, "changed_in": 2, "tests": 2, "failed_after_change": 3}


def turned(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"source_id": F.col("target_id"), "target_id": F.col("source_id")})


def _links(edges: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return edges.where(F.col("type").isin(*types)).select(F.col("source_id").alias("from"), F.col("target_id").alias("to")).distinct()


def _after(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """``(id)``: where one step leads from ``nodes(id)``."""
    return nodes.join(steps, nodes["id"] == steps["from"]).select(F.col("to").alias("id")).distinct()


def walk(edges: DataFrame, seeds: DataFrame, depth: int = 3, types: tuple[str, ...] = ("imports",)) -> DataFrame:
    """``(id, depth)`` of everything reachable from ``seeds(id)`` in at most ``depth`` steps, the seeds at depth 0.

    A step joins only what the last one found, and visits nothing twice; cycles and several seeds are fine.
    """
    steps = dealt(_links(edges, types), "from")
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    last = seen
    for d in range(1, depth + 1):
        last = cut(_after(last, steps).join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen


def walked_edges(edges: DataFrame, seen: DataFrame, depth: int, types: tuple[str, ...] = ("imports",)) -> DataFrame:
    """The edges that a walk followed: all that leave a node it expanded, back into visited ones too."""
    expanded = seen.where(F.col("depth") < depth).select(F.col("id").alias("source_id"))
    return edges.where(F.col("type").isin(*types)).join(expanded, "source_id", "left_semi")


def dependencies(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    return walk(edges, seeds, depth).where("depth > 0")


def dependents(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    return walk(turned(edges), seeds, depth).where("depth > 0")


def weighted_paths(edges: DataFrame, source: str, weights: dict[str, int] | None = None) -> DataFrame:
    """``(id, cost, path)``: the cheapest path from ``source`` to everything reachable; of equal costs the first path in order.

    Each round relaxes only from nodes whose path got better.
    """
    price = WEIGHTS | (weights or {})
    cost = F.create_map(*[F.lit(x) for kv in price.items() for x in kv])
    steps = edges.where(F.col("type").isin(*price)).select(F.col("source_id").alias("from"), F.col("target_id").alias("to"), F.element_at(cost, F.col("type")).alias("w")).groupBy("from", "to").agg(F.min("w").alias("w"))
    steps = dealt(steps, "from")
    spark = edges.sparkSession
    best = cut(spark.createDataFrame([(source, 0, [source])], "id string, cost bigint, path array<string>"))
    moved = best
    while not moved.isEmpty():
        offers = moved.join(steps, moved["id"] == steps["from"]).select(F.col("to").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("to")).alias("path"))
        offers = offers.groupBy("id").agg(F.min(F.struct("cost", "path")).alias("new"))
        old = best.select("id", F.struct("cost", "path").alias("old"))
        moved = cut(offers.join(old, "id", "left").where("old IS NULL OR new < old").select("id", "new.cost", "new.path"))
        best = cut(best.join(moved, "id", "left_anti").unionByName(moved))
    return best


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``(pos, id)`` along the path with the fewest imports, of several the first in order; no row if there is none.

    Two searches meet: the one with the smaller front goes on, until the fronts share a node or one is empty. Then the nodes
    of all shortest paths are traced from where they met, and the first path is taken step by step.
    """
    spark = edges.sparkSession
    links = cut(_links(edges, ("imports",)))
    ahead, back = dealt(links, "from"), dealt(links.select(F.col("to").alias("from"), F.col("from").alias("to")), "from")
    one = lambda node: cut(spark.createDataFrame([(node,)], "id string"))
    sides = [([one(source)], ahead), ([one(target)], back)]
    sizes, seen = [1, 1], [sides[0][0][0], sides[1][0][0]]
    while sides[0][0][-1].join(sides[1][0][-1], "id", "left_semi").isEmpty():
        k = 0 if sizes[0] <= sizes[1] else 1
        fronts, steps = sides[k]
        front = cut(_after(fronts[-1], steps).join(seen[k], "id", "left_anti"))
        sizes[k] = front.count()
        if not sizes[k]:
            return spark.createDataFrame([], "pos int, id string")
        fronts.append(front)
        seen[k] = seen[k].unionByName(front)
    (forth, _), (home, _) = sides
    levels = [forth[-1].join(home[-1], "id", "left_semi")]
    for near in reversed(forth[:-1]):
        levels.insert(0, cut(_after(levels[0], back).join(near, "id", "left_semi")))
    for near in reversed(home[:-1]):
        levels.append(cut(_after(levels[-1], ahead).join(near, "id", "left_semi")))
    path = [source]
    for level in levels[1:]:
        path.append(_after(one(path[-1]), ahead).join(level, "id", "left_semi").agg(F.min("id")).first()[0])
    return spark.createDataFrame(list(enumerate(path)), "pos int, id string")
