"""Paths longer than any fixed limit."""

import random

from pyspark.sql import functions as F

from factloom.operators import graph
from factloom.plans.lineage import dealt


def test_weighted_paths_have_no_limit(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", "contains") for i in range(22)] + [("n00", "n03", "imports")], "source_id string, target_id string, type string")
    costs = {r.id: r.cost for r in graph.weighted_paths(edges, "n00").collect()}
    assert costs == {"n00": 0, "n01": 3, "n02": 6, **{f"n{i:02}": 1 + 3 * (i - 3) for i in range(3, 23)}}
    assert costs["n22"] == 58 and max(r.cost for r in graph.weighted_paths(edges.where("type = 'contains'"), "n00").collect()) == 66


def test_shortest_path_of_more_than_sixty_steps(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", "imports") for i in range(62)], "source_id string, target_id string, type string")
    assert [r.id for r in graph.shortest_path(edges, "n00", "n62").orderBy("pos").collect()] == [f"n{i:02}" for i in range(63)]


def test_steps_do_not_move_the_edges(spark):
    """No exchange stands above the edges in the plan of a step."""
    rows = spark.range(500).select(F.concat(F.lit("n"), F.col("id") % 40).alias("from"), F.concat(F.lit("n"), F.col("id") % 41).alias("to"))
    steps = dealt(rows, "from")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = graph._after(spark.createDataFrame([("n1",)], "id string"), steps)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    below = plan[plan.index("Join") :].splitlines()
    moved = [line for line in below if "Exchange" in line]
    assert len(moved) == 1 and "id#" in moved[0] and any("ExistingRDD" in line and "from#" in line for line in below)


def test_walks_and_paths_against_brute_force(spark):
    rnd = random.Random(3)
    pairs = sorted({(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(70)})
    edges = spark.createDataFrame([(a, b, "imports") for a, b in pairs] + [pairs[0] + ("imports",)] + [("n1", "n2", "tests")], "source_id string, target_id string, type string")
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    paths, level = {"n0": ("n0",)}, ["n0"]
    while level:
        found = {}
        for a in level:
            for b in after.get(a, ()):
                if b not in paths:
                    found[b] = min(found.get(b, ("z",)), paths[a] + (b,))
        paths.update(found)
        level = sorted(found)
    seeds = spark.createDataFrame([("n0",)], "id string")
    assert {(r.id, r.depth) for r in graph.walk(edges, seeds, 3).collect()} == {(n, len(p) - 1) for n, p in paths.items() if len(p) <= 4}
    assert {(r.id, tuple(r.path)) for r in graph.weighted_paths(edges.where("type = 'imports'"), "n0").collect()} == set(paths.items())
    far = sorted(paths, key=lambda n: (-len(paths[n]), n))[:3]
    for target in [*far, "n0", "nowhere"]:
        got = [r.id for r in graph.shortest_path(edges, "n0", target).orderBy("pos").collect()]
        assert got == list(paths.get(target, ()))
