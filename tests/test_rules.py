"""Many rules meet edges by key, against every rule tried on every edge."""

import random
import re

import pytest

from factloom.functions import text as t
from factloom.operators import rules


@pytest.mark.parametrize(("glob", "want"), [("**/fr/**", "fr"), ("src/long-name/*.ts", "long-name"), ("**", ""), ("*.ts", ""), ("a?/b", ""), ("a/**/bb", "bb"), ("x**y/z", "z"), ("", "")])
def test_required_segment(glob, want):
    assert rules.required_segment(glob) == want


def test_many_rules_against_all_pairs(spark):
    rnd = random.Random(8)
    names = [f"n{i}" for i in range(60)] + ["a.ts", "b.ts"]
    path = lambda: "/".join(rnd.choice(names) for _ in range(rnd.randrange(1, 5)))
    glob = lambda: rnd.choice([f"**/{rnd.choice(names)}/**", f"{rnd.choice(names)}/*", f"**/{rnd.choice(names)}", "**.ts", f"{rnd.choice(names)}/**/a?.ts", path()])
    made = [{"id": f"r{i}", "kind": rnd.choice(["forbid", "forbid", "allow"]), "from": glob(), "to": glob()} for i in range(300)]
    edges = [(str(i), path(), path()) for i in range(200)] + [("x", None, "a"), ("y", "a", None)]
    want = set()
    for e, a, b in edges:
        if a is None:
            continue
        hit = lambda side, p: p is not None and re.search(t.glob_regex(side), p)
        want |= {(e, r["id"]) for r in made if r["kind"] == "forbid" and hit(r["from"], a) and hit(r["to"], b)}
        allow = [r for r in made if r["kind"] == "allow" and hit(r["from"], a)]
        if allow and b is not None and not any(hit(r["to"], b) for r in allow):
            want.add((e, allow[0]["id"]))
    df = spark.createDataFrame(edges, "edge_id string, source_path string, target_path string")
    got = {(r.edge_id, r.rule_id) for r in rules.violations(df.where("target_path IS NOT NULL"), rules.table(spark, made)).collect()}
    assert got == {x for x in want if x[0] != "y"} and len(got) > 50


def test_ten_thousand_rules_without_a_nested_loop(spark):
    made = [{"id": f"r{i}", "kind": "forbid", "from": f"**/m{i}/**", "to": "**"} for i in range(10_000)]
    edges = spark.range(5000).selectExpr("cast(id as string) edge_id", "concat('x/m', id * 3, '/y.ts') source_path", "'z' target_path")
    found = rules.violations(edges, rules.table(spark, made))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 3334
