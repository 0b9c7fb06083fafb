"""Packing of groups that lie in many partitions, against a plain fold."""

import random

import numpy as np
import pytest

from factloom.operators import review


def fold(rows, budget):
    want, used = {}, {}
    for g, p, i, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        fits = n is not None and used.get(g, 0) + n <= budget
        used[g] = used.get(g, 0) + (n if fits else 0)
        want[i] = fits
    return want


@pytest.mark.parametrize(("seed", "budget"), [(1, 10), (2, 60), (3, 500), (4, 0), (5, 3000)])
def test_hot_groups_against_a_fold(spark, seed, budget):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.choice([None, *range(300)]), i, rnd.choice([0, 1, 3, rnd.randrange(40), None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "grp string, priority int, id bigint, tokens bigint")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {r.id: r.included for r in review.packed(df, "grp", budget).collect()}
        assert review.packed(df.limit(0), "grp", budget).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == fold(rows, budget)


def test_sums_advance_together():
    rnd = random.Random(7)
    for _ in range(50):
        budget = rnd.randrange(1, 60)
        tokens = np.array([rnd.randrange(0, budget + 1) for _ in range(rnd.randrange(1, 40))])
        got = review._advanced(np.arange(budget + 1), tokens, budget)
        for start in range(budget + 1):
            used = start
            for n in tokens.tolist():
                used += n if used + n <= budget else 0
            assert got[start] == used
