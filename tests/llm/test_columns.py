"""Whatever an input's other columns are called, they come back untouched."""

import re

import pytest
from pyspark.sql import functions as F

from factloom.llm import likeness, mixing, quality, substrings

NAMED = sorted({w for m in (likeness, mixing, quality, substrings) for w in re.findall(r"""["']([a-z_][a-z_0-9]*)["']""", open(m.__file__).read())} - {"doc_id", "text", "lang", "source", "n_chars", *quality.MADE})


@pytest.fixture(scope="module")
def wide(docs):
    """``docs`` with a column for every name that the operators use inside, and some that need quotes."""
    base = docs.drop("key", "starts")
    return base.select("*", *(F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in [*NAMED, "a.b", "c d", "`e`"])).cache()


@pytest.mark.parametrize("stage", [quality.passing, likeness.one_of_each, substrings.without_repeats, lambda d: mixing.in_mixed_order(d, {"hot": 2.0})], ids=["quality", "near_dedup", "substrings", "mixing"])
def test_clashing_columns(wide, stage):
    got = stage(wide)
    assert got.columns == wide.columns
    rows = got.collect()
    assert len(rows) > 20
    for r in rows:
        assert [r[n] for n in NAMED] == [f"{n}-{'none' if r.doc_id is None else r.doc_id}" for n in NAMED] and r["a.b"].startswith("a.b-") and r["`e`"].startswith("`e`-")


def test_judged_columns(wide):
    got = quality.judged(wide)
    assert got.columns == [*wide.columns, *quality.MADE] and got.count() == wide.count()
    assert quality.judged(wide, ["doc_id"]).columns == ["doc_id", *quality.MADE]
