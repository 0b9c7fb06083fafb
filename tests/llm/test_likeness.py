"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from factloom.llm import likeness
from tests.llm.conftest import prose
from tests.llm.test_operators import words


def shingle_set(text):
    w = [x.lower() for x in words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_groups(sets):
    up = {s: s for s in sets}

    def root(s):
        while up[s] != s:
            s = up[s]
        return s

    listed = list(up)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if 5 * len(a & b) >= 4 * len(a | b) and a and b:
                up[root(a)] = root(b)
    return {s: root(s) for s in listed}


def edited(rnd, text, places):
    w = text.split()
    for i in rnd.sample(range(len(w)), places):
        w[i] = f"edit{rnd.randrange(10**9)}"
    return " ".join(w)


def stage(spark, made, none):
    return corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "", "", 0, "", "") for i, t in made], none.schema), "")


def test_near_dedup_against_brute_force(spark, none):
    """Copies with 1 to 8 edited words in 200, so similarities on both sides of 0.8, short ones and ones without words too."""
    rnd = random.Random(11)
    texts = []
    for _ in range(60):
        base = prose(rnd, 200)
        texts += [base, base.upper(), *(edited(rnd, base, rnd.randrange(1, 9)) for _ in range(3))]
    texts += [*texts[:2], "", None, " \n", "one two", "One  two", "one two three"]
    made = list(enumerate(texts)) + [(None, texts[0]), (None, "only here " + texts[1][:50])]
    group = jaccard_groups([shingle_set(t) for _, t in made])
    least = {}
    for i, t in made:
        root = group[shingle_set(t)]
        least[root] = min(least.get(root, (True, 0)), (i is None, i or 0))
    got = stage(spark, made, none).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(least.values())
    assert 60 < len(least) < len(group)
    assert stage(spark, [], none).count() == 0


def test_pairs_at_the_threshold_meet():
    """Of pairs just above 0.8 nearly none is missed by all bands."""
    rnd = random.Random(12)
    pairs = []
    while len(pairs) < 400:
        base = prose(rnd, 150)
        a, b = likeness.shingles(base), likeness.shingles(edited(rnd, base, 4 if len(pairs) % 2 else 3))
        both = len(set(a.tolist()) & set(b.tolist()))
        if likeness.alike(a, b) and both < 0.9 * (len(a) + len(b) - both):
            pairs.append((a, b))
    missed = sum(not (likeness.buckets(a) == likeness.buckets(b)).any() for a, b in pairs)
    assert missed == 0


def test_bridge_in_one_bucket():
    """Two that are alike only by way of a third are one group."""
    rng = likeness.np.random.default_rng(4)
    every = likeness.np.sort(rng.integers(0, 1 << 63, 115, dtype=likeness.np.uint64))
    sets = [every[i : i + 95] for i in (0, 20, 10)]
    assert not likeness.alike(sets[0], sets[1])
    moved, to = likeness.bucket_links(likeness.np.array([likeness.print_of(x) for x in sets], dtype=likeness.np.uint64), sets)
    assert moved.tolist() == [1, 2] and to.tolist() == [0, 0]


def test_fingerprints_of_alike_sets_are_near():
    """None of many sets just above the threshold is abandoned, short ones included."""
    rng = likeness.np.random.default_rng(5)
    for n in [5, 6, 9, 10, 20, 50, 200, 1000] * 40:
        every = rng.integers(0, 1 << 63, n, dtype=likeness.np.uint64)
        cut = n // 10
        a, b = (likeness.np.sort(x) for x in ((every[cut:], every[: n - cut]) if n >= 10 else (every, every[: n - 1])))
        assert likeness.alike(a, b)
        assert (likeness.print_of(a) ^ likeness.print_of(b)).bit_count() <= likeness.RADIUS


def test_buckets_in_blocks(spark, none, monkeypatch):
    """Blocks of a bucket change nothing."""
    rnd = random.Random(13)
    base = prose(rnd, 150)
    made = [(i, edited(rnd, base, rnd.randrange(1, 7))) for i in range(60)]
    whole = sorted(r.doc_id for r in stage(spark, made, none).collect())
    monkeypatch.setattr(likeness, "BLOCK", 8 * 146 * 7)
    assert sorted(r.doc_id for r in stage(spark, made, none).collect()) == whole and 1 <= len(whole) < 60
