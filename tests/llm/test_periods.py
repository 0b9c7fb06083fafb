"""Periodic runs against a search of all periods, on planted, random and odd texts."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from factloom.llm import periods
from tests.llm.test_operators import listed, words


def brute_runs(w, least=6, times=4):
    """All maximal stretches of each period, without those that a shorter period has too."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    w = words(text)
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def brute_row(doc_id, text):
    w = planted(doc_id, text)
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("times", [2, 3, 4, 7])
def test_runs_of_random_words(times):
    rnd = random.Random(times)
    for k in range(400):
        few = rnd.choice([1, 2, 3, 9])
        w = [rnd.randrange(few) for _ in range(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(3)):
            block = [rnd.randrange(few) for _ in range(rnd.randrange(1, 9))]
            w += block * rnd.randrange(1, 9) + block[: rnd.randrange(len(block))] + [rnd.randrange(few) for _ in range(rnd.randrange(5))]
        assert [tuple(r) for r in periods.runs_in(np.array(w, dtype=np.int64), 6, times).tolist()] == brute_runs(w, 6, times), w


def test_runs_are_few_and_long():
    w = np.tile(np.arange(37), 5000)
    assert periods.runs_in(w).tolist() == [[0, len(w), 37]]
    assert len(periods.runs_in(np.arange(100_000))) == 0


def test_digests_against_brute_force(docs, rows, none):
    short = docs.where("text IS NULL OR length(text) < 5000")
    want = [brute_row(r[0], r[1]) for r in rows if r[1] is None or len(r[1]) < 5000]
    assert listed(periods.digests(short)) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 5
    assert periods.digests(none).count() == 0


def test_outputs_and_other_columns(spark):
    rows = [(1, "a b a b a b a b end", "x", "y"), (None, None, None, None), (1, "a b a b a b a b end", "x", "y"), (2, " \n ", "x", "y"), (3, "é " * 30, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, `a.b` string")
    got = sorted(periods.periodic(docs).collect(), key=repr)
    assert {c for r in got for c in r.row.asDict()} == {"doc_id", "text", "runs", "a.b"} and len(got) == 5
    by = {r.row.doc_id: r for r in got}
    assert [tuple(x) for x in by[1].runs] == [(0, 8, 2)] and by[1].collapsed == "a b end" and by[1].n_words == 9
    assert by[3].collapsed == "é" and by[2].runs == [] and by[None].collapsed == "" and by[1].row["a.b"] == "y"


def test_slices_change_nothing(docs, monkeypatch):
    whole = listed(periods.digests(docs))
    monkeypatch.setattr(periods, "TOGETHER", 1000)
    assert listed(periods.digests(docs)) == whole
