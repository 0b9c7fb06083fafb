"""Patterns over a positional index against a plain search of each row, and segments against a rebuilt index."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import fulltext, search

COLUMNS = ("title", "body")
WORDS = ["ab", "abc", "b", "ba", "c", "cab"]


def made(rnd, n):
    text = lambda most: " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(most)))
    return [(i, text(4), None if rnd.random() < 0.05 else text(14)) for i in range(n)]


def build(spark, rows, path):
    return fulltext.write_index(spark.createDataFrame(rows, "id bigint, title string, body string"), "id", COLUMNS, str(path))


def places(tokens, phrase):
    """``(column, start)`` of a phrase in ``tokens``, a list for each column."""
    fits = lambda have, want: have.startswith(want[0]) if want[1] else have == want[0]
    out = []
    for c, own in enumerate(tokens):
        if phrase.columns is not None and c not in phrase.columns:
            continue
        for i in range(len(own) - len(phrase.tokens) + 1):
            if phrase.tokens and all(fits(own[i + j], x) for j, x in enumerate(phrase.tokens)) and not (phrase.first and i):
                out.append((c, i))
    return out


def counts(tokens, leaf):
    if isinstance(leaf, fulltext.Phrase):
        return [len(places(tokens, leaf))]
    all_ = [places(tokens, p) for p in leaf.phrases]
    sizes = [len(p.tokens) for p in leaf.phrases]
    in_clump = [set() for _ in all_]
    for c, end in {x for own in all_ for x in own}:
        near = [[x for x in own if x[0] == c and end - size - leaf.most <= x[1] <= end] for own, size in zip(all_, sizes)]
        if all(near):
            for mine, own in zip(in_clump, near):
                mine.update(own)
    return [len(x) for x in in_clump]


def brute(rows, tree):
    docs = {i: [fulltext.tokens_of(t or ""), fulltext.tokens_of(b or "")] for i, t, b in rows}
    leaves = list(dict.fromkeys(fulltext._leaves(tree)))
    found = {i: {leaf: counts(tokens, leaf) for leaf, _ in leaves} for i, tokens in docs.items()}

    def holds(node, have):
        if isinstance(node, fulltext.Phrase | fulltext.Near):
            return all(have[node])
        left, right = holds(node.left, have), holds(node.right, have)
        return left and right if isinstance(node, fulltext.Both) else left or right if isinstance(node, fulltext.Either) else left and not right

    mean = sum(len(t) + len(b) for t, b in docs.values()) / len(docs)
    out = {}
    for i, (t, b) in docs.items():
        if holds(tree, found[i]):
            rank = 0.0
            for leaf, on in leaves:
                for k, tf in enumerate(found[i][leaf]) if on else ():
                    df = sum(x[leaf][k] > 0 for x in found.values())
                    rank -= max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(t) + len(b)) / mean))
            out[i] = round(rank, 9)
    return out


PATTERNS = [
    "ab", "AB abc", '"ab b"', "ab + b", "a*", "ab + b*", "^ab", "body : ^ab", "title : b", "{title body} : b", "- title : b", "ab OR c", "ab AND c", "ab NOT c", "ab b NOT c OR cab", "(ab OR b) AND NOT_ OR c",
    "NEAR(ab c)", "NEAR(ab c, 1)", "NEAR(ab c, 0)", 'NEAR("ab b" c cab, 3)', "body : NEAR(a* c, 2)", "title : (ab OR b) AND body : c", "- body : (title : ab OR b)", '"..." ab', '"..."', "ab AND \"...\"", "ba* NOT (b OR c*)", "NEAR(ab ab, 2)", "Ab + Abc*",
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = made(random.Random(5), 300)
    return rows, build(spark, rows, tmp_path_factory.mktemp("index"))


def answers(index, pattern):
    return {r.key: round(r["rank"], 9) for r in fulltext.matched(index, pattern).collect()}


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_against_brute_force(stored, pattern):
    rows, index = stored
    want = brute(rows, fulltext.parsed(pattern, COLUMNS))
    got = answers(index, pattern)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-7) for k in got)


@pytest.mark.parametrize("pattern", ["foo(", "a/b.ts", "x-y", "", "  ", "a OR", "OR a", "NEAR(a", "NEAR()", '"open', "nowhere : a", "a AND (b", "(a) b", "a (b)", "^", "a + ", "*", "NEAR(a b, c)", "{title : a", "a ; b"])
def test_bad_patterns(stored, pattern):
    _, index = stored
    with pytest.raises(fulltext.BadPattern):
        fulltext.matched(index, pattern)
    with pytest.raises(fulltext.BadPattern):
        search.matching(index.spark.range(1), "id", index, pattern)
    assert search.search({"x": index}, pattern, strict=True).count() == 0


def test_any_text_is_a_query(stored):
    rows, index = stored
    assert {int(r.key) for r in search.search({"x": index}, "ab/b.c", 1000).collect()} == set(brute(rows, fulltext.parsed("ab b c")))


def test_folds_and_nulls(spark, tmp_path):
    index = build(spark, [(1, "École of the cat", None), (2, None, None), (3, "the cat", "x" * 50_000 + " é"), (4, "the", "")], tmp_path)
    assert index.n == 4 and answers(index, "ecole CAT").keys() == {1} and answers(index, "body : e").keys() == {3}
    assert search.bm25(index, ["none"]).count() == 0 and search.bm25(index, []).count() == 0
    found = search.search({"x": index}, "the", 2).collect()
    assert len(found) == 2 and found[0]["rank"] <= found[1]["rank"]


def test_slices_change_nothing(spark, monkeypatch):
    rows = spark.createDataFrame(made(random.Random(1), 50), "id bigint, title string, body string").coalesce(1)
    read = lambda: sorted(map(repr, fulltext.postings(rows, "id", *COLUMNS).collect()))
    whole = read()
    monkeypatch.setattr(fulltext, "TOGETHER", 5)
    assert read() == whole and len(whole) > 50


def test_segments_equal_a_rebuilt_index(spark, tmp_path):
    rnd = random.Random(9)
    rows = {r[0]: r for r in made(rnd, 60)}
    index = build(spark, list(rows.values()), tmp_path / "a")
    seen = set()
    for step in range(7):
        changed = [(i, *made(rnd, 1)[0][1:]) for i in rnd.sample(range(80), rnd.choice([1, 2, 9]))]
        gone = [i for i in rnd.sample(sorted(rows), 2) if i not in {r[0] for r in changed}]
        index = fulltext.refreshed(index, spark.createDataFrame(changed, "id bigint, title string, body string"), "id", spark.createDataFrame([(i,) for i in gone], "key bigint"))
        rows = {i: r for i, r in rows.items() if i not in gone} | {r[0]: r for r in changed}
        seen.add(len(index.segments))
        again = fulltext.read_index(spark, str(tmp_path / "a"))
        assert again == index and index.n == len(rows)
    fresh = build(spark, list(rows.values()), tmp_path / "b")
    assert math.isclose(index.mean_len, fresh.mean_len) and 3 in seen and max(seen) <= fulltext.FANOUT
    part = lambda x: sorted(map(repr, x.postings(F.lit(True)).select("key", "token", "tf", "doc_len", "positions").collect()))
    assert part(index) == part(fresh)
    for pattern in ("ab", '"ab b" OR c*', "NEAR(ab c, 2) NOT cab"):
        assert answers(index, pattern) == answers(fresh, pattern)
    fulltext.vacuum(index)
    assert answers(index, "ab") == answers(fresh, "ab") and len(os.listdir(tmp_path / "a" / "manifests")) <= 5


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_change_writes_little(spark, tmp_path):
    rows = [(i, f"title {i}", " ".join(f"w{(i * j) % 5000}" for j in range(60))) for i in range(3000)]
    index = build(spark, rows, tmp_path / "a")
    before = size(tmp_path / "a" / "segments")
    index = fulltext.refreshed(index, spark.createDataFrame([(7, "new", "words")], "id bigint, title string, body string"), "id")
    assert size(tmp_path / "a" / "segments") - before < before / 20 and answers(index, "new words").keys() == {7}


def test_an_index_is_of_its_rows(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, "id bigint, lang string, text string").write.mode("overwrite").parquet(str(tmp_path / "t"))
        return spark.read.parquet(str(tmp_path / "t"))

    of = lambda df: fulltext.index_of(str(tmp_path / "t"), df, "id", ("text",), str(tmp_path / "i"))
    rows = put([(1, "fr", "le chat"), (2, "en", "the cat"), (3, "en", "chat")])
    english, french = of(rows.where("lang = 'en'")), of(rows.where("lang = 'fr'"))
    assert english.n == 2 and french.n == 1 and answers(french, "chat").keys() == {1} and answers(english, "chat").keys() == {3}
    again = of(spark.read.parquet(str(tmp_path / "t")).where("lang = 'en'"))
    assert again == english and len(os.listdir(tmp_path / "i")) == 2
    other = of(put([(5, "en", "chat")]).where("lang = 'en'"))
    assert other.path == english.path and other.n == 1 and answers(other, "chat").keys() == {5} and len(os.listdir(tmp_path / "i")) == 2
    one, two = (spark.createDataFrame([(1, x)], "id bigint, text string") for x in ("a", "b"))
    assert answers(of(one), "a").keys() == {1} and answers(of(two), "a").keys() == set()


def test_trigrams_find_every_part(spark, tmp_path):
    from factloom.functions import text as t
    from factloom.operators import relational

    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("abAB/._'é") for _ in range(rnd.randrange(9))), i % 2 == 0) for i in range(400)] + [(900, None, True)]
    df = spark.createDataFrame(rows, "id bigint, name string, exported boolean")
    index = fulltext.write_index(df, "id", ("name",), str(tmp_path / "x"), cut=t.trigrams)
    for part in ["a", "AB", "'", "é", "ab", "aba", "a/b", "_.", "abab", "nowhere", ""]:
        want = {i for i, n, _ in rows if n is not None and part.lower() in n.lower()}
        found = {r.key for r in fulltext.containing(index, part).collect()}
        assert want <= found and (len(part) > 3 or not part or found == want)
        got = relational.symbols_named(df, part, index).collect()
        assert {r.id for r in got} == {r.id for r in relational.symbols_named(df, part).collect()} == want
