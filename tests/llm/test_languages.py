"""Language models against plainly computed ones, and predictions on documents held out."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import languages

SF = "/root/testdata/sf0.001"
N = languages.ORDER


def plain(text):
    """Lower-cased letters with one boundary for each run of anything else, and one at the end."""
    out = []
    for c in (text or "") + "\0":
        if c.isalpha():
            low = ord(c.lower()[0])
            out.append(low if low < 65536 else languages.RARE)
        elif out and out[-1] != languages.BOUNDARY:
            out.append(languages.BOUNDARY)
    return out


def packed(gram):
    code = 0
    for s in gram:
        code = code << 16 | s
    return code


def grams_of(text):
    s = [languages.BOUNDARY] * (N - 1) + plain(text)
    return [tuple(s[i - N + 1 : i + 1]) for i in range(N - 1, len(s))]


def brute_models(texts):
    """For each language a function from a gram to the chance of its last symbol after the others."""
    tables = {lang: [None] * (N + 1) for lang in texts}
    for lang, own in texts.items():
        tables[lang][N] = Counter(g for t in own for g in grams_of(t))
        for size in range(N - 1, 0, -1):
            tables[lang][size] = Counter(g[1:] for g in tables[lang][size + 1])
    known = len({g for t in tables.values() for g in t[1]}) + 1

    def model(lang):
        discount, sums = {}, {}
        for size in range(1, N + 1):
            t = tables[lang][size]
            one, two = sum(n == 1 for n in t.values()), sum(n == 2 for n in t.values())
            discount[size] = min(0.95, max(0.1, one / (one + 2 * two) if two else 0.5))
            sums[size] = defaultdict(lambda: [0, 0])
            for g, n in t.items():
                sums[size][g[:-1]][0] += n
                sums[size][g[:-1]][1] += 1

        def chance(gram):
            size = len(gram)
            if not size:
                return 1 / known
            total, kinds = sums[size][gram[:-1]]
            if not total:
                return chance(gram[1:])
            d = discount[size]
            return max(tables[lang][size][gram] - d, 0) / total + d * kinds / total * chance(gram[1:])

        return chance

    return {lang: model(lang) for lang in texts}


TEXTS = {
    "aa": ["the cat sat on the mat", "The dog, the cat & the 3 hats!", "that hat", "", "12 34"],
    "bb": ["der hund und die katze", "Das ist der hut; und das die matte.", "ÄÖÜ über alles"],
    "cc": ["漢字 かな 漢字 かな", "𠮷𠮷 漢"],
}


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(lang, t) for lang, own in TEXTS.items() for t in own] + [(None, "xyz"), ("aa", None)], "lang string, text string")


def test_sequences_whole_and_in_parts(monkeypatch):
    texts = ["a", "", "Ab c--d!", "  x", "x  ", "é" * 10 + " " * 7 + "𠮷b", "1 2", "ßẞ ǅ"]
    want = [packed(g) for t in texts for g in grams_of(t)]
    owner = [i for i, t in enumerate(texts) for _ in grams_of(t)]
    for together in (1 << 20, 12, 5, 3, 1):
        monkeypatch.setattr(languages, "TOGETHER", together)
        got = list(languages.sequences(texts))
        assert [int(c) for codes, _ in got for c in codes] == want
        assert [int(i) for _, text in got for i in text] == owner


def test_chances_against_plain_models(small):
    model, want = languages.fitted(small), brute_models(TEXTS)
    assert model.langs == sorted(TEXTS)
    seen = sorted({g for own in TEXTS.values() for t in own for g in grams_of(t)}) + [tuple(map(ord, "zzzq")), (1, 1, 1, ord("q")), tuple(map(ord, "theq")), (ord("q"), *map(ord, "the"))]
    got = model.look_up(np.array([packed(g) for g in seen], dtype=np.uint64))
    for g, row in zip(seen, got, strict=True):
        for lang, x in zip(model.langs, row, strict=True):
            assert math.isclose(x, math.log(want[lang](g)), abs_tol=1e-4), (g, lang)


def test_chances_add_up_after_pruning(small, monkeypatch):
    monkeypatch.setattr(languages, "CELLS", 3 * 12)
    model = languages.fitted(small)
    assert all(len(k) <= 12 for k in model.keys)
    symbols = {s for own in TEXTS.values() for t in own for s in plain(t)}
    for before in ("the", " th", "xyz", "und"):
        start = [1 if c == " " else ord(c) for c in before]
        logs = model.look_up(np.array([packed([*start, s]) for s in sorted(symbols)], dtype=np.uint64))
        assert (np.exp(logs.astype(float)).sum(axis=0) <= 1 + 1e-5).all()


def test_what_workers_cannot_hold_is_joined(spark, small, monkeypatch):
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat und die katze", "zzzq theq qthe", "", None, "漢 theq 漢", "a" * 50, "qqqq " * 9 + "der hut"])], "doc_id bigint, text string")
    told = lambda model: {r.row.doc_id: (r.entropies, r.n_symbols) for r in languages._scored(odd, ["doc_id"], model).collect()}
    want = told(languages.fitted(small))
    for cells in (3 * 12, 3):
        monkeypatch.setattr(languages, "CELLS", cells)
        model = languages.fitted(small)
        assert all(len(k) <= cells // 3 for k in model.keys) and not all(model.whole)
        got = told(model)
        assert got.keys() == want.keys()
        for i, (entropies, n) in want.items():
            assert got[i][1] == n and (got[i][0] is None) == (entropies is None)
            assert np.allclose(got[i][0] or [], entropies or [], rtol=1e-6), (cells, i)


def test_predictions_do_not_depend_on_what_workers_hold(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    whole = {r.doc_id: r for r in languages.predicted(docs).collect()}
    monkeypatch.setattr(languages, "CELLS", 1000)
    part = {r.doc_id: r for r in languages.predicted(docs).collect()}
    assert whole.keys() == part.keys()
    assert all(part[i].lang_pred == r.lang_pred and math.isclose(part[i].score, r.score, abs_tol=1e-3) and math.isclose(part[i].cross_entropy, r.cross_entropy, rel_tol=1e-5) for i, r in whole.items())


def test_counts_cover_every_symbol(small, monkeypatch):
    whole = {(r.lang, r.gram): r.n for r in languages.counts(small.where("lang IS NOT NULL AND text IS NOT NULL")).collect()}
    want = Counter((lang, packed(g)) for lang, own in TEXTS.items() for t in own for g in grams_of(t))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert whole == {(lang, signed(g)): n for (lang, g), n in want.items()}
    monkeypatch.setattr(languages, "HELD", 4)
    again = {(r.lang, r.gram): r.n for r in languages.counts(small.where("lang IS NOT NULL AND text IS NOT NULL")).collect()}
    assert again == whole


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = languages.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    turned = docs.withColumn("lang", F.when(languages.fold(F.col("doc_id")) == 0, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert sorted(map(tuple, languages.predicted(turned).collect())) == sorted(tuple(r)[:6] for r in got)  # labels held out and sources change nothing


def test_odd_rows(spark, docs, none):
    odd = spark.createDataFrame([(1, None, "p", "q"), (2, "", "p", "q"), (3, "12 -- 7", "p", "q"), (None, "the of and to in", "p", "q"), (3, "12 -- 7", "p", "q"), (4, "und der die " * 3000, None, None)], "doc_id bigint, text string, lang_pred string, `a.b` string")
    labelled = spark.createDataFrame([(i, *x) for i in range(40) for x in (("en", "the of and to in"), ("de", "der die und das ist"))], "doc_id bigint, lang string, text string")
    model, calibration = languages.learnt(labelled)
    got = sorted(languages.identified(odd, model, calibration).collect(), key=lambda r: (r.row.doc_id or 0, r.lang_pred))
    assert [(r.row.doc_id, r.lang_pred) for r in got] == [(None, "en"), (1, "und"), (2, "und"), (3, "und"), (3, "und"), (4, "de")]
    assert all((r.score, r.cross_entropy, r.accepted) == (0.0, None, False) for r in got if r.lang_pred == "und")
    assert got[0].row["a.b"] == "q" and got[0].row["lang_pred"] == "p" and got[0].accepted
    foreign = spark.createDataFrame([(1, "xqzw vvkj qqxz jjkv wwqx")], "doc_id bigint, text string")
    assert not languages.identified(foreign, model, calibration).first().accepted
    assert languages.predicted(none).count() == 0
    assert {r.lang_pred for r in languages.identified(odd, None, None).collect()} == {"und"}
    assert languages.predicted(docs).count() == docs.count()


def test_monotone():
    got = languages._monotone([(0, 0), (5, 10), (4, 10), (9, 10), (0, 0), (10, 10)], 0.25)
    assert got == sorted(got) and len(got) == 6 and got[1] == got[2]
