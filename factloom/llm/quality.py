"""Quality rules: base counts, and divergence of a document from its language's reference histograms.

The method compares two histograms of a document with references summed over the corpus for each language: its
characters by class, and its most common function words. The measure is the Jensen-Shannon distance (base 2, square
root; 0 to 1). Short documents, and languages without a word list, are not judged by a histogram they can't fill.
Everything is DataFrame expressions. Texts are counted once; the counts are written out, summed to the references, of one
row for each language, and judged, so the verdict's conditions stand on plain columns.

Defined results: a null or empty text has no words, so it fails the base rules. A null or unlisted ``lang`` is compared
with the characters of all documents without a listed one. Other columns of the input come back as they are, whatever
their names, but for those that the result has itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import frames

WHITE = r"[ \x09-\x0D]+"
#: Character classes, in the order they are taken out of a text; what is left is the last class.
CLASSES = {"lower": "[a-z]+", "white": WHITE, "mark": r"[.,;:!?'\x22()-]+", "upper": "[A-Z]+", "letter": r"\p{L}+", "digit": "[0-9]+"}
SYMBOLS = "[#*$%&|<>]+"
#: Very common words of each language, in no other use than as bins of a histogram (fixed values).
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "des", "auf"],
    "en": ["the", "of", "and", "to", "in", "that", "is", "for", "it", "with", "as", "was"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
}
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Lengths from which a histogram is judged, and the distances from which it is rejected.
LEAST_CHARS, LEAST_TOKENS = 200, 100
MOST_CHARS_DISTANCE, MOST_WORDS_DISTANCE = 0.31, 0.26

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _lists() -> Column:
    """The word list of the row's language; empty if there is none."""
    none = F.array().cast("array<string>")
    return reduce(lambda e, kv: F.when(F.col("lang") == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(e), COMMON.items(), none)


def _counted(rows: DataFrame) -> DataFrame:
    """``rows(row, text, lang)`` with the base counts and the histograms ``classes`` and ``common``, without ``text``."""
    known = F.coalesce(F.col("lang").isin(*COMMON), F.lit(False))
    df = rows.withColumns({"lang": F.when(known, F.col("lang")).otherwise(""), "text": F.coalesce("text", F.lit(""))})
    left, sizes = "text", []
    for name, pattern in CLASSES.items():
        df = df.withColumn(name, F.regexp_replace(left, pattern, ""))
        sizes.append(F.length(left) - F.length(name))
        left = name
    df = df.withColumns({"classes": F.array(*sizes, F.length(left)), "words": F.array_remove(F.split("text", WHITE), ""), "list": _lists()})
    listed = sorted({w for words in COMMON.values() for w in words})  # of any language: one look-up in a set
    df = df.withColumn("seen", F.filter("words", lambda w: w.isin(*listed)))
    df = df.withColumn("hits", F.transform("list", lambda c: F.size("seen") - F.size(F.array_remove("seen", c))))
    df = df.withColumns({
        "common": F.concat("hits", F.array(F.size("words") - F.aggregate("hits", F.lit(0), lambda a, x: a + x))),
        "n_words": F.size("words").cast("bigint"),
        "word_chars": (F.length("text") - F.get("classes", F.lit(1))).cast("bigint"),
        "n_symbols": (F.length("digit") - F.length(F.regexp_replace("digit", SYMBOLS, ""))).cast("bigint"),
        "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]")),
    })
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"))
    return _repeats(df.select("row", *COUNTS[:-1], "lang", "classes", "common", "words")).select("row", *COUNTS, "lang", "classes", "common")


def references(counted: DataFrame) -> DataFrame:
    """``(lang, r_classes, r_common)``: counts over all documents of each listed language, and of the others together.

    At most ``len(COMMON) + 1`` rows.
    """
    bins = [(c, i) for c, n in (("classes", len(CLASSES) + 1), ("common", 13)) for i in range(n)]
    sums = counted.groupBy("lang").agg(*(F.sum(F.get(c, F.lit(i)).cast("bigint")).alias(f"{c}{i}") for c, i in bins))
    back = {c: F.filter(F.array(*(F.col(f"{c}{i}") for x, i in bins if x == c)), lambda x: x.isNotNull()) for c in ("classes", "common")}
    return sums.select("lang", back["classes"].alias("r_classes"), back["common"].alias("r_common"))


def js_distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two count arrays of one length; null if either is empty."""
    total = lambda c: F.aggregate(F.col(c), F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double")
    half = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    def term(x: Column, y: Column) -> Column:
        a, b = x / F.nullif(total(p), F.lit(0.0)), y / F.nullif(total(q), F.lit(0.0))
        return (half(a, (a + b) / 2) + half(b, (a + b) / 2)) / 2

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def _repeats(df: DataFrame) -> DataFrame:
    """``n_repeat_words``: words in windows of ``WINDOW`` words that occur twice or more in the text.

    A window's hash is put together from those of its halves, so it costs three steps a word; only texts that have a
    repeated window are sorted.
    """
    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    step = 1
    while step < WINDOW:
        n = F.greatest(F.size(f"h{step}") - step, F.lit(0))
        df = df.withColumn(f"h{2 * step}", F.zip_with(F.slice(f"h{step}", F.lit(1), n), F.slice(f"h{step}", F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    hashes = f"h{WINDOW}"
    again = F.size(F.array_distinct(hashes)) < F.size(hashes)
    df = df.withColumn("sorted", F.when(again, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get("sorted", k)["h"] == x["h"], F.lit(False))
    df = df.withColumn("twice", F.filter("sorted", lambda x, k: same(x, k - 1) | same(x, k + 1)))
    df = df.withColumn("starts", F.sort_array(F.transform("twice", lambda x: x["i"])))
    reach = F.transform("starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - s, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint"))


def _judged(docs: DataFrame, columns: list[str], text: str, lang: str) -> DataFrame:
    """``row`` (those ``columns`` of ``docs``) with the base counts, ``base_failed``, both distances and ``kept``."""
    counted = frames.cut(_counted(frames.packed(docs, columns, text=frames.quoted(text), lang=frames.quoted(lang))))
    df = counted.join(F.broadcast(references(counted)), "lang", "left")  # a row for each listed language and one more
    return df.withColumns({
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        "js_chars": F.when(F.aggregate("classes", F.lit(0), lambda a, x: a + x) >= LEAST_CHARS, js_distance("classes", "r_classes")),
        "js_words": F.when((F.col("n_words") >= LEAST_TOKENS) & (F.size("common") > 1), js_distance("common", "r_common")),
    }).withColumn("kept", ~F.col("base_failed") & (F.coalesce("js_chars", F.lit(0.0)) < MOST_CHARS_DISTANCE) & (F.coalesce("js_words", F.lit(0.0)) < MOST_WORDS_DISTANCE))


MADE = [*COUNTS, "base_failed", "js_chars", "js_words", "kept"]


def judged(docs: DataFrame, keep: list[str] | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """Columns of ``docs`` (``keep``; by default all) with the base counts, ``base_failed``, both distances and ``kept``.

    A column of these names in ``docs`` is replaced.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c not in MADE]
    return _judged(docs, columns, text, lang).select("row.*", *MADE)


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged."""
    return _judged(docs, docs.columns, "text", "lang").where("kept").select("row.*")


_LISTS = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(f"'{w}'" for w in v)}]" for k, v in COMMON.items()) + " ELSE []::VARCHAR[] END"
_LEFT = reduce(lambda e, p: f"regexp_replace({e}, '{p.replace("'", "''")}', '', 'g')", list(CLASSES.values()), "t")


def _removed(n: int) -> str:
    return reduce(lambda e, p: f"regexp_replace({e}, '{p.replace("'", "''")}', '', 'g')", list(CLASSES.values())[:n], "t")


def _js_sql(p: str, q: str) -> str:
    half = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / ((a + b) / 2)) ELSE 0 END"
    return f"(SELECT sqrt(greatest(sum(({half('a')} + {half('b')}) / 2), 0)) FROM (SELECT unnest({p}) / list_sum({p}) AS a, unnest({q}) / list_sum({q}) AS b))"


ORACLE = f"""
WITH d AS (SELECT doc_id, CASE WHEN lang IN ({', '.join(f"'{k}'" for k in COMMON)}) THEN lang ELSE '' END AS lang, coalesce(text, '') AS t FROM documents),
c AS (SELECT *, {_LISTS} AS list, list_filter(regexp_split_to_array(t, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS words,
  [{', '.join(f'length({_removed(i)}) - length({_removed(i + 1)})' for i in range(len(CLASSES)))}, length({_LEFT})] AS classes,
  length({_LEFT}) - length(regexp_replace({_LEFT}, '{SYMBOLS}', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS lines FROM d),
e AS (SELECT *, list_transform(list, lambda w: len(list_filter(words, lambda x: x = w))) AS hits FROM c),
f AS (SELECT *, list_append(hits, len(words) - coalesce(list_sum(hits), 0)) AS common FROM e),
refs AS (SELECT lang, list_transform(range(1, {len(CLASSES) + 2}), lambda i: list_sum(list_transform(list(classes), lambda x: x[i]))) AS r_classes,
  list_transform(range(1, max(len(common)) + 1), lambda i: list_sum(list_transform(list(common), lambda x: x[i]))) AS r_common FROM f GROUP BY lang),
pos AS (SELECT doc_id, unnest(range(1, len(words) - {WINDOW - 2})) AS p, words FROM c WHERE len(words) >= {WINDOW}),
win AS (SELECT doc_id, p, words[p : p + {WINDOW - 1}] AS w FROM pos),
twice AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + {WINDOW})) AS q FROM twice) GROUP BY doc_id),
g AS (SELECT f.*, coalesce(n_repeat_words, 0) AS n_repeat_words, r_classes, r_common FROM f JOIN refs USING (lang) LEFT JOIN rep USING (doc_id)),
h AS (SELECT doc_id, len(words)::BIGINT AS n_words, (length(t) - classes[2])::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  CASE WHEN list_sum(classes) >= {LEAST_CHARS} THEN {_js_sql('classes', 'r_classes')} END AS js_chars,
  CASE WHEN len(words) >= {LEAST_TOKENS} AND len(common) > 1 THEN {_js_sql('common', 'r_common')} END AS js_words FROM g),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(js_chars, 0) < {MOST_CHARS_DISTANCE} AND coalesce(js_words, 0) < {MOST_WORDS_DISTANCE} AS kept,
  round(js_chars, 6) AS js_chars, round(js_words, 6) AS js_words FROM b
"""
