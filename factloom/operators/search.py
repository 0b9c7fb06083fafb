"""Search over several indexes at once, and the hybrid ranking.

The indexes and their patterns are :mod:`factloom.operators.fulltext`; a query reads the folders of its own tokens, and of
their files the row groups that hold them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.operators import fulltext
from factloom.operators.fulltext import BadPattern, Index


def bm25(index: Index, query: list[str]) -> DataFrame:
    """``(key, rank)`` of what holds all query tokens; the lower the rank, the better. No token, no row."""
    terms = [fulltext.Phrase(((w, False),)) for w in sorted(set(query))]
    return fulltext.matched(index, reduce(fulltext.Both, terms) if terms else fulltext.Phrase(()))


def scored(ranked: DataFrame) -> DataFrame:
    """``score``: at least 0.01, smaller for better ranks, as the ranking after it expects."""
    return ranked.withColumn("score", F.greatest(F.lit(0.01), 1 / (1 + F.abs("rank"))))


def _leg(index: Index, query: str, strict: bool) -> DataFrame:
    try:
        return fulltext.matched(index, query)
    except BadPattern:  # any text is a query: what is no pattern is a bag of words, or nothing
        return bm25(index, [] if strict else fulltext.tokens_of(query))


def search(indexes: dict[str, Index], query: str, limit: int = 10, strict: bool = False) -> DataFrame:
    """``(kind, key, rank, score)``: the best of all legs together that match ``query``. Ranks count to nine places; ties go to kind and key.

    A query that is no pattern asks for all its words; with ``strict`` it finds nothing.
    """
    parts = [scored(_leg(index, query, strict)).select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), F.round("rank", 9).alias("rank"), "score") for kind, index in indexes.items()]
    return reduce(DataFrame.unionByName, parts).orderBy("rank", "kind", "key").limit(limit)


def matching(rows: DataFrame, key: str, index: Index, pattern: str) -> DataFrame:
    """The ``rows`` whose ``key`` matches an explicit ``pattern``; an error if it is none."""
    found = fulltext.matched(index, pattern).select(F.col("key").alias(key))
    return rows.join(found, key, "left_semi")


def hybrid_hits(indexes: dict[str, Index], symbols: DataFrame, modules: DataFrame, query: str, limit: int = 10, names: Index | None = None) -> DataFrame:
    """Hits ``(id, seq, score, bonus, token, n)``: n equal hits of an entity in step ``seq`` of the search.

    Steps: the whole query in full text; then for each word its full-text leg and the symbols whose name is the word or whose
    label holds it, each with its module. ``symbols(id, label, name, module_id)``, ``modules(id, label)``. ``names``: an index
    of trigrams of the symbols' labels and names by id, so that not every symbol is looked at for each word.
    """
    words = t.words(query)
    parts = []

    def leg(text: str, most: int, seq: int, bonus: float, token: str | None) -> DataFrame:
        found = search(indexes, text, most)
        parts.append(found.select(F.col("key").alias("id"), F.lit(seq).alias("seq"), "score", F.lit(bonus).alias("bonus"), F.lit(token).cast("string").alias("token"), F.lit(1).cast("bigint").alias("n")))
        return found

    first = leg(query, limit, 0, 0.5, None)
    for i, w in enumerate(words if len(words) > 1 or first.isEmpty() else []):
        leg(w, max(limit, 10), 2 * i + 1, 0.0, w)
        exact = F.col("name") == w
        known = symbols if names is None else symbols.join(fulltext.containing(names, w).withColumnRenamed("key", "id"), "id", "left_semi")
        named = known.where(exact | F.contains(F.lower("label"), F.lit(w.lower())))
        parts.append(named.select("id", F.lit(2 * i + 2).alias("seq"), F.when(exact, 0.99).otherwise(0.82).alias("score"), F.when(exact, 0.45).otherwise(0.2).alias("bonus"), F.lit(w).alias("token"), F.lit(1).cast("bigint").alias("n")))
        owners = named.join(modules.select(F.col("id").alias("module_id")), "module_id").groupBy(F.col("module_id").alias("id")).agg(F.count("*").alias("n"))
        parts.append(owners.select("id", F.lit(2 * i + 2).alias("seq"), F.lit(0.65).alias("score"), F.lit(0.18).alias("bonus"), F.lit(w).alias("token"), "n"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def hybrid(hits: DataFrame, labels: DataFrame, limit: int = 10) -> DataFrame:
    """``(id, label, tokens, score)``: hits folded to one score for each entity of ``labels(id, label)``.

    The first hit gives score and bonus; a later one the larger of what there is and its own sum, and the bonus again; of n
    equal hits each adds the bonus. Each distinct token adds a quarter. Order: more tokens, higher score, label. An entity
    has at most two groups of hits for each word of the query.
    """
    start = F.struct(F.lit(None).cast("double").alias("s"))

    def step(acc, x):
        own = x["score"] + x["bonus"]
        return F.struct(F.when(acc["s"].isNull(), own + (x["n"] - 1) * x["bonus"]).otherwise(F.greatest(acc["s"], own) + x["n"] * x["bonus"]).alias("s"))

    per = hits.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "score", "bonus", "n"))).alias("h"), F.count_distinct("token").alias("tokens"))
    total = F.aggregate("h", start, step, lambda acc: acc["s"]) + 0.25 * F.col("tokens")
    return per.join(labels, "id").select("id", "label", "tokens", F.round(total, 9).alias("score")).orderBy(F.desc("tokens"), F.desc("score"), "label", "id").limit(limit)
