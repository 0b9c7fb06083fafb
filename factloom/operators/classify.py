"""Classifying files by votes of weighted signals.

Each detector is one conditional expression that yields a signal ``(dimension, value, confidence)`` or null. Votes are summed
by value; the highest wins, the earlier detector on ties.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import conventions as c
from factloom.functions import text as t


def detectors(path: str = "path", content: str = "content", generated_dirs: tuple[str, ...] = (), test_roots: tuple[str, ...] = (), lowered: Column | None = None) -> list[Column]:
    """Signals in the order of the detectors. Braces of a glob stand for themselves here, and test globs meet the lower-case path.

    Patterns that ignore case are tried on a text only where a word that they need is in its lower case, which is
    ``lowered`` if there is a column of it.
    """
    p, low, body = F.replace(F.col(path), F.lit("\\"), F.lit("/")), F.lower(F.replace(F.col(path), F.lit("\\"), F.lit("/"))), F.coalesce(F.col(content), F.lit(""))
    ext, name = t.extension(p), t.basename(low)
    head = lambda n: F.substring(body, 1, n)
    low_body = F.lower(body) if lowered is None else lowered
    first_lines, low_lines = F.substring_index(body, "\n", 20), F.substring_index(low_body, "\n", 20)  # no banner ends in a line end or goes over one
    under = lambda roots: low.rlike("^(" + "|".join(re.escape(r.lower()) for r in roots) + ")(/|$)") if roots else F.lit(False)

    def signal(when: Column, dimension: str, value: Column | str, sure: float) -> Column:
        return F.when(when, F.struct(F.lit(dimension).alias("dimension"), (F.lit(value) if isinstance(value, str) else value).alias("value"), F.lit(sure).alias("confidence")))

    test_path = t.meets(low, c.TEST_GLOBS) | low.rlike(c.TEST_FOLDER)
    test_mark = t.holds(low_body, *c.TEST_WORDS) | (F.contains(body, F.lit("(")) & body.rlike(c.TEST_CALL))
    log = name.rlike(c.LOG_NAME) | low.rlike("(" + "|".join(c.LOG_FOLDERS) + ")/") | name.rlike(r"\.(" + "|".join(c.LOG_EXTENSIONS) + ")$") | (t.holds(F.lower(head(512)), *t.LEVELS) & head(512).rlike(c.LEVEL_WORD))
    return [
        signal(t.meets(p, c.GENERATED_GLOBS + tuple(f"{d}/**" for d in generated_dirs)), "kind", "generated", 0.95),
        signal(t.meets(p, c.MANIFEST_GLOBS), "kind", "manifest", 0.95),
        signal(t.meets(p, c.SOURCE_GLOBS), "kind", "source", 0.45),
        signal(t.meets(p, c.EVIDENCE_GLOBS), "kind", F.when(ext.isin(*c.DOCS), "doc").otherwise("config"), 0.4),
        signal(ext.isin(*c.LANGUAGES), "language", t.language(p), 0.5),
        signal(t.holds(low_lines, *c.BANNER_WORDS) & first_lines.rlike("(?i)" + "|".join(c.BANNERS)), "kind", "generated", 0.98),
        signal(ext.isin(*c.BINARY), "kind", "binary", 1.0),
        signal(test_path, "kind", "test", 0.9),
        signal(test_path, "role", "test", 0.8),
        signal(test_mark, "kind", "test", 0.75),
        signal(under(test_roots), "kind", "test", 0.65),
        signal(log, "kind", "log", 0.8),
        signal(ext.isin(*c.DOCS), "kind", "doc", 0.7),
        signal(low.rlike(c.DOC_FOLDER), "kind", "doc", 0.75),
        signal(head(500).rlike(r"(?m)^#\s+"), "kind", "doc", 0.45),
        signal(ext.isin(*c.CONFIGS), "kind", "config", 0.65),
        signal(name.isin(*c.CONFIG_NAMES) | name.rlike(c.CONFIG_WORD), "kind", "config", 0.7),
        signal(t.holds(F.lower(head(800)), *c.CONFIG_WORDS) & head(800).rlike(c.CONFIG_MARK), "kind", "config", 0.55),
    ]


def classify(files: DataFrame, path: str = "path", content: str = "content", generated_dirs: tuple[str, ...] = (), test_roots: tuple[str, ...] = ()) -> DataFrame:
    """``files`` with ``kind, language, roles, tags, generated, confidence``. Votes are folded inside each row, without a shuffle.

    They come out of a generator of one row: a filter on them stays above it, where below it would hold the expressions
    of all of them, and of the content, once for each place where they stand.

    ``language`` is null without a vote. ``generated_dirs`` and ``test_roots``: what manifests say, see :func:`factloom.sources.files.conventions`.
    """
    lowered = files.withColumn("lowered", F.lower(F.coalesce(F.col(content), F.lit(""))))
    df = lowered.withColumn("votes", F.array(*detectors(path, content, generated_dirs, test_roots, F.col("lowered"))))  # nulls go with the dimensions: a filter here would have all signals interpreted

    def totals(dimension: str) -> Column:
        own = F.filter("votes", lambda s: s["dimension"] == dimension)
        values = F.array_distinct(F.transform(own, lambda s: s["value"]))
        return F.transform(values, lambda v, i: F.struct(F.aggregate(F.filter(own, lambda s: s["value"] == v), F.lit(0.0), lambda a, s: a + s["confidence"]).alias("score"), (-i).alias("order"), v.alias("value")))

    df = df.withColumns({"kinds": totals("kind"), "languages": totals("language"), "role_totals": totals("role"), "tag_totals": totals("tag")})
    df = df.withColumns({"k": F.array_max("kinds"), "l": F.array_max("languages")})
    sure = lambda name: F.transform(F.filter(name, lambda x: x["score"] >= 0.6), lambda x: x["value"])
    generated = F.exists("kinds", lambda x: (x["value"] == "generated") & (x["score"] >= 0.9))
    kind = F.when(generated, "generated").when(F.col("k").isNotNull(), F.col("k.value")).when(F.col("l").isNotNull(), F.when(F.array_contains(sure("role_totals"), "test"), "test").otherwise("source")).otherwise("unknown")
    confidence = F.greatest(F.coalesce("k.score", F.lit(0.0)), F.coalesce("l.score", F.lit(0.0)), F.lit(0.05))
    found = F.struct(kind.alias("kind"), F.col("l.value").alias("language"), sure("role_totals").alias("roles"), sure("tag_totals").alias("tags"), generated.alias("generated"), F.round(confidence, 2).alias("confidence"))
    return df.select(*files.columns, F.inline(F.array(found)))


def indexable(files: DataFrame) -> DataFrame:
    return files.where(F.col("kind").isin("source", "test", "config", "manifest", "doc"))


def test_extractable(files: DataFrame) -> DataFrame:
    """Test files whose cases can be read."""
    return files.where((F.col("kind") == "test") & F.col("language").isin("typescript", "javascript"))
