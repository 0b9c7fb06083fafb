"""Periodic runs of words, by a dictionary of basic factors.

The dictionary names every block of 1, 2, 4, ... words of a text: equal blocks have equal names, and the name of a block is
that of the pair of its halves. At each length, successive occurrences of a block within twice that length propose their
distance as a period. Proposals of one period at consecutive starts are one arithmetic progression, which stands for a
stretch with that period; stretches that share a period's words join, are extended while words a period apart are
identical, and count once. A block that occurs once in its texts can't be half of one that recurs, so in prose the longer
lengths hold hardly any block. Many texts are worked on together, kept apart by words that occur nowhere else.

A text is met whole in one task and nothing else is: no shuffle, and memory for a slice of a batch or for one text.

Defined results: words are what stands between ASCII white space; a null or empty text has no words and no runs. Repeated
rows and null ids are rows like any other. Other columns come back as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import frames

#: Bytes of text that are worked on together.
TOGETHER = 1 << 22
#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


def stretches(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, period)`` of the progressions of each block length over the names of single words."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, names, size = np.arange(len(words)), words, 1
    while len(at) > 1:
        order = np.argsort(names, kind="stable")
        names, at = names[order], at[order]
        same = names[1:] == names[:-1]
        apart = np.diff(at)
        near = same & (apart <= 2 * size)
        first, period = at[:-1][near], apart[near]
        if len(first):
            order = np.argsort(first)
            first, period = first[order], period[order]
            begins = np.flatnonzero(np.concatenate([[True], (np.diff(first) != 1) | (np.diff(period) != 0)]))
            last = np.append(begins[1:], len(first)) - 1
            found.append((first[begins], first[last] + period[begins] + size, period[begins]))
        recurs = np.zeros(len(at), dtype=bool)
        recurs[1:] = same
        recurs[:-1] |= same
        rank = np.cumsum(np.concatenate([[True], ~same]))
        known = np.zeros(len(words) + size, dtype=np.int64)  # 0: no block, or one that occurs once
        known[at[recurs]] = rank[recurs]
        at = np.flatnonzero(known[: len(words)])
        at = at[known[at + size] > 0]
        names = known[at] * (len(words) + 1) + known[at + size]
        size *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    return start, end, period


def _joined(start: np.ndarray, end: np.ndarray, period: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one period that share at least its number of words are one."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    reach = np.maximum.accumulate(end + period * most) - period * most  # the furthest end so far, of this period
    begins = np.flatnonzero(np.concatenate([[True], (period[1:] != period[:-1]) | (start[1:] > reach[:-1] - period[1:])]))
    return start[begins], np.maximum.reduceat(end, begins), period[begins]


def _extended(words: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Move starts down and ends up while words a period apart are identical."""
    start, end = start.copy(), end.copy()
    for which, step in ((start, -1), (end, 1)):
        live = np.arange(len(start))
        while len(live):
            a = which[live] - (step < 0)
            b = a - step * period[live]
            inside = (a >= 0) & (a < len(words))
            live = live[inside][words[a[inside]] == words[b[inside]]]
            which[live] += step
    return start, end


def runs_in(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """``(start, length, period)`` rows of all runs, by start, then period."""
    if times < 2:
        raise ValueError("a run repeats its period at least twice")
    start, end, period = stretches(words)
    if len(start):
        start, end, period = _joined(start, end, period, len(words) + 1)
        if times > 2:  # one length has blocks as long as the period and at most twice as long: it shows runs of three periods whole
            whole = end - start >= times * period
            start, end, period = start[whole], end[whole], period[whole]
        start, end = _extended(words, start, end, period)
        kept = end - start >= np.maximum(least, times * period)
        start, end, period = start[kept], end[kept], period[kept]
    return np.unique(np.stack([start, end - start, period], axis=1)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]] if len(start) else np.zeros((0, 3), np.int64)


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs.tolist():
        keep[start + period : start + length] = False
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def periodic(docs: DataFrame, least: int = LEAST, times: int = TIMES, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``, by default all) with ``n_words``, ``runs`` and ``collapsed``.

    A run is a stretch of words with smallest period ``period`` and a length of at least ``least`` and ``times`` periods
    that can't be made longer with it. ``collapsed`` is the text's words, joined by a space, without those that a run
    contains after its first period.
    """
    rows = frames.packed(docs, keep, text=F.coalesce("text", F.lit("")).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in frames.slices(whole, "text", TOGETHER):
                texts = [t.split() for t in batch.column("text").to_pylist()]  # of bytes: at ASCII white space
                sizes = np.array([len(t) for t in texts])
                begin = np.concatenate([[0], np.cumsum(sizes + 1)])  # a mark follows each text
                coded = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
                names = np.empty(begin[-1], dtype=np.int64)
                marks = begin[1:] - 1
                inner = np.ones(len(names), dtype=bool)
                inner[marks] = False
                names[inner] = coded.indices.to_numpy(zero_copy_only=False)
                names[marks] = len(coded.dictionary) + np.arange(len(texts))
                found = runs_in(names, least, times)
                cuts = np.searchsorted(found[:, 0], begin)
                own = [found[a:b] - [begin[i], 0, 0] for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
                left = [_collapsed(t, r) if len(r) else b" ".join(t) for t, r in zip(texts, own, strict=True)]
                flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, i] - (np.repeat(begin[:-1], np.diff(cuts)) if i == 0 else 0))) for i in range(3)], fields=list(_RUN))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes, pa.int64()), lists, pa.array(left, pa.binary()).cast(pa.string())], names=["row", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, frames.row_and(rows, f"n_words bigint, runs {RUNS}, collapsed string"))


def longest_lasting(runs: Column) -> Column:
    """The run of the greatest exact length / period; of equals the first, then the shortest period. Null without runs."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    better = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, none, lambda best, x: F.when(better(best, x), x).otherwise(best))


def with_planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where a tenth of the texts, by a checksum of the id, end in a period of their own words.

    Null ids have no checksum and keep their texts.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    rows = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.when(F.size("w") > 0, F.size("w")))
    rows = rows.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """The runs of the planted texts as checksums, with the longest-lasting one."""
    rows = periodic(with_planted(docs), keep=["doc_id"]).withColumn("best", longest_lasting(F.col("runs")))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    milli = F.expr("best.length * 1000 div best.period")
    return rows.select("row.doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
