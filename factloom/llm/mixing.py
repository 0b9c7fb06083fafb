"""Interleaving sources to target weights by Pfair scheduling.

Targets give the sources to mix and their weights; every other source belongs to one pool, ``""``, with the weight
``rest``. A source's documents, in hash order, form blocks of ``block_chars`` characters, a size that doesn't depend on the
corpus. In the fluid schedule every source that has blocks left advances at its exact share of the weights of those that
have; when one runs out, the shares of the others grow. A block is released when the fluid enters it and due when the fluid
leaves it, and earliest deadline first serves released blocks one a slot. At no time is there more fluid than slots, so no
block is late: after any number of slots each source is less than one block off its target. In characters it is less than
two blocks and its longest document off: a document counts for the block in which its first character lies.

While no source runs out, windows repeat after as many slots as the weights, as whole numbers without a common divisor,
add up to, and so does the schedule once it has come to the same lead or lag of every source: one such period is made and
stands for all. So the plan has a few periods for each time a source runs out, whatever the size of the corpus, and a row
finds its slot by arithmetic. Weights are read as their decimal forms; those whose period would be longer than ``PERIOD``
slots are an error, not rounded. Every document is used once; weights only decide the order.

Positions of documents come from sums by chunk of a source and running sums inside each chunk, so a source with a third
of all rows is not one task.

Defined results: a null source is in the pool. A null text counts one character, as does every document besides its own.
Documents of equal hash, id and checksum follow each other in any order, for they are equal. Other columns come back as
they are, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from fractions import Fraction
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import frames

BLOCK_CHARS, PERIOD = 1 << 16, 1 << 14
#: Parts of a source whose running sums are made apart.
CHUNKS = 1 << 16
POOL = ""


def whole(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """The weights as whole numbers without a common divisor: the blocks of each source in a period of their sum."""
    if not weights or any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    unit = math.lcm(*(w.denominator for w in exact.values()))
    blocks = {s: int(w * unit) for s, w in exact.items()}
    common = math.gcd(*blocks.values())
    if sum(blocks.values()) // common > period:
        raise ValueError(f"the weights have a period of {sum(blocks.values()) // common} slots, above {period}")
    return {s: n // common for s, n in blocks.items()}


class Fluid:
    """Exact times at which each source has advanced by so many blocks."""

    def __init__(self, blocks: Mapping[str, int], weight: Mapping[str, int]) -> None:
        self.weight = weight
        #: From when on, and of which total weight; the last is the end.
        self.phases: list[tuple[Fraction, int]] = []
        now, left = Fraction(0), {s: Fraction(0) for s, n in blocks.items() if n > 0}
        #: Of each source: its progress when each phase begins in which it has blocks left.
        self.done: dict[str, list[Fraction]] = {s: [] for s in left}
        while left:
            total = sum(weight[s] for s in left)
            self.phases.append((now, total))
            for s, f in left.items():
                self.done[s].append(f)
            step = min((blocks[s] - f) * total / weight[s] for s, f in left.items())
            now += step
            left = {s: g for s, f in left.items() if (g := f + step * weight[s] / total) < blocks[s]}
        self.phases.append((now, 0))

    def at(self, source: str, progress: int) -> Fraction:
        done = self.done[source]
        k = bisect_right(done, progress) - 1
        begin, total = self.phases[k]
        return begin + (progress - done[k]) * total / self.weight[source]


class Stretch(NamedTuple):
    """Consecutive slots from ``begin`` on that repeat ``times`` times; the first time each has ``(source, block, slot, release, deadline)``."""

    begin: int
    times: int
    slots: list[tuple[str, int, int, int, int]]


def schedule(blocks: Mapping[str, int], weight: Mapping[str, int]) -> Iterator[Stretch]:
    """The whole schedule of ``blocks`` by the whole numbers ``weight``. Ties go to the earlier deadline, then to the source's name."""
    fluid = Fluid(blocks, weight)
    served = dict.fromkeys(sorted(fluid.done), 0)
    window: dict[str, tuple[int, int]] = {}

    def look(s: str) -> None:
        """The window of the next block of ``s``."""
        window.pop(s, None)
        if served[s] < blocks[s]:
            window[s] = math.floor(fluid.at(s, served[s])), math.ceil(fluid.at(s, served[s] + 1))

    for s in served:
        look(s)
    slot = 0
    for (begin, total), (until, _) in zip(fluid.phases, fluid.phases[1:], strict=False):
        while slot < math.ceil(until):
            before, first, made = dict(served), slot, []
            for slot in range(first, min(first + total, math.ceil(until))):
                deadline, s = min((deadline, s) for s, (release, deadline) in window.items() if release <= slot)
                made.append((s, served[s], slot, window[s][0], deadline))
                served[s] += 1
                look(s)
            slot += 1
            # A window that counts within a period of a slot lies within a period of it, so all these lie in this phase.
            steady = first >= begin + total and len(made) == total and all(served[s] - before[s] == weight[s] for s in before if before[s] < blocks[s])
            more = max(0, (math.floor(until) - slot - total - 1) // total) if steady else 0
            if more:
                slot += more * total
                for s in list(window):
                    served[s] += more * weight[s]
                    look(s)
            yield Stretch(first, 1 + more, made)


def plan_of(stretches: Iterable[Stretch]) -> Iterator[tuple[str, int, int, int, int, int, int, int, int, int]]:
    """``(source, first block, end block, quota, k, first slot, width, slot, release, deadline)``: where block ``first + k``
    and every ``quota``-th after it stand; slot, release and deadline count from the stretch's first slot."""
    for begin, times, slots in stretches:
        quota = Counter(s for s, *_ in slots)
        first: dict[str, int] = {}
        for s, block, slot, release, deadline in slots:
            low = first.setdefault(s, block)
            yield s, low, low + times * quota[s], quota[s], block - low, begin, len(slots), slot - begin, release - begin, deadline - begin


PLAN = ("source", "first", "end", "quota", "k", "from_slot", "width", "p_slot", "p_release", "p_deadline")


def mixed(docs: DataFrame, weights: Mapping[str, float], rest: float = 1.0, block_chars: int = BLOCK_CHARS, period: int = PERIOD, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``, by default all) with ``source, start, block, slot, release, deadline``; the mix is the order by ``slot, start``.

    ``weights``: target weight of each source to mix, ``rest`` of all others together.
    """
    spark = docs.sparkSession
    weight = whole({**weights, POOL: rest}, period)
    named = F.when(F.col("source").isin(*weights), F.col("source")).otherwise(POOL) if weights else F.lit(POOL)
    rows = frames.packed(docs, keep, source=named, chars=(F.length(F.coalesce("text", F.lit(""))) + 1).cast("bigint"), mark=frames.crc("text"), id=F.coalesce(F.col("doc_id").cast("bigint"), F.lit(frames.NULL_ID)))
    rows = rows.withColumn("hash", F.xxhash64(F.lit("mix"), "id", "mark"))
    rows = rows.withColumn("chunk", F.shiftrightunsigned("hash", 64 - CHUNKS.bit_length() + 1))
    sums = frames.cut(rows.groupBy("source", "chunk").agg(F.sum("chars").alias("sum")))
    blocks = {r.source: -(-r.chars // block_chars) for r in sums.groupBy("source").agg(F.sum("sum").alias("chars")).collect()}  # one row for each target, and the pool's
    rows_of = list(plan_of(schedule(blocks, weight)))
    kinds = {c: pa.string() if c == "source" else pa.int64() for c in PLAN}
    plan = spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows_of], kind) for i, (c, kind) in enumerate(kinds.items())})).drop("end", "quota")
    of = sorted({r[:4] for r in rows_of})
    runs = spark.createDataFrame([(s, [r[1:] for r in of if r[0] == s]) for s in sorted({r[0] for r in of})], "source string, runs array<struct<first bigint, end bigint, quota bigint>>")
    before = F.sum("sum").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("source", "chunk", F.coalesce(before, F.lit(0)).alias("before"))  # dealt as the window is, so only these few move
    inside = Window.partitionBy("source", "chunk").orderBy("hash", "id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("chars").over(inside), F.lit(0))).join(offsets, ["source", "chunk"])
    placed = placed.withColumn("start", F.col("before") + F.col("inside")).withColumn("block", F.floor(F.col("start") / block_chars).cast("bigint"))
    run = F.get(F.filter("runs", lambda x: x["end"] > F.col("block")), F.lit(0))
    placed = placed.select("row", "source", "start", "block").join(F.broadcast(runs), "source").withColumn("run", run).drop("runs").withColumn("ahead", F.col("block") - F.col("run.first"))
    placed = placed.withColumns({"first": F.col("run.first"), "k": F.pmod("ahead", "run.quota"), "turn": F.floor(F.col("ahead") / F.col("run.quota"))})
    begin = F.col("from_slot") + F.col("turn") * F.col("width")
    found = placed.join(F.broadcast(plan), ["source", "first", "k"])
    return found.select("row", "source", "start", "block", *((begin + F.col(f"p_{c}")).cast("bigint").alias(c) for c in ("slot", "release", "deadline")))


def in_mixed_order(docs: DataFrame, weights: Mapping[str, float], rest: float = 1.0) -> DataFrame:
    """The rows of ``docs`` laid out in the order of the mix: by range over the partitions, sorted inside each. Written to
    files, the order is that of the files' names and of the rows in each; :func:`with_positions` reads it back."""
    n = frames.partitions(docs.sparkSession)
    return mixed(docs, weights, rest).repartitionByRange(n, "slot", "start").sortWithinPartitions("slot", "start").select("row.*")


def with_positions(laid: DataFrame, **others: Column) -> DataFrame:
    """``row, position`` and ``others`` of a table read from the files that :func:`in_mixed_order` was written to: places in
    the mix, gapless from 0. One row a file says where it begins."""
    name, index = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    files = frames.cut(laid.select(name.alias("file"), index.alias("index")).groupBy("file").agg(F.count("*").alias("n")))
    before = F.sum("n").over(Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1))
    begins = files.select("file", F.coalesce(before, F.lit(0)).alias("begin"))
    rows = frames.packed(laid, file=name, index=index, **others)
    return rows.join(F.broadcast(begins), "file").select("row", (F.col("begin") + F.col("index")).alias("position"), *others)
