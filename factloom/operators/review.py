"""Review risk, and packing of chunks into a budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.plans.lineage import cut


def risk(changed: DataFrame, fan_in: DataFrame, tests: DataFrame, violations: DataFrame, commits: int) -> DataFrame:
    """``id, fan_in, tests, violations, risk``: (fan-in + 1) · (1 + 0.1·commits) · (0.5 if tested) · (1 + 0.3·violations), to 2 places."""
    joined = changed.select("id").join(fan_in, "id", "left").join(tests, "id", "left").join(violations, "id", "left").na.fill(0, ["fan_in", "tests", "violations"])
    score = (F.col("fan_in") + 1) * F.lit(1 + 0.1 * commits) * F.when(F.col("tests") > 0, 0.5).otherwise(1.0) * (1 + F.lit(0.3) * F.col("violations"))
    return joined.withColumn("risk", F.floor(score * 100 + 0.5) / 100)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[np.ndarray]]]:
    """``(group, tokens of its rows in order, by batch)`` of a sorted partition, a batch's rows of one group at a time."""
    for batch in batches:
        groups, tokens = batch.column("g"), batch.column("tokens").to_numpy()
        ends = np.flatnonzero(np.asarray(pc.not_equal(groups[1:], groups[:-1]))) + 1 if batch.num_rows > 1 else []
        for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
            if b > a:
                yield groups[a].as_py(), tokens[a:b]


def _advanced(used: np.ndarray, tokens: np.ndarray, budget: int) -> np.ndarray:
    """What each of the sums ``used`` becomes when ``tokens`` pass in order. Sums that have met stay together."""
    values, back = np.unique(used, return_inverse=True)
    for n in tokens.tolist():
        if n and values[0] + n <= budget:
            fits = int(np.searchsorted(values, budget - n, side="right"))
            moved = values.copy()
            moved[:fits] += n
            values, again = np.unique(moved, return_inverse=True)
            back = again[back]
    return values[back]


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last group of each partition."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = (batch.column("pid")[0].as_py(), batch.column("g")[0].as_py()) if first is None else first
            last = batch.column("g")[-1].as_py()
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first[0]], pa.int32()), pa.array([first[1]], pa.string()), pa.array([last], pa.string())], names=["pid", "first", "last"])


def packed(chunks: DataFrame, group: str, budget: int) -> DataFrame:
    """``chunks(group, priority, id, tokens)`` with ``included``: by priority, each chunk that still fits the budget; one that doesn't is passed over.

    Rows are dealt by range of group and priority, so a hot group lies in many partitions. What fits depends on all that
    came before only by the tokens used so far. A partition in the middle of a group is thus a function of the sum it begins
    with, a table of at most ``budget + 1`` entries; the tables of a group, one a partition, are applied one after the other,
    and then every partition is filled from its own beginning. Chunks that are too large by themselves don't take part.
    """
    small = F.col("tokens") <= budget
    key = F.struct(F.col(group)).alias("k")  # a null group is a group
    rows = chunks.where(small).select(group, F.to_json(key).alias("g"), "priority", "id", F.col("tokens").cast("bigint").alias("tokens"))
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(n, "g", "priority", "id").sortWithinPartitions("g", "priority", "id").withColumn("pid", F.spark_partition_id()))
    borders = sorted(rows.select("pid", "g").mapInArrow(_borders, "pid int, first string, last string").collect())  # one row a partition
    goes_on = {b.pid for a, b in zip(borders, borders[1:], strict=False) if a.last == b.first}  # begins inside a group
    handed = {a.pid for a, b in zip(borders, borders[1:], strict=False) if b.pid in goes_on}  # ends inside one

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition that ends inside a group: that group, and what each sum before its rows becomes."""
        now, used, pid = None, None, None
        for batch in batches:
            pid = batch.column("pid")[0].as_py() if batch.num_rows else pid
            for g, tokens in _runs([batch]):
                if now is None or g != now:  # a group that begins here begins with nothing used
                    used = np.arange(budget + 1) if now is None and pid in goes_on else np.zeros(1, np.int64)
                    now = g
                used = _advanced(used, tokens, budget)
        if pid is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([now], pa.string()), pa.array([used.astype(np.int32).tobytes()], pa.binary())], names=["pid", "g", "table"])

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sum after each partition, from its group's tables in order."""
        now, used = None, 0
        for batch in batches:
            pids, sums = batch.column("pid").to_pylist(), []
            for g, table in zip(batch.column("g").to_pylist(), batch.column("table"), strict=True):
                table = np.frombuffer(table.as_buffer(), dtype=np.int32)
                used = int(table[0 if len(table) == 1 else used if g == now else 0])
                now = g
                sums.append(used)
            yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), pa.array(sums, pa.int64())], names=["pid", "used"])

    starts: dict[int, int] = {}
    if handed:
        made = rows.where(F.col("pid").isin(*handed)).select("pid", "g", "tokens").mapInArrow(tables, "pid int, g string, table binary")
        after = cut(made).repartition("g").sortWithinPartitions("g", "pid").mapInArrow(applied, "pid int, used bigint").collect()  # a number a partition
        ends = {r.pid: r.used for r in after}
        starts = {b.pid: ends[a.pid] for a, b in zip(borders, borders[1:], strict=False) if b.pid in goes_on}

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, 0
        for batch in batches:
            fits = []
            for g, n, pid in zip(batch.column("g").to_pylist(), batch.column("tokens").to_pylist(), batch.column("pid").to_pylist(), strict=True):
                if now is None:
                    used = starts.get(pid, 0)
                elif g != now:
                    used = 0
                now = g
                fits.append(used + n <= budget)
                used += n if fits[-1] else 0
            yield pa.RecordBatch.from_arrays([batch.column(group), batch.column("id"), pa.array(fits, pa.bool_())], names=[group, "id", "included"])

    fields = [f for name in (group, "id") for f in chunks.schema if f.name == name]
    folded = rows.mapInArrow(filled, StructType([*fields, *StructType.fromDDL("included boolean")]))
    return folded.unionByName(chunks.where(~F.coalesce(small, F.lit(False))).select(group, "id", F.lit(False).alias("included")))
