"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from factloom.plans.lineage import cut, shared_dir

#: Bytes that separate words: the space and the ASCII controls from tab to carriage return.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

NULL_ID = -(1 << 63)
"""Stands for a null document id inside packed arrays; it sorts before every other id."""


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, unless their Python finds it where the driver does."""
    near = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if ROOT in map(os.path.abspath, filter(None, near)) or any(f.endswith("/factloom.zip") for f in context.listFiles):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="factloom-"), "factloom")
    context.addPyFile(shutil.make_archive(base, "zip", ROOT, "factloom"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that ``column`` holds about ``most`` bytes in each piece.

    After the last piece the worker, which Spark keeps for later tasks, gives unused memory of Arrow's back.
    """
    array = batch.column(column)
    if batch.num_rows == 0:
        return
    ends = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + batch.num_rows + 1]
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, int(ends[first]) + most, side="right")) - 1)
        last = min(last, batch.num_rows)
        yield batch.slice(first, last - first)
        first = last
    pa.default_memory_pool().release_unused()


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's bounds in them; null is empty."""
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    data = data[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if array.null_count:  # a null may still own bytes
        sizes = np.diff(bounds)
        gone = np.asarray(array.is_null())
        if sizes[gone].any():
            keep = np.repeat(~gone, sizes)
            data = data[keep]
            sizes = np.where(gone, 0, sizes)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
    return data, bounds


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def quoted(name: str) -> F.Column:
    """The column of exactly this name."""
    return F.col(f"`{name.replace('`', '``')}`")


def packed(docs: DataFrame, keep: list[str] | None = None, **others: F.Column) -> DataFrame:
    """``row``, a struct of the columns ``keep`` of ``docs`` (by default all), so that none of them can clash with those that
    an operator adds, and ``others``."""
    return docs.select(F.struct(*map(quoted, docs.columns if keep is None else keep)).alias("row"), *(c.alias(n) for n, c in others.items()))


def let_go(spark: SparkSession) -> None:
    """Have Spark's cleaner drop shuffles and checkpoints that nothing refers to any more, before more are written."""
    gc.collect()
    spark._jvm.System.gc()


def schema_of(fields: list[StructField], ddl: str) -> StructType:
    """``fields``, which may be of any names, followed by those of ``ddl``."""
    return StructType([*fields, *StructType.fromDDL(ddl)])


def row_and(rows: DataFrame, ddl: str) -> StructType:
    """The schema of the ``row`` of :func:`packed` followed by the columns of ``ddl``."""
    return schema_of([rows.schema["row"]], ddl)


def crc(column: str) -> F.Column:
    """Tells rows of the same id and other text apart; null counts as empty."""
    return F.crc32(F.coalesce(F.col(column), F.lit("")).cast("binary"))
