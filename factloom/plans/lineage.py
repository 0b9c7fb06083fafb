"""Cutting the lineage of iterative plans, and the folder that tasks share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one, as in tests, gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="factloom-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Write ``df`` to the shared folder, dealt and sorted by ``keys``, and go on from there: joins on the keys don't move it again.

    Adaptive execution would forget how the rows are dealt, so it is off while they are written.
    """
    spark = df.sparkSession
    shared_dir(spark)
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.repartition(n, *keys).sortWithinPartitions(*keys).checkpoint()
    finally:
        spark.conf.set(name, before)
