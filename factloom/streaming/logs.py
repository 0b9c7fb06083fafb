"""Log events as a stream, rolled up to incidents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import incidents


def read(spark: SparkSession, sf_dir: str, schema: str = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string") -> DataFrame:
    """The events file as a stream; other tables of the folder are left alone."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def roll_up(logs: DataFrame) -> DataFrame:
    """The batch roll-up on a stream: one group for each service and title."""
    return incidents.incidents(logs)


def windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and errors by tumbling window; a window comes out once the watermark has passed it."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "errors")


def run_once(stream: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what there is now, and give its result table, which the tasks write as Parquet under ``checkpoint``."""
    base = f"{checkpoint.rstrip('/')}/s{uuid.uuid4().hex}"
    out = f"{base}-rows"

    def put(batch: DataFrame, number: int) -> None:
        # complete: each batch is the whole table; else a repeated batch overwrites its own folder
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    put(stream.sparkSession.createDataFrame([], stream.schema), -1)  # a stream without data has no batch
    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", base).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out).select(*stream.columns)
