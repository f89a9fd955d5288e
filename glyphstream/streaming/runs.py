"""Runs over a stream of observations, with event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch


def session_runs(obs: DataFrame, gap: str, late: str) -> DataFrame:
    """A streaming frame of runs: sightings of a text in a stream less than `gap` apart. Rows later than `late` are dropped; in append mode a run comes out, and leaves the state, once it can't go on."""
    rows = obs.withWatermark("ts", late)
    one = rows.groupBy(F.session_window("ts", gap).alias("w"), "stream_id", "text").agg(F.count("*").alias("n_obs"), F.min("t_us").alias("t_start"), F.max("t_us").alias("t_last"))
    return one.drop("w")


def drain(runs: DataFrame) -> DataFrame:
    """Runs the stream until its source has no more, and returns the result as a table, empty if there was nothing.

    For sources that end: in complete mode runs that are still open count too, each batch's table
    replaces the one before, and the state holds all runs. A source without an end takes
    session_runs() in append mode.
    """
    spark = runs.sparkSession
    to, state = scratch(spark, "stream-runs"), scratch(spark, "stream-state")
    written: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{to}/{number}"
        batch.write.mode("overwrite").parquet(path)
        written.append(path)

    query = runs.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(written[-1]) if written else spark.createDataFrame([], runs.schema)
