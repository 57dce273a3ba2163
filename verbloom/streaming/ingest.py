"""Continuous ingest, an extension: deduplicated pages and counts by time window of the events table.

The batch operators need nothing of this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their summed value by window and type; rows later than `late` behind the newest are left out."""
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return seen.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def read_stream(spark: SparkSession, folder: str, pattern: str, like: DataFrame) -> DataFrame:
    """Files of a folder as a stream with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).parquet(folder)


def run_once(stream: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """All that is there, as a table of files under `root`, a folder that all executors share; state and progress are kept
    beside it, so a run that is lost goes on where it was. In mode `complete` the table is that of the last batch."""
    spark, out = stream.sparkSession, f"{root}/rows"

    def whole(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True)
    query = writer.foreachBatch(whole).start() if mode == "complete" else writer.format("parquet").start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
