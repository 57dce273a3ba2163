"""The events table read as a stream (an extension; see verbloom.streaming)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbloom.session import cut, dropped, shared_dir, table
from verbloom.streaming import ingest


def events_by_hour(spark: SparkSession, d: str) -> DataFrame:
    """Number of events by hour and type, from a stream run to its end."""
    stream = ingest.read_stream(spark, d, "events.parquet", table(spark, d, "events"))
    root = os.path.join(shared_dir(spark), f"stream-{uuid.uuid4().hex}")
    out = cut(ingest.run_once(ingest.windowed_counts(stream), root, "complete"))
    dropped(spark, root)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


QUERIES = {"events_by_hour": events_by_hour}
SQL = {"events_by_hour": "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL"}
