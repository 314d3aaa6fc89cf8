"""Streaming ingest: JSON event files into the store; windowed turn counts.

A micro-batch goes in under the stream's name and its number. One that failed comes again under the same name and completes
what is missing; one that is whole changes nothing, so every event counts exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from continuo.plans.schemas import ENVELOPE
from continuo.sources.store import Store


def ingest_stream(spark: SparkSession, source: str, store: Store, checkpoint: str) -> StreamingQuery:
    events = spark.readStream.schema(ENVELOPE).json(source)
    return events.writeStream.foreachBatch(lambda batch, n: store.ingest(batch, f"{checkpoint} {n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def turn_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    timed = events.withColumn("at", F.try_to_timestamp("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "project_key").agg(F.count("*").alias("turns"))
