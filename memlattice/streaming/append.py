"""Appending memories from a stream, and indexing what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memlattice.functions.text import words


def append_memories(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch becomes files under path, once: a batch that is repeated after a failure replaces its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def postings(members: DataFrame) -> DataFrame:
    """(session_id, memory_idx, length, term, tf): additive, so an index of new memories is appended to that of the old."""
    tokens = members.select("session_id", "memory_idx", words(F.col("text")).alias("t"))
    flat = tokens.select("session_id", "memory_idx", F.size("t").alias("length"), F.explode("t").alias("term"))
    return flat.groupBy("session_id", "memory_idx", "length", "term").agg(F.count("*").alias("tf"))


def extended(index: DataFrame, memories: DataFrame) -> DataFrame:
    """The index with the memories it lacks."""
    new = memories.join(index.select("session_id", "memory_idx").distinct(), ["session_id", "memory_idx"], "left_anti")
    return index.unionByName(postings(new))


def windowed_counts(spark: SparkSession, events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: tumbling counts by event type with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
