"""Structured Streaming forms of conversation ingest and of prefix counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.rules import statements, subject, subject_entities
from ..functions.text import stable_id

TURNS = "conversation_id string, turn_id string, role string, content string, ts timestamp"


def conversation_stream(spark: SparkSession, path: str) -> DataFrame:
    """Turns that arrive as JSON files in a folder."""
    return spark.readStream.schema(TURNS).json(path)


def item_stream(turns: DataFrame, late: str = "1 hour", cues: dict | None = None) -> DataFrame:
    """Items stated in users' turns; repeats within the watermark go."""
    said = turns.withWatermark("ts", late).where(F.lower("role").isin("user", "human"))
    rows = said.select("conversation_id", "turn_id", "ts", F.explode(statements("content", cues)).alias("s")).select("conversation_id", "turn_id", "ts", "s.item_type", "s.statement")
    once = rows.dropDuplicatesWithinWatermark(["conversation_id", "item_type", "statement"])
    return once.select(stable_id("conv_item", "conversation_id", "turn_id", "item_type", "statement").alias("item_id"), "conversation_id", "turn_id", "ts", "item_type", subject("statement").alias("subject"), "statement", subject_entities(subject("statement"), "statement").alias("entity_ids"))


def append_items(items: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append items to a table of Parquet files, exactly once by the file sink's own log."""
    return items.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unit_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and type: the running form of the prefix counters."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def upsert_each(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch with its number to ``write``, which must be idempotent in the number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
