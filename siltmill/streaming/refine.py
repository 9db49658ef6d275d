"""Streams: refinement that goes on where it stopped, and windows over event time. Extensions of the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import filled
from ..operators import models, programs


def refine_stream(spark: SparkSession, source: str, schema: K.StructType, key: str, text: str, target: str, checkpoint: str, files_a_batch: int = 1_000) -> StreamingQuery:
    """Refines the Parquet files of a folder that are not refined yet, and ends. The checkpoint knows which are done, so a run that broke off is resumed by another."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    own = models.with_rule_program(rows.withColumn("refine_input", filled(F.col(text))), "refine_input", "program")
    done = programs.accept(programs.execute(own, "refine_input", "program"), "refine_input").select(key, "program", "errors", "removed_lines", "status", "refined")
    return done.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_statistics(events: DataFrame, time: str, size: str, value: str, *keys: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count and sum of each tumbling or sliding window and key. On a stream, rows later than `late` are left out and state is dropped."""
    rows = events.withWatermark(time, late) if late else events
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("events"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "events", "total")


def session_statistics(events: DataFrame, time: str, gap: str | Column, *keys: str, late: str | None = None) -> DataFrame:
    """Sessions of each key: they end after a gap without events."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "events")
