"""Queries: windows over the events, and a stream run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.tables import table
from ..streaming import refine
from .refining import _REFINED
from .registry import query


@query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS start_s, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = refine.window_statistics(table(spark, d, "events"), "ts", "1 hour", "value", "event_type")
    return rows.select(F.col("window_start").cast("timestamp").cast("double").alias("start_s"), "event_type", "events", F.round("total", 4).alias("total"))


@query("SELECT epoch(time_bucket(INTERVAL 30 MINUTE, ts) - o * INTERVAL 30 MINUTE) AS start_s, count(*) AS events FROM events, range(2) t(o) GROUP BY ALL")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = refine.window_statistics(table(spark, d, "events"), "ts", "1 hour", "value", slide="30 minutes")
    return rows.select(F.col("window_start").cast("timestamp").cast("double").alias("start_s"), "events")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, round(epoch(min(ts)), 3) AS start_s, count(*) AS events FROM s GROUP BY user_id, n"""
)
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = refine.session_statistics(table(spark, d, "events"), "ts", "30 minutes", "user_id")
    return rows.select("user_id", F.round(F.col("session_start").cast("timestamp").cast("double"), 3).alias("start_s"), "events")


@query(_REFINED + "SELECT doc_id, CAST(removed AS BIGINT) AS removed_lines, CAST(0 AS BIGINT) AS errors, status, md5(refined) AS refined FROM refined_rows")
def stream_refine(spark: SparkSession, d: str) -> DataFrame:
    """Documents refined as a stream of files that ends when there are no more; the result is read back."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, d, "documents")
    # the pattern finds the table whether it is a file or a folder
    done = refine.refine_stream(spark, f"{d}/documents*.parquet", rows.schema, "doc_id", "text", f"{folder}/out", f"{folder}/state")
    done.awaitTermination()
    return spark.read.schema("doc_id bigint, program string, errors bigint, removed_lines bigint, status string, refined string").parquet(f"{folder}/out").select("doc_id", "removed_lines", "errors", "status", F.md5("refined").alias("refined"))
