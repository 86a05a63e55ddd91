"""Streams: latency windows, job states, and the reassembly of token streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATENCY_SCHEMA = "stage string, status string, timestamp timestamp, request_id string, duration_ms double, strategy_name string, top_k int, backend string, returned_docs int, error_type string"


def latency_events(events: DataFrame) -> DataFrame:
    """The events table as latency events: the type is the stage, the value its duration."""
    return events.select(F.col("event_type").alias("stage"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("request_id"), F.col("value").alias("duration_ms"), "event_id")


def read_latency_log(spark: SparkSession, path: str) -> DataFrame:
    """An append-only log of JSON lines, as a stream."""
    return spark.readStream.schema(LATENCY_SCHEMA).json(path)


def _watermarked(latency: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, on a timestamp with time zone; a batch as it is."""
    return latency.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late) if latency.isStreaming else latency


def tumbling(latency: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per stage and window: events, errors, total and largest duration. Batch and stream alike; ``late`` bounds the state of a stream."""
    rows = _watermarked(latency, late)
    grouped = rows.groupBy(F.window("timestamp", width).alias("w"), "stage").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))
    return grouped.select(F.col("w.start").alias("window_start"), "stage", "n", "errors", F.round("total_ms", 4).alias("total_ms"), F.round("max_ms", 4).alias("max_ms"))


def sessions(latency: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each request between pauses of ``gap``."""
    rows = _watermarked(latency, late)
    grouped = rows.groupBy(F.session_window("timestamp", gap).alias("s"), "request_id").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"))
    return grouped.select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "request_id", "n", F.round("total_ms", 4).alias("total_ms"))


def percentiles(latency: DataFrame) -> DataFrame:
    """Events, mean and exact median of each stage."""
    return latency.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.round(F.median("duration_ms"), 6).alias("median_ms"), F.min("duration_ms").alias("min_ms"))


def append_log(latency: DataFrame, path: str, checkpoint: str):
    """A stream of latency events appended to JSON lines, exactly once."""
    return latency.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


_STATES = {"queued": 0, "running": 1, "completed": 2, "failed": 2}


def job_states(events: DataFrame):
    """A stream of job events (job_id, status, progress, ts) as each job's state after the batch. A finished job doesn't reopen."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, progress, seen = state.get if state.exists else ("queued", 0, 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        for new, done in zip(rows["status"], rows["progress"], strict=True):
            if _STATES.get(new, -1) >= _STATES[status] and _STATES[status] < 2:
                status, progress = new, max(progress, int(done or 0))
        state.update((status, progress, seen + len(rows)))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [progress], "events": [seen + len(rows)]})

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id string, status string, progress int, events bigint", "status string, progress int, events bigint", "update", "NoTimeout")


def assembled_answers(tokens: DataFrame):
    """A stream of server-sent events (request_id, seq, event, data) as whole answers, given out when ``done`` or ``error`` comes."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        text = state.get[0] if state.exists else ""
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            if row.event == "token":
                text += row.data or ""
            elif row.event in ("done", "error"):
                yield pd.DataFrame({"request_id": [key[0]], "answer": [text], "outcome": [row.event]})
                state.remove()
                return
        state.update((text,))

    return tokens.groupBy("request_id").applyInPandasWithState(step, "request_id string, answer string, outcome string", "text string", "append", "NoTimeout")


def sse_message(events: DataFrame) -> DataFrame:
    """Events as server-sent messages."""
    return events.withColumn("message", F.concat(F.lit("event: "), "event", F.lit("\ndata: "), F.to_json(F.struct("data")), F.lit("\n\n")))
