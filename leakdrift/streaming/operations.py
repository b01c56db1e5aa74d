"""Structured Streaming forms of the operation metrics and of the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from leakdrift.operators.scan import pattern_matches


def windowed_metrics(log: DataFrame, width: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and errors by event-time window and operation; rows later than the watermark are dropped."""
    log = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = log.groupBy(w.alias("w"), "op_type").agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("errors"))
    return rows.select(F.col("w.start").alias("start"), "op_type", "n", "errors")


def low_throughput(log: DataFrame, least: float = 10.0, late: str = "10 minutes") -> DataFrame:
    """Minutes with fewer than `least` operations a second."""
    log = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = log.groupBy(F.window("ts", "60 seconds").alias("w")).agg(F.count("*").alias("n")).where(F.col("n") / 60 < least)
    return rows.select(F.col("w.start").alias("start"), "n")


def scan_stream(docs: DataFrame) -> DataFrame:
    """Pattern matches of arriving documents, stateless."""
    return pattern_matches(docs)


def distinct_findings(found: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (file_path, start, end) once within the watermark."""
    return found.withWatermark("ts", late).dropDuplicatesWithinWatermark(["file_path", "start_position", "end_position"])


# The level of the log that an event of a severity goes to.
LEVELS = {"Critical": "error", "Warning": "warn", "Info": "info"}
MIB = 1024 * 1024


def log_level(severity: Column) -> Column:
    """The level of an event; what has no known severity is told as info."""
    pairs = [F.lit(x) for kv in LEVELS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), severity), F.lit("info"))


def routed(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Events (severity, more) to a folder for each level, each event once however often a batch is run again."""
    rows = events.withColumn("level", log_level(F.col("severity")))
    sink = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("level")
    return sink.outputMode("append").trigger(availableNow=True).start()


def windowed_memory(usage: DataFrame, width: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """usage (service, ts, event_id, usage) by window and service: last, peak, mean and growth a second, in MiB.

    First and last are by (ts, event_id); rows of one instant have no growth; rows behind the watermark are dropped.
    """
    rows = usage.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    at = F.struct("ts", "event_id")
    rows = rows.groupBy(F.window("ts", width, slide).alias("w"), "service").agg(
        F.max_by("usage", at).alias("_now"), F.min_by("usage", at).alias("_first"), F.max("usage").alias("_peak"), F.avg("usage").alias("_mean"),
        F.max(F.unix_micros("ts")).alias("_end"), F.min(F.unix_micros("ts")).alias("_begin"),
    )
    seconds = (F.col("_end") - F.col("_begin")) / 1e6
    growth = F.when(seconds > 0, (F.col("_now") - F.col("_first")) / MIB / seconds).otherwise(0.0)
    return rows.select(F.col("w.start").alias("start"), "service", (F.col("_now") / MIB).alias("current_mb"), (F.col("_peak") / MIB).alias("peak_mb"), (F.col("_mean") / MIB).alias("average_mb"), growth.alias("growth_mb_per_s"))
