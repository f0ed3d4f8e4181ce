"""The stateless screens under Structured Streaming, and deduplication within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.functions.signals import with_signals
from plainsight.functions.text import normalise, skeleton


def screened(stream: DataFrame, text: str = "text") -> DataFrame:
    """Signals, key and skeleton of every arriving row; no state."""
    return with_signals(stream, text).withColumn("key", normalise(F.col(text))).withColumn("skeleton", skeleton(F.col(text)))


def first_arrivals(stream: DataFrame, time: str = "loaded_at", text: str = "text", late: str = "1 day") -> DataFrame:
    """Rows whose normalised text has not arrived within the watermark; state is dropped as the watermark passes."""
    keyed = stream.withColumn(time, F.col(time).cast("timestamp")).withColumn("key", normalise(F.col(text)))
    return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["key"])


def windowed_signals(stream: DataFrame, signal: str, time: str = "loaded_at", width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Rows and rows with a signal per window of arrival and source."""
    t = stream.withColumn(time, F.col(time).cast("timestamp"))
    return (
        with_signals(t.select(time, "source", "text"))
        .withWatermark(time, late)
        .groupBy(F.window(time, width), "source")
        .agg(F.count("*").alias("n"), F.count_if(F.col(signal) > 0).alias("n_signal"))
        .select(F.col("window.start").alias("start"), "source", "n", "n_signal")
    )
