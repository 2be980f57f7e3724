"""Streaming forms of the calendar bins and of the chunks; an extension, equal to the batch forms on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bins(fixes: DataFrame, hours: int = 6, late: str = "1 day") -> DataFrame:
    """Mean position by id and tumbling window; rows later than the watermark are left out."""
    out = fixes.withWatermark("ts", late).groupBy("id", F.window("ts", f"{hours} hours").alias("w"))
    return out.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n")).select("id", F.col("w.start").alias("bin"), "lat", "lon", "n")


def stream_chunks(fixes: DataFrame, gap: str = "2 days", late: str = "1 day") -> DataFrame:
    """Stays of each id without a gap, as session windows."""
    out = fixes.withWatermark("ts", late).groupBy("id", F.session_window("ts", gap).alias("w"))
    return out.agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).select("id", "first", "last", "n")
