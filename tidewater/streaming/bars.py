"""Bars and sessions over streams of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_bars(ticks: DataFrame, ts: str, key: str, seq: str, px: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Bars by key and window; rows over ``late`` behind the watermark are left out.  Equal to the batch bars when no row is late."""
    return (
        ticks.withWatermark(ts, late)
        .groupBy(F.window(ts, width).alias("w"), F.col(key))
        .agg(F.min_by(px, seq).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, seq).alias("close"), F.count("*").alias("n_input"))
        .select(key, F.col("w.start").alias("start"), "open", "high", "low", "close", "n_input")
    )


def sessions(ticks: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of rows by key without a longer gap."""
    found = ticks.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
