"""Counters of an endless run: gate outcomes by event time, late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quality import counters


def windowed_counters(gated: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, candidates, passed, rejected_blur, rejected_luma) of each window of a stream or table with a `reason`."""
    spans = gated.withWatermark(ts, late) if gated.isStreaming else gated
    found = spans.groupBy(F.window(ts, window).alias("w")).agg(*counters(gated))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "candidates", "passed", "rejected_blur", "rejected_luma")
