"""Gates on frames: blur, light and contrast; thresholds taken from the data; time segments; resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLUR, DARK, BRIGHT, FLAT = "blur", "too dark", "too bright", "low contrast"


def gate_reason(blur: Column, luma: Column, contrast: Column, blur_threshold: Column | float = 100.0, min_brightness: float = 15.0, max_brightness: float = 245.0, min_contrast: float = 10.0) -> Column:
    """The first gate that fails, or an empty string. All comparisons are strict: a value at its bound passes."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return (
        F.when(blur < as_column(blur_threshold), BLUR)
        .when(luma < min_brightness, DARK)
        .when(luma > max_brightness, BRIGHT)
        .when(contrast < min_contrast, FLAT)
        .otherwise("")
    )


def gate_message(reason: Column, blur: Column, luma: Column, contrast: Column, blur_threshold: Column) -> Column:
    """What a report says of a failed gate."""
    return (
        F.when(reason == BLUR, F.format_string("blur %.1f < %.1f", blur, blur_threshold))
        .when(reason == FLAT, F.format_string("low contrast (%.1f)", contrast))
        .when(reason != "", F.concat(reason, F.format_string(" (%.1f)", luma)))
        .otherwise("")
    )


def counters(gated: DataFrame, video: str = "video", reason: str = "reason") -> list[Column]:
    """Aggregates: candidates, passed, and rejections by blur and by light or contrast."""
    r = F.col(reason)
    return [
        F.count("*").alias("candidates"),
        F.count_if(r == "").alias("passed"),
        F.count_if(r == BLUR).alias("rejected_blur"),
        F.count_if((r != "") & (r != BLUR)).alias("rejected_luma"),
    ]


def reject_counters(gated: DataFrame, video: str = "video", reason: str = "reason") -> DataFrame:
    return gated.groupBy(video).agg(*counters(gated, video, reason))


def run_totals(gated: DataFrame, video: str = "video", reason: str = "reason") -> DataFrame:
    """Counters of each video and, with a null video, of the run, in one pass."""
    return gated.rollup(video).agg(*counters(gated, video, reason))


def percentile_of(scores: Column, share: float) -> Column:
    """The percentile of a sorted array of doubles, null for an empty one, to the last bit of DuckDB's `quantile_cont`: between the
    two nearest, lo * (1 - d) + hi * d with the first product and the sum rounded at once. `F.percentile` rounds both, and a score that
    equals the threshold is then on the other side of it."""
    at = (F.size(scores) - 1) * F.lit(share)
    d = at - F.floor(at)
    lo, hi = (F.get(scores, place(at).cast("int")) for place in (F.floor, F.ceil))
    fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), lo, 1 - d, hi * d).cast("double")  # there is no such function in SQL
    return F.when(d == 0, lo).when(lo.isNotNull(), fused)


def auto_threshold(frames: DataFrame, keep_percent: float = 60.0, sample: int = 50, default: float = 50.0, video: str = "video", index: str = "frame_index", score: str = "blur") -> DataFrame:
    """(video, n_frames, threshold): the exact percentile of a sample's scores that keeps `keep_percent` of them.

    The sample is the `sample` frames of smallest hash of (video, index), at most; videos of fewer than ten
    frames have the default.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(video).orderBy(F.md5(F.concat_ws(":", F.col(video), F.col(index))), F.col(index))
    ranked = frames.select(video, index, score, F.row_number().over(order).alias("_rank"))
    picked = F.when(F.col("_rank") <= sample, F.col(score).cast("double"))
    found = ranked.groupBy(video).agg(F.count("*").alias("n_frames"), F.sort_array(F.collect_list(picked)).alias("_scores"))
    p = percentile_of(F.col("_scores"), 1 - keep_percent / 100)
    return found.select(video, "n_frames", F.when(F.col("n_frames") < 10, F.lit(default)).otherwise(F.coalesce(p, F.lit(default))).alias("threshold"))


def in_segments(frames: DataFrame, segments: DataFrame, video: str = "video", t: str = "t") -> DataFrame:
    """Frames inside one of their video's segments (video, start, stop), both ends included and in either order; videos without
    segments keep all of theirs."""
    spans = segments.select(F.col(video).alias("_video"), F.least("start", "stop").alias("_lo"), F.greatest("start", "stop").alias("_hi"))
    inside = frames.join(spans, (F.col(video) == F.col("_video")) & F.col(t).between(F.col("_lo"), F.col("_hi")), "left_semi")
    whole = frames.join(spans.select("_video").distinct(), F.col(video) == F.col("_video"), "left_anti")
    return inside.unionByName(whole)


def pending(videos: DataFrame, done: DataFrame, video: str = "video") -> DataFrame:
    """Videos that no earlier run has finished."""
    return videos.join(done.select(F.col(video).alias("_done")), F.col(video) == F.col("_done"), "left_anti")
