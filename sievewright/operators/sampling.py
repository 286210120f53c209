"""Candidates: scenes from jumps, frames of scenes, frames at intervals, thinning by distance."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scenes(frames: DataFrame, threshold: float, skip: int = 4, video: str = "video", index: str = "frame_index", content: str = "luma", t: str = "t", delta: str | None = None, least: int = 0) -> DataFrame:
    """(video, scene, start_frame, end_frame, start_time, end_time): a new scene begins where the content of frames that are
    `skip` + 1 apart differs by the threshold or more. The end is exclusive: the next scene's start, or the number of frames.

    delta: a column that has the difference already, in place of `content`. least: frames that a scene has at least;
    a cut that comes sooner after the last one is none.
    """
    order = Window.partitionBy(video).orderBy(index)
    whole = Window.partitionBy(video)
    seen = frames.withColumns({"_n": F.max(index).over(whole) + 1, "_last": F.max(t).over(whole)}).where(F.col(index) % (skip + 1) == 0)
    gap = F.col(delta) if delta else F.abs(F.col(content) - F.lag(content).over(order))
    seen = seen.withColumn("_cut", F.when(F.col(index) > 0, F.coalesce((gap >= threshold).cast("int"), F.lit(0))).otherwise(0))
    if least > 0:
        apart = thinned(seen.where((F.col("_cut") == 1) | (F.col(index) == 0)), least, video, index).withColumn("_far", F.lit(1))
        seen = seen.join(apart, [video, index], "left").withColumn("_cut", F.when(F.col("_far") == 1, F.col("_cut")).otherwise(0))
    numbered = seen.withColumn("scene", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    starts = numbered.groupBy(video, "scene").agg(F.min(index).alias("_from"), F.min(t).alias("start_time"), F.max("_n").alias("_n"), F.max("_last").alias("_last"))
    after = Window.partitionBy(video).orderBy("scene")
    first = F.when(F.col("scene") == 0, 0).otherwise(F.col("_from")).cast("long")
    return starts.select(
        video,
        F.col("scene").cast("long").alias("scene"),
        first.alias("start_frame"),
        F.coalesce(F.lead("_from").over(after), F.col("_n")).cast("long").alias("end_frame"),
        "start_time",
        F.coalesce(F.lead("start_time").over(after), F.col("_last")).alias("end_time"),
    )


def scene_indices(start: Column, end: Column, count: Column) -> Column:
    """Frames of a scene: its start if it has one frame, its middle for a count of one, else evenly spaced ones inside a margin
    of a tenth, rounded half to even. Repeated indices are left in."""
    start, end, count = start.cast("long"), end.cast("long"), count.cast("int")
    n = F.greatest(F.lit(1).cast("long"), end - start)
    margin = F.greatest(F.lit(1).cast("long"), F.floor(n / 10))
    inner = end - margin > start + margin
    lo = F.when(inner, start + margin).otherwise(start)
    hi = F.when(inner, end - margin).otherwise(end)
    step = (hi - lo) / F.greatest(count - 1, F.lit(1))
    many = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.rint(lo + i * step).cast("long"))
    return F.when(n <= 1, F.array(start)).when(count <= 1, F.array(F.floor((start + end) / 2))).otherwise(many)


def sampled(scene_rows: DataFrame, per_scene: int = 5, interval_seconds: float | None = None, video: str = "video") -> DataFrame:
    """(video, frame_index) of all scenes, distinct. With an interval, long scenes give as many frames as it asks for."""
    count = F.lit(per_scene)
    if interval_seconds is not None:
        count = F.greatest(count, F.floor((F.col("end_time") - F.col("start_time")) / interval_seconds).cast("int"))
    picked = scene_rows.select(video, F.explode(scene_indices(F.col("start_frame"), F.col("end_frame"), count)).alias("frame_index"))
    return picked.distinct()


def at_intervals(videos: DataFrame, interval_seconds: float, fps: str = "fps", frame_count: str = "frame_count", video: str = "video") -> DataFrame:
    """(video, frame_index): frames 0, step, 2 step, ... with a step of interval times fps, one at least; none without fps or frames."""
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(interval_seconds) * F.col(fps)).cast("long"))
    good = videos.where((F.col(fps) > 0) & (F.col(frame_count) > 0))
    return good.select(video, F.explode(F.sequence(F.lit(0).cast("long"), (F.col(frame_count) - 1).cast("long"), step)).alias("frame_index"))


def first_frames(frames: DataFrame, most: int = 200, video: str = "video", index: str = "frame_index") -> DataFrame:
    """The first `most` frames of each video, as a decoder of key frames stops there."""
    order = Window.partitionBy(video).orderBy(index)
    return frames.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= most).drop("_row")


def thinned(frames: DataFrame, gap: int | str, video: str = "video", index: str = "frame_index") -> DataFrame:
    """(video, frame_index) that are at least `gap`, a number or a column, after the last kept one; a video's first is kept.

    Rows are dealt by video and sorted, and a task remembers one number: no group is held in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video_now, last = object(), 0
        for batch in batches:
            keep = []
            for v, i, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                take = v != video_now or i - last >= least
                if take:
                    video_now, last = v, i
                keep.append(take)
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    rows = frames.select(video, index, (F.col(gap) if isinstance(gap, str) else F.lit(gap)).cast("long").alias("_gap")).distinct()
    return rows.repartition(video).sortWithinPartitions(video, index).mapInArrow(run, frames.select(video, index).schema)


def even_sample(videos: DataFrame, count: int, fewest: int = 5, frame_count: str = "frame_count", video: str = "video") -> DataFrame:
    """(video, frame_index) of `count` frames at a fixed step from the start; none of videos with too few frames."""
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col(frame_count) / count).cast("long"))
    picked = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")), lambda i: i * step)
    return videos.where(F.col(frame_count) >= fewest).select(video, F.explode(F.filter(picked, lambda i: i < F.col(frame_count))).alias("frame_index"))


def probed_size(line: Column) -> Column:
    """Struct (w, h) of a decoder's description of a video stream; zeros where it has no size."""
    side = lambda k: F.coalesce(F.regexp_extract(line, r"(\d{2,5})x(\d{2,5})", k).try_cast("int"), F.lit(0))
    return F.struct(side(1).alias("w"), side(2).alias("h"))


def video_meta(frames: DataFrame, video: str = "video", index: str = "frame_index", t: str = "t") -> DataFrame:
    """(video, fps, frame_count, width, height, duration_s) of decoded frames; fps is 0 where time doesn't pass."""
    last, first = F.max(F.struct(F.col(index), F.col(t))), F.min(F.struct(F.col(index), F.col(t)))
    seen = frames.groupBy(video).agg(last.alias("_l"), first.alias("_f"), F.max("width").alias("width"), F.max("height").alias("height"))
    span = F.col(f"_l.{t}") - F.col(f"_f.{t}")
    fps = F.when(span > 0, (F.col(f"_l.{index}") - F.col(f"_f.{index}")) / span).otherwise(0.0)
    out = seen.select(video, fps.alias("fps"), (F.col(f"_l.{index}") + 1).alias("frame_count"), "width", "height")
    return out.withColumn("duration_s", F.when(F.col("fps") > 0, F.col("frame_count") / F.col("fps")).otherwise(0.0))


def at_times(frames: DataFrame, times: DataFrame, video: str = "video", index: str = "frame_index", t: str = "t") -> DataFrame:
    """(video, t, frame_index): for each wanted time of a video the first frame at or after it; times past the end have none.

    An as-of join without a join of ranges: both sides in one order, each time takes the next frame that follows.
    """
    shown = frames.select(video, F.col(t).alias("t"), F.col(index).alias("frame_index"), F.lit(1).alias("_kind"))
    asked = times.select(video, F.col("t"), F.lit(None).cast(shown.schema["frame_index"].dataType).alias("frame_index"), F.lit(0).alias("_kind")).distinct()
    order = Window.partitionBy(video).orderBy("t", "_kind", "frame_index").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    following = shown.unionByName(asked).withColumn("frame_index", F.first("frame_index", ignorenulls=True).over(order))
    return following.where("_kind = 0 and frame_index is not null").select(video, "t", "frame_index")


def synthetic_times(frames: DataFrame, step: float = 2.0, video: str = "video", index: str = "frame_index") -> DataFrame:
    """With `t` made up as place times step, for decoders that give key frames without their times."""
    order = Window.partitionBy(video).orderBy(index)
    return frames.withColumn("t", (F.row_number().over(order) - 1) * F.lit(step))
