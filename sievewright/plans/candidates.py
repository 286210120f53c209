"""Which frames of which videos become candidates: only these are decoded for the run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text
from ..operators import overlays, quality, sampling
from ..sources import settings, video
from .storage import written

#: Frames that a scene has at least, frames that the scan leaves out between two, key frames of a video at most.
LEAST_SCENE, SKIP, KEYFRAMES = 15, 4, 200


@dataclass
class Candidates:
    """frames: the decoded candidates. meta: a row for each video that was looked at (None for a stream of key frames)."""

    frames: DataFrame
    meta: DataFrame | None


def meta_of_scan(scan: DataFrame) -> DataFrame:
    """video_meta() of what video.scanned() gives."""
    return sampling.video_meta(scan)


def picked(videos: DataFrame, decoder: str, config: Config) -> tuple[DataFrame, DataFrame]:
    """((video, frame_index), meta): by scenes, by scenes and time, or at intervals; in time segments; thinned for key frames."""
    if config.sampling == "interval":
        meta = written(video.probed(videos, decoder))
        picks = sampling.at_intervals(meta, config.interval_seconds)
    else:
        scan = written(video.scanned(videos, decoder, SKIP))
        meta = written(meta_of_scan(scan))
        scenes = sampling.scenes(scan, config.scene_threshold, SKIP, delta="delta", least=LEAST_SCENE)
        plain = sampling.sampled(scenes, config.frames_per_scene)
        if config.sampling == "hybrid":  # without a frame rate there is no time to sample by
            timed = sampling.sampled(scenes, config.frames_per_scene, config.interval_seconds)
            with_rate = meta.select("video", (F.col("fps") > 0).alias("timed"))
            plain = timed.join(with_rate.where("timed"), "video", "left_semi").unionByName(plain.join(with_rate.where("not timed"), "video", "left_semi"))
        picks = plain
    known = meta.select("video", "fps", "frame_count")
    picks = picks.join(known, "video").where("frame_index < frame_count")
    if config.segments:
        picks = in_segments(picks.withColumn("t", F.col("frame_index") / F.col("fps")), config)
    if config.decode_mode == "keyframe":  # one frame for each group of pictures, of two seconds or so
        gap = F.greatest(F.lit(30).cast("long"), F.floor(F.col("fps") * 2).cast("long"))
        picks = sampling.thinned(picks.where("fps > 0").withColumn("gap", gap), "gap").unionByName(picks.where("fps <= 0").select("video", "frame_index"))
    return picks.select("video", "frame_index"), meta


def in_segments(frames: DataFrame, config: Config) -> DataFrame:
    """Frames in the settings' time segments, which name videos by their file's name."""
    spans = settings.spans(frames.sparkSession, config.segments).withColumnRenamed("video", "_name")
    return quality.in_segments(frames.withColumn("_name", text.file_name(F.col("video"))), spans, video="_name").drop("_name")


def candidates(videos: DataFrame, decoder: str, config: Config) -> Candidates:
    """The decoded candidates of videos (video: a path). A decoder that streams key frames does so in the key-frame mode, without a look for scenes."""
    if config.decode_mode == "keyframe" and hasattr(video.named(decoder), "keyframes"):
        frames = video.keyframes(videos, decoder, KEYFRAMES)
        return Candidates(in_segments(frames, config) if config.segments else frames, None)
    picks, meta = picked(videos, decoder, config)
    return Candidates(video.decoded(written(picks), decoder, config.seek_accurate, config.workers or None), meta)


def overlaid(videos: DataFrame, decoder: str, meta: DataFrame | None = None, count: int = 8, fewest: int = 5) -> DataFrame:
    """overlays.detected() of videos: of each, a few frames are decoded."""
    meta = written(video.probed(videos, decoder)) if meta is None else meta
    return overlays.of_samples(video.decoded(sampling.even_sample(meta, count, fewest), decoder), videos)
