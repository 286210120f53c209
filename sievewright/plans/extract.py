"""From frames to a training set: measure, gate, bucket, keep what is diverse and new, fill up, number, report."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import kernels, text
from ..operators import folds, geometry, near_hash, quality, selection
from .storage import written

MEASURES = "video string, frame_index long, t double, x int, y int, w int, h int, blur double, luma double, contrast double, completeness double, subject double, thumb array<float>, colours array<float>, hash long, error string"


def _image(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return a[..., :3] if channels >= 3 else np.repeat(a, 3, 2)


def measured(frames: DataFrame, config: Config, watermarks: DataFrame | None = None) -> DataFrame:
    """Every measure of every frame in one pass; pixels go no further than this. A frame that can't be measured has an error.

    With watermarks (video, watermarks) and the setting `crop_watermark`, crops leave the overlays out: the content
    rectangles are found in a pass of their own, geometry.crop_around() cuts them, and the measures are those of what is left.
    """
    names = [c.split()[0] for c in MEASURES.split(", ")]
    schema = pa.schema([(n, k) for n, k in zip(names, [pa.string(), pa.int64(), pa.float64(), *[pa.int32()] * 4, *[pa.float64()] * 5, *[pa.list_(pa.float32())] * 2, pa.int64(), pa.string()], strict=True)])

    def one(image: np.ndarray, rect: dict | None) -> dict:
        x, y, w, h = (rect[k] for k in "xywh") if rect else _content(image, config)
        part = image[y : y + h, x : x + w]
        grey = kernels.grey(part)
        luma, contrast = kernels.luma_stats(grey)
        out = {"x": x, "y": y, "w": w, "h": h, "blur": kernels.laplacian_variance(grey), "luma": luma, "contrast": contrast}
        out["completeness"] = kernels.completeness(part) if config.completeness_filter else None
        out["subject"] = kernels.subject_ratio(part) if config.subject_size_filter else None
        out["thumb"] = kernels.thumbnail(part).astype(np.float32) if config.ssim_filter else None
        out["colours"] = kernels.colour_fingerprint(part) if config.color_diversity else None
        bits = kernels.perceptual_hash(part, config.phash_size) if config.dedup else None
        return out | {"hash": None if bits is None else bits - (bits >> 63 << 64)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 8):  # few decoded images at a time
                rows = []
                for r in batch.slice(k, 8).to_pylist():
                    row = dict.fromkeys(names) | {n: r[n] for n in ("video", "frame_index", "t")}
                    try:
                        row |= one(_image(r["data"], r["height"], r["width"], r["channels"]), r.get("rect"))
                    except (ValueError, TypeError, IndexError) as e:
                        row["error"] = f"{type(e).__name__}: {e}"
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema)

    picked = frames.select("video", "frame_index", "t", "height", "width", "channels", "data")
    if watermarks is not None and config.crop_watermark:
        rect = F.struct(*(F.col(k).cast("long").alias(k) for k in "xywh"))
        boxes = F.transform(F.coalesce("watermarks", F.array().cast(watermarks.schema["watermarks"].dataType)), lambda o: F.struct(*(o[k].cast("long").alias(k) for k in "xywh")))
        cut = contents(frames, config).join(watermarks.select("video", "watermarks"), "video", "left")
        cut = cut.withColumn("rect", geometry.crop_around(*(rect[k] for k in "xywh"), boxes)).select("video", "frame_index", "rect")
        picked = picked.join(cut, ["video", "frame_index"], "left")
    return picked.mapInArrow(run, MEASURES)


def _content(image: np.ndarray, config: Config) -> tuple[int, int, int, int]:
    return kernels.letterbox(image, config.letterbox_threshold, config.letterbox_min_ratio) if config.detect_letterbox else (0, 0, image.shape[1], image.shape[0])


def contents(frames: DataFrame, config: Config) -> DataFrame:
    """(video, frame_index, x, y, w, h): what is inside of black bars; frames that can't be read have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                try:
                    rows.append((r["video"], r["frame_index"], *_content(_image(r["data"], r["height"], r["width"], r["channels"]), config)))
                except (ValueError, TypeError):
                    continue
            if rows:
                kinds = [pa.string(), pa.int64(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["video", "frame_index", *"xywh"])

    picked = frames.select("video", "frame_index", "height", "width", "channels", "data")
    return picked.mapInArrow(run, "video string, frame_index long, x int, y int, w int, h int")


def _reasons(rows: DataFrame, config: Config) -> DataFrame:
    threshold = F.lit(config.blur_threshold)
    if config.auto_quality:
        found = quality.auto_threshold(rows, config.auto_quality_percentile).select(F.col("video").alias("_v"), "threshold")
        rows = rows.join(found, F.col("video") == F.col("_v")).drop("_v")
        threshold = F.col("threshold")
    gate = quality.gate_reason(F.col("blur"), F.col("luma"), F.col("contrast"), threshold, config.min_brightness, config.max_brightness, config.min_contrast)
    reason = F.when(F.col("error").isNotNull(), "error").when(gate == quality.BLUR, "blur").when(gate != "", "luma")
    if config.completeness_filter:
        reason = reason.when(F.col("completeness") < config.completeness_threshold, "completeness")
    if config.subject_size_filter:  # a subject that couldn't be measured passes
        reason = reason.when(F.coalesce("subject", F.lit(1.0)) < config.subject_min_ratio, "completeness")
    return rows.withColumn("reason", reason.otherwise(""))


@dataclass
class Curated:
    """records: the kept frames. decisions: every frame with its reason, empty for kept ones. stats: numbers of each video."""

    records: DataFrame
    decisions: DataFrame
    stats: DataFrame


def curated(measures: DataFrame, config: Config, index: DataFrame | None = None, watermarks: DataFrame | None = None) -> Curated:
    """Decide for every measured frame.

    Gates come first, then, video by video and in order, diversity against the last accepted frames, then
    near-duplicates over all videos, first wins, in order of video and frame. Videos that end up with too few
    get their sharpest frames back from before the diversity filters. A run gives the same result
    whatever its parallelism.
    """
    rows = _reasons(written(measures), config)
    if config.resize_mode == "longest":
        long_ = geometry.longest(F.col("w").cast("long"), F.col("h").cast("long"), config.resolution)
        rows = rows.withColumns({"bucket_w": long_["new_w"], "bucket_h": long_["new_h"]})
    else:
        sizes = geometry.bucket_sizes(config.resolution, config.min_bucket, config.max_bucket, config.bucket_step)
        rows = geometry.with_bucket(rows, sizes, keep_all=True)
    small = (F.col("reason") == "") & (F.col("bucket_w") * F.col("bucket_h") < config.min_pixels)
    rows = rows.withColumn("reason", F.when(small, "too small").otherwise(F.col("reason")))
    gated = rows.where("reason = ''")

    filters: dict[str, folds.Filter] = {}
    if config.ssim_filter:
        filters["thumb"] = folds.Diverse(config.ssim_threshold)
    if config.color_diversity:
        filters["colours"] = folds.Colourful(config.color_distance)
    if config.dedup:
        filters["hash"] = folds.Unseen(config.phash_distance)  # within a video it also keeps a frame out of the memories
    folded = written(folds.fold(gated, filters, index="frame_index", most=config.max_per_video))
    accepted = gated.drop("reason", "thumb", "colours").join(folded.where("reason = ''").drop("reason"), ["video", "frame_index"])
    if config.dedup:
        ordered = written(_numbered(accepted.select("video", "frame_index", "hash")))
        wins = near_hash.first_wins(ordered, config.phash_distance, index=index, bits=config.phash_size**2)
        lost = ordered.join(wins.where("not kept").select("ord"), "ord").select("video", "frame_index", F.lit("dup").alias("global"))
    else:
        lost = accepted.where("false").select("video", "frame_index", F.lit("dup").alias("global"))
    lost = written(lost)
    accepted = accepted.join(lost, ["video", "frame_index"], "left_anti")
    kept = selection.backfilled(gated, accepted, config.min_per_video, config.max_per_video) if config.min_per_video else accepted.select("video", "frame_index", "blur", F.lit(False).alias("backfilled"))
    kept = written(kept)

    back = kept.select("video", "frame_index", F.lit(True).alias("kept"), "backfilled")
    base = rows.drop("thumb", "colours").join(folded.withColumnRenamed("reason", "fold"), ["video", "frame_index"], "left").join(lost, ["video", "frame_index"], "left").join(back, ["video", "frame_index"], "left")
    why = F.when(F.col("reason") != "", F.col("reason")).when(F.col("fold") != "", F.col("fold")).otherwise(F.coalesce("global", F.lit("")))
    decisions = base.withColumns({"reason": why, "kept": F.coalesce("kept", F.lit(False)), "backfilled": F.coalesce("backfilled", F.lit(False))}).drop("fold", "global")
    count = lambda name: F.count_if(F.col("reason") == name)
    stats = decisions.groupBy("video").agg(
        F.count("*").alias("candidates"), F.count_if("kept").alias("written"), F.count_if("backfilled").alias("backfilled"),
        count("blur").alias("rejected_blur"), count("luma").alias("rejected_luma"), count("too small").alias("rejected_too_small"), count("completeness").alias("rejected_completeness"),
        count("ssim").alias("rejected_ssim"), count("color").alias("rejected_color"), count("dup").alias("rejected_dup"), count("max").alias("rejected_max"), count("error").alias("errors"),
    )
    if watermarks is not None:
        stats = stats.join(watermarks, "video", "left")
    records = named(decisions.where("kept"), stats.select("video"), config).drop("kept", "reason", "error")
    return Curated(records, decisions, stats)


def named(kept: DataFrame, videos: DataFrame, config: Config) -> DataFrame:
    """Kept frames with `seq` and their `path`, which no other frame has: stems that several of the `videos` share, whatever
    their case, get eight digits of the md5 of their video's path, and a video's frames are counted without an upper bound."""
    stems = videos.select("video", text.sanitize_stem(text.file_stem(F.col("video"))).alias("_stem"))
    shared = stems.groupBy(F.lower("_stem").alias("_low")).agg(F.count("*").alias("_n"))
    own = F.when(F.col("_n") > 1, F.concat("_stem", F.lit("_"), F.substring(F.md5("video"), 1, 8))).otherwise(F.col("_stem"))
    stems = stems.join(shared, F.lower("_stem") == F.col("_low")).select("video", own.alias("_stem"))
    rows = kept.join(selection.places(stems, "video").withColumnRenamed("place", "_place"), "video")
    path = _folder(config, F.col("_stem"), selection.output_name(F.col("_stem"), F.col("in_video"), config.output_format))
    return selection.sequence_numbers(rows, "_place").withColumn("path", path).drop("_place", "_stem", "in_video")


def _numbered(rows: DataFrame) -> DataFrame:
    """With `ord`, a unique long in order of video and frame: sorted partitions are numbered one after the other."""
    ordered = rows.orderBy("video", "frame_index").withColumn("_id", F.monotonically_increasing_id())
    return ordered.withColumnRenamed("_id", "ord")


def _folder(config: Config, stem, name):
    folder = selection.folder(stem, F.lit(config.flatten_output), F.lit(config.kohya_repeats), F.lit(config.trigger_word))
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def rendered(records: DataFrame, frames: DataFrame, config: Config, encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(path, content): the kept frames, cropped, resized to their buckets, and encoded."""
    picked = records.select("video", "frame_index", "path", "x", "y", "w", "h", "bucket_w", "bucket_h")
    joined = frames.select("video", "frame_index", "height", "width", "channels", "data").join(picked, ["video", "frame_index"])
    fit = {"cover": kernels.cover, "contain": kernels.contain, "longest": lambda image, bw, bh: kernels.longest(image, max(bw, bh))}[config.resize_mode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4):
                out = []
                for r in batch.slice(k, 4).to_pylist():
                    image = _image(r["data"], r["height"], r["width"], r["channels"])[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]]
                    out.append({"path": r["path"], "content": encode(fit(image, r["bucket_w"], r["bucket_h"]))})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return joined.mapInArrow(run, "path string, content binary")


def captured(frames: DataFrame, video: str, frame_index: int, config: Config, seq: int, encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(path, content) of one frame that somebody picked: cropped and resized, but with no gate, filter or least size."""
    point = frames.where((F.col("video") == video) & (F.col("frame_index") == frame_index))
    sizes = None if config.resize_mode == "longest" else geometry.bucket_sizes(config.resolution, config.min_bucket, config.max_bucket, config.bucket_step)
    m = measured(point, config).where("error is null")
    if sizes is None:
        long_ = geometry.longest(F.col("w").cast("long"), F.col("h").cast("long"), config.resolution)
        placed = m.withColumns({"bucket_w": long_["new_w"], "bucket_h": long_["new_h"]})
    else:
        placed = geometry.with_bucket(m, sizes)
    stem = text.sanitize_stem(text.file_stem(F.col("video")))
    return rendered(placed.withColumn("path", F.concat(stem, F.lit(f"_manual_{seq:05d}.{config.output_format}"))), point, config, encode)
