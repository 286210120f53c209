"""Static overlays of videos, such as logos: a few frames of each video are enough to see what doesn't move.

Pixels give measures of still regions; which of them are overlays, and where, is decided in columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from . import geometry
from .sampling import even_sample

BOX = "array<struct<x:int,y:int,w:int,h:int,confidence:double,location:string>>"
REGION = "frame_w int, frame_h int, place int, x int, y int, w int, h int, edge double, static double, bimodal double"


def confident(regions: DataFrame, key: str, *ties: str, min_confidence: float = 0.6, most: int = 3) -> DataFrame:
    """Regions that can be overlays, with `confidence`, `location` and `rank`: the `most` most confident ones of each key; of equal ones those that `ties` order first."""
    box = [F.col(c) for c in "xywh"]
    size = [F.col("frame_w"), F.col("frame_h")]
    good = regions.where(geometry.overlay_gate(*box, *size, F.col("edge"), F.col("static"), F.col("bimodal")))
    scored = good.withColumns({"confidence": geometry.overlay_confidence(F.col("edge"), F.col("w"), F.col("h"), F.col("bimodal")), "location": geometry.position(*box, *size)})
    order = Window.partitionBy(key).orderBy(F.col("confidence").desc(), *ties)
    return scored.where(F.col("confidence") >= min_confidence).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def detected(frames: DataFrame, sample_count: int = 8, fewest: int = 5, min_confidence: float = 0.6) -> DataFrame:
    """(video, watermarks array of boxes): the three most confident ones of each video, an empty array for none.

    frames: (video, frame_index, height, width, channels, data).
    """
    counts = frames.groupBy("video").agg((F.max("frame_index") + 1).alias("frame_count"))
    wanted = even_sample(counts, sample_count, fewest)
    return of_samples(frames.join(wanted, ["video", "frame_index"], "left_semi"), counts, min_confidence)


def of_samples(picked: DataFrame, videos: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """detected() of the sampled frames of each video; a row for each of `videos`.

    A task holds the sampled frames of one video. What can't be read is a video without overlays: this is a warning, no gate.
    """
    names = [c.split()[0] for c in REGION.split(", ")]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame_index")
        try:
            stack = [kernels.grey(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)[..., : 3 if r.channels >= 3 else 1].squeeze()) for r in part.itertuples()]
            found = kernels.static_regions(stack)
        except (ValueError, TypeError):
            found = []
        rows = [{"frame_w": stack[0].shape[1], "frame_h": stack[0].shape[0], "place": k, **r} for k, r in enumerate(found)]
        return pd.DataFrame(rows, columns=names).assign(video=part["video"].iloc[0])[["video", *names]]

    regions = picked.groupBy("video").applyInPandas(run, f"video {picked.schema['video'].dataType.simpleString()}, {REGION}")
    boxes = confident(regions, "video", "place", min_confidence=min_confidence)
    box = F.struct("rank", "x", "y", "w", "h", "confidence", "location")
    found = boxes.groupBy("video").agg(F.transform(F.array_sort(F.collect_list(box)), lambda b: b.dropFields("rank")).alias("watermarks"))
    every = videos.select("video").join(found, "video", "left")
    return every.select("video", F.coalesce("watermarks", F.array().cast(BOX)).alias("watermarks"))
