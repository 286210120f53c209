"""Which accepted frames are kept: caps, reserves, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.storage import written


def capped(accepted: DataFrame, most: int, video: str = "video", index: str = "frame_index") -> DataFrame:
    """The first `most` of each video."""
    order = Window.partitionBy(video).orderBy(index)
    return accepted.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= most).drop("_row")


def reserve_size(min_per_video: int) -> int:
    return max(3 * min_per_video, 5) if min_per_video > 0 else 0


def reserve(gated: DataFrame, size: int, video: str = "video", index: str = "frame_index", score: str = "blur") -> DataFrame:
    """The `size` sharpest frames of each video; of equally sharp ones the earliest."""
    order = Window.partitionBy(video).orderBy(F.col(score).desc(), index)
    return gated.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= size).drop("_row")


def backfilled(gated: DataFrame, accepted: DataFrame, min_per_video: int, max_per_video: int | None = None, video: str = "video", index: str = "frame_index", score: str = "blur") -> DataFrame:
    """Accepted frames and, for videos with fewer than the minimum, the sharpest of the reserve that weren't accepted.

    gated: frames that passed the quality gates. Adds the column `backfilled`.
    """
    goal = min(min_per_video, max_per_video) if max_per_video else min_per_video
    columns = [video, index, score]
    pool = reserve(gated, reserve_size(min_per_video), video, index, score)
    left = pool.join(accepted.select(F.col(video).alias("_v"), F.col(index).alias("_i")), (F.col(video) == F.col("_v")) & (F.col(index) == F.col("_i")), "left_anti")
    have = accepted.groupBy(F.col(video).alias("_v")).agg(F.count("*").alias("_have"))
    order = Window.partitionBy(video).orderBy(F.col(score).desc(), index)
    ranked = left.select(*columns, F.row_number().over(order).alias("_row")).join(have, F.col(video) == F.col("_v"), "left")
    added = ranked.where(F.col("_row") <= goal - F.coalesce("_have", F.lit(0))).select(*columns, F.lit(True).alias("backfilled"))
    return accepted.select(*columns, F.lit(False).alias("backfilled")).unionByName(added)


def places(rows: DataFrame, *order: str) -> DataFrame:
    """`rows`, whose columns `order` tell them apart, with `place`: 0, 1, 2, ... in this order, without a task that holds them all.

    Ranges of rows are numbered each by itself; a small sum of the ranges' sizes tells where each begins.
    """
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(before, "_part").withColumn("place", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def sequence_numbers(kept: DataFrame, video_order: str, video: str = "video", index: str = "frame_index", offset: int = 100_000) -> DataFrame:
    """With `in_video`, a frame's place among its video's from one, and `seq`, the same after an offset for each video.

    video_order: column with a video's place, from zero. A video of more frames than the offset reaches into the next one's
    numbers: names are made of `in_video`.
    """
    order = Window.partitionBy(video).orderBy(index)
    numbered = kept.withColumn("in_video", F.row_number().over(order).cast("long"))
    return numbered.withColumn("seq", (F.col(video_order) * offset + F.col("in_video")).cast("long"))


def output_name(stem: Column, seq: Column, extension: str) -> Column:
    return F.format_string(f"%s_%05d.{extension}", stem, seq)


def folder(stem: Column, flatten: Column, repeats: Column, trigger: Column) -> Column:
    """Where a video's images go: all together (an empty name), in a folder for repeats, or in one of their own."""
    clean = text.collapse(trigger)
    name = F.when(clean == "", "dataset").otherwise(text.sanitize_stem(clean))
    return F.when(flatten & (repeats > 0), F.concat(repeats.cast("string"), F.lit("_"), name)).when(flatten, "").otherwise(stem)
