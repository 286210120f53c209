"""Aggregates that reports show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name


def bucket_histogram(bucketed: DataFrame) -> DataFrame:
    """(bucket, n), such as 1024x768."""
    return bucketed.groupBy(F.concat_ws("x", "bucket_w", "bucket_h").alias("bucket")).agg(F.count("*").alias("n"))


def histogram(frames: DataFrame, score: str = "blur", bins: int = 12) -> DataFrame:
    """(bin, low, high, n) of equal bins from the least to the largest score; the last is closed, and empty ones are there.

    If all scores are equal there is one bin, from the score to itself; without scores there is none.
    """
    ends = frames.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).where("lo is not null")
    width = (F.col("hi") - F.col("lo")) / bins
    edges = ends.select("lo", "hi", F.explode(F.when(F.col("hi") > F.col("lo"), F.sequence(F.lit(0), F.lit(bins - 1))).otherwise(F.array(F.lit(0)))).alias("bin"))
    one = ends.first()
    if one is None:
        return edges.select("bin", F.col("lo").alias("low"), F.col("hi").alias("high"), F.lit(0).cast("long").alias("n"))
    lo, hi = float(one.lo), float(one.hi)
    place = F.least(F.lit(bins - 1), F.floor((F.col(score) - lo) / (hi - lo) * bins).cast("int")) if hi > lo else F.lit(0)
    counts = frames.where(F.col(score).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("_n"))
    high = F.when(F.col("hi") > F.col("lo"), F.col("lo") + width * (F.col("bin") + 1)).otherwise(F.col("hi"))
    return edges.join(counts, "bin", "left").select("bin", (F.col("lo") + width * F.col("bin")).alias("low"), high.alias("high"), F.coalesce("_n", F.lit(0)).alias("n"))


def acceptance(written: Column, candidates: Column) -> Column:
    """Percent of the candidates that were written."""
    return written * 100.0 / F.greatest(F.lit(1), candidates)


def overlay_rows(videos: DataFrame, video: str = "video", overlays: str = "watermarks") -> DataFrame:
    """A row for each suspected overlay of the videos that have any."""
    return videos.select(video, F.explode(overlays).alias("_o")).select(video, "_o.*")


def sheet_cells(images: DataFrame, order: str, columns: int = 8, thumb: int = 192, border: int = 2, most: int = 200) -> DataFrame:
    """With `row`, `col`, `left`, `top`: places of the first images, in `order`, on a contact sheet."""
    from pyspark.sql import Window

    first = images.orderBy(order).limit(most)
    place = F.row_number().over(Window.orderBy(order)) - 1  # over the few rows of a sheet
    cell = thumb + 2 * border
    out = first.withColumn("_at", place)
    return out.withColumns({"row": F.floor(F.col("_at") / columns), "col": F.col("_at") % columns}).withColumns({"left": F.col("col") * cell + border, "top": F.col("row") * cell + border}).drop("_at")


def bar(label: Column, value: Column, total: Column, width: int = 40) -> Column:
    """A text bar: filled and empty blocks, the value, and its percentage."""
    filled = F.rint(value * width / F.greatest(F.lit(1), total)).cast("int")
    full = F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), width - filled))
    return F.when(total <= 0, F.concat(label, F.lit(": "), value.cast("string"))).otherwise(F.concat_ws(" ", label, full, value.cast("string"), F.format_string("(%.1f%%)", value * 100.0 / total)))


def hover_lines(blur: Column, bucket: Column, index: Column, source: Column, tags: Column, shown: int = 8) -> Column:
    """What a gallery says of an image, a line for each thing known; of the tags the first few."""
    few = F.array_join(F.slice(tags, 1, shown), ", ")
    listed = F.when(F.size(tags) > shown, F.concat(few, F.lit(" …"))).when(F.size(tags) > 0, few)
    return F.concat_ws("\n", F.when(blur.isNotNull(), F.format_string("blur %.1f", blur)), F.concat(F.lit("bucket "), bucket), F.concat(F.lit("frame #"), index.cast("string")), F.concat(F.lit("src: "), source), F.concat(F.lit("tags: "), listed))


def gallery_rows(images: DataFrame, records: DataFrame, tags: DataFrame | None = None, rejected: DataFrame | None = None) -> DataFrame:
    """(path, hover): the images that weren't rejected, each with what is known of it, even if that is nothing.

    records: path, blur, bucket_w, bucket_h, frame_index, video. tags: path, tokens (an array). rejected: path.
    """
    shown = images.select("path").join(rejected.select("path"), "path", "left_anti") if rejected is not None else images.select("path")
    known = shown.join(records.select("path", "blur", F.concat_ws("x", "bucket_w", "bucket_h").alias("bucket"), "frame_index", "video"), "path", "left")
    with_tags = known.join(tags.select("path", "tokens"), "path", "left") if tags is not None else known.withColumn("tokens", F.lit(None).cast("array<string>"))
    bucket = F.when(F.col("bucket") != "", F.col("bucket"))
    return with_tags.select("path", hover_lines(F.col("blur"), bucket, F.col("frame_index"), file_name(F.col("video")), F.col("tokens")).alias("hover"))


def console(stats: DataFrame, rows: int = 50) -> None:
    """Print the numbers of the first videos."""
    stats.orderBy("video").show(rows, truncate=60)
