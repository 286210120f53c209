"""Sizes: the bucket grid, the bucket of a size, resizing, cropping around static overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bucket_sizes(resolution: int = 1024, min_bucket: int = 512, max_bucket: int = 2048, step: int = 64) -> list[tuple[int, int]]:
    """Widths and heights that are multiples of the step, in bounds, with no more pixels than the resolution's square."""
    for name, value in (("resolution", resolution), ("min_bucket", min_bucket), ("max_bucket", max_bucket)):
        if value % step:
            raise ValueError(f"{name} {value} is not a multiple of step {step}")
    if min_bucket > max_bucket:
        raise ValueError("min_bucket is over max_bucket")
    sides = range(min_bucket, max_bucket + 1, step)
    return [(w, h) for w in sides for h in sides if w * h <= resolution * resolution]


def bucket_grid(spark: SparkSession, **bounds: int) -> DataFrame:
    """(bucket_w, bucket_h): a fixed grid, some hundred rows for usual bounds."""
    return spark.createDataFrame(bucket_sizes(**bounds), "bucket_w long, bucket_h long")


def nearest_bucket(w: Column, h: Column, buckets: list[tuple[int, int]]) -> Column:
    """Struct (bucket_w, bucket_h) of nearest aspect; of equally near ones the largest, then the smallest width."""
    grid = F.array(*(F.struct(F.lit(a).cast("long").alias("w"), F.lit(b).cast("long").alias("h")) for a, b in buckets))
    best = F.array_min(F.transform(grid, lambda g: F.struct(F.abs(g["w"] / g["h"] - w / h).alias("gap"), (-g["w"] * g["h"]).alias("less"), g["w"].alias("bucket_w"), g["h"].alias("bucket_h"))))
    return F.struct(best["bucket_w"].alias("bucket_w"), best["bucket_h"].alias("bucket_h"))


def with_bucket(sizes: DataFrame, buckets: list[tuple[int, int]], w: str = "w", h: str = "h", keep_all: bool = False) -> DataFrame:
    """Each row of a positive size with its bucket's bucket_w and bucket_h; with `keep_all` other rows too, without a bucket.

    The grid is a literal that each distinct size goes through once; rows then find theirs by an equality join.
    """
    distinct = sizes.select(F.col(w).alias("_w"), F.col(h).alias("_h")).where("_w > 0 and _h > 0").distinct()
    found = distinct.select("_w", "_h", nearest_bucket(F.col("_w"), F.col("_h"), buckets).alias("_b")).select("_w", "_h", "_b.bucket_w", "_b.bucket_h")
    return sizes.join(found, (F.col(w) == F.col("_w")) & (F.col(h) == F.col("_h")), "left" if keep_all else "inner").drop("_w", "_h")


def enough_pixels(bucketed: DataFrame, min_pixels: int = 500_000) -> DataFrame:
    """Rows whose bucket, not whose source, has the pixels."""
    return bucketed.where(F.col("bucket_w") * F.col("bucket_h") >= min_pixels)


def _whole(c: Column) -> Column:
    return F.rint(c).cast("long")


def cover(w: Column, h: Column, bw: Column, bh: Column) -> dict[str, Column]:
    """Scale so that the bucket is covered, then crop the middle; `shrinks` tells which filter a resampler takes."""
    wide = w / h > bw / bh
    new_w = F.when(wide, _whole(bh * (w / h))).otherwise(bw.cast("long"))
    new_h = F.when(wide, bh.cast("long")).otherwise(_whole(bw / (w / h)))
    return {"new_w": new_w, "new_h": new_h, "x": F.floor((new_w - bw) / 2), "y": F.floor((new_h - bh) / 2), "shrinks": (new_w < w) | (new_h < h)}


def contain(w: Column, h: Column, bw: Column, bh: Column) -> dict[str, Column]:
    """Scale to fit into the bucket, and put it in the middle."""
    scale = F.least(bw / w, bh / h)
    one = F.lit(1).cast("long")
    new_w, new_h = F.greatest(one, _whole(w * scale)), F.greatest(one, _whole(h * scale))
    return {"new_w": new_w, "new_h": new_h, "x": F.floor((bw - new_w) / 2), "y": F.floor((bh - new_h) / 2)}


def longest(w: Column, h: Column, target: int) -> dict[str, Column]:
    """Scale the longer edge to the target; sizes that have it stay."""
    scale = F.lit(float(target)) / F.greatest(w, h)
    one = F.lit(1).cast("long")
    same = F.greatest(w, h) == target
    return {"new_w": F.when(same, w).otherwise(F.greatest(one, _whole(w * scale))).cast("long"), "new_h": F.when(same, h).otherwise(F.greatest(one, _whole(h * scale))).cast("long")}


def crop_around(x: Column, y: Column, w: Column, h: Column, overlays: Column, only_peripheral: bool = True) -> Column:
    """Struct (x, y, w, h) of a crop without the overlays, an array of structs (x, y, w, h).

    An overlay whose centre is in the outer fifth cuts a side in each direction, two pixels beyond
    its edge; others stay. Sides are one pixel at least.
    """
    zero = F.struct(x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))

    def step(acc: Column, o: Column) -> Column:
        cx, cy = o["x"] + o["w"] / 2, o["y"] + o["h"] / 2
        outer = (cx < w * 0.2) | (cx > w - w * 0.2) | (cy < h * 0.2) | (cy > h - h * 0.2)
        cut = outer if only_peripheral else F.lit(True)
        top, left = o["y"] < h * 0.5, o["x"] < w * 0.5
        return F.struct(
            F.when(cut & left, F.greatest(acc["x0"], o["x"] + o["w"] + 2)).otherwise(acc["x0"]).alias("x0"),
            F.when(cut & top, F.greatest(acc["y0"], o["y"] + o["h"] + 2)).otherwise(acc["y0"]).alias("y0"),
            F.when(cut & ~left, F.least(acc["x1"], o["x"] - 2)).otherwise(acc["x1"]).alias("x1"),
            F.when(cut & ~top, F.least(acc["y1"], o["y"] - 2)).otherwise(acc["y1"]).alias("y1"),
        )

    one = F.lit(1).cast("long")
    end = lambda a: F.struct(a["x0"].alias("x"), a["y0"].alias("y"), F.greatest(one, a["x1"] - a["x0"]).alias("w"), F.greatest(one, a["y1"] - a["y0"]).alias("h"))
    return F.aggregate(overlays, zero, step, end)


def position(x: Column, y: Column, w: Column, h: Column, frame_w: Column, frame_h: Column) -> Column:
    """One of nine places, such as top-left, by the centre; the middle is from 35 to 65 percent."""
    cx, cy = x + w / 2, y + h / 2
    across = F.when(cx < frame_w * 0.35, "left").when(cx > frame_w * 0.65, "right").otherwise("center")
    down = F.when(cy < frame_h * 0.35, "top").when(cy > frame_h * 0.65, "bottom").otherwise("middle")
    return F.concat(down, F.lit("-"), across)


def overlay_confidence(edge_density: Column, w: Column, h: Column, bimodal: Column) -> Column:
    """How likely a static box is text or a logo, 0 to 1."""
    aspect = F.least(F.lit(1.0), w / F.greatest(F.lit(1.0), h * 1.5))
    return F.least(F.lit(1.0), edge_density * 6.0) * aspect * F.least(F.lit(1.0), bimodal * 1.5)


def overlay_gate(x: Column, y: Column, w: Column, h: Column, frame_w: Column, frame_h: Column, edge_density: Column, static_density: Column, bimodal: Column) -> Column:
    """Whether a static box can be an overlay: small but not tiny, near an edge, textured, and of two tones."""
    cx, cy, area = x + w / 2, y + h / 2, w * h
    near = (cy < frame_h * 0.12) | (cy > frame_h - frame_h * 0.12) | (cx < frame_w * 0.12) | (cx > frame_w - frame_w * 0.12)
    sized = (area >= 800) & (area <= frame_w * frame_h * 0.04) & (w >= 30) & (h >= 10)
    return sized & near & (edge_density >= 0.02) & (edge_density <= 0.40) & (static_density >= 0.01) & (bimodal >= 0.45)
