"""Frames of videos, with a decoder that is plugged in by name.

A decoder is a function `decode(path, lo, hi)` that gives (frame_index, t, image array) in order for the
frames lo..hi (None: no bound). What more it can do is seen from its parameters and attributes:

- a parameter `wanted`, a sorted list of frame indices: it decodes these only,
- a parameter `step`: it gives every step-th frame only, beside the last one,
- a parameter `accurate`: whether it seeks to the frame itself or to a near one,
- `decode.probe(path)` -> (fps, frame_count, width, height), without decoding,
- `decode.keyframes(path, most)` -> the first `most` key frames, as (frame_index, t, image).

For a decoder that can't, what isn't wanted is dropped as it comes. `sievewright.sources.ffmpeg:decode` can all of it, where
the program is installed.

    spark.dataSource.register(FrameSource)
    spark.read.format("frames").option("paths", "a.mp4\\nb.mp4").option("decoder", "module:function").load()

The options `from` and `to` bound frame_index, both ends included, and save the decoder what lies outside.
"""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import kernels

SCHEMA = "video string, frame_index long, t double, height int, width int, channels int, data binary"
SCAN = "video string, frame_index long, t double, height int, width int, delta double"
_ARROW = pa.schema([("video", pa.string()), ("frame_index", pa.int64()), ("t", pa.float64()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])
_SCAN_ARROW = pa.schema([*list(_ARROW)[:5], ("delta", pa.float64())])


def named(what: str) -> Callable:
    """The function that 'module:function' names."""
    module, _, name = what.partition(":")
    return getattr(importlib.import_module(module), name)


def frames_of(decode: Callable, path: str, lo: int | None = None, hi: int | None = None, wanted: list[int] | None = None, step: int = 1, accurate: bool = True) -> Iterator[tuple[int, float, np.ndarray]]:
    """The frames of one video within the bounds; the wanted ones, or every step-th one and the last."""
    able = inspect.signature(decode).parameters
    extra = {n: v for n, v in (("wanted", wanted), ("step", step), ("accurate", accurate)) if n in able and not (n == "wanted" and v is None)}
    if wanted is not None:
        if not wanted:
            return
        lo, hi = max(wanted[0], lo or 0), wanted[-1] if hi is None else min(wanted[-1], hi)
        chosen = set(wanted)
    held = None
    for index, t, image in decode(path, lo, hi, **extra):
        if lo is not None and index < lo or hi is not None and index > hi:
            continue
        if wanted is not None and index not in chosen or index % step:
            held = (int(index), float(t), image) if wanted is None else None
        else:
            held = None
            yield int(index), float(t), image
    if held:
        yield held  # the last one tells where the video ends


def _row(path: str, index: int, t: float, image: np.ndarray) -> tuple:
    h, w = image.shape[:2]
    return path, index, t, h, w, image.shape[2] if image.ndim == 3 else 1, image.tobytes()


class _Video(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    """A partition for each video.

    Bounds come as options, which belong to one reader; Spark keeps a reader's pushed filters for
    every later query of the same relation, so a filter pushed by one would narrow the others.
    """

    def __init__(self, paths: list[str], decoder: str, lo: int | None, hi: int | None):
        self.paths, self.decoder, self.lo, self.hi = paths, decoder, lo, hi

    def partitions(self) -> list[InputPartition]:
        return [_Video(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for frame in frames_of(named(self.decoder), partition.value, self.lo, self.hi):
            yield _row(partition.value, *frame)


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if "decoder" not in self.options:
            raise ValueError("the option decoder names a function, as module:function")
        bound = lambda name: int(self.options[name]) if name in self.options else None
        return _Reader([p for p in self.options.get("paths", "").split("\n") if p], self.options["decoder"], bound("from"), bound("to"))


def decoded(picks: DataFrame, decoder: str, accurate: bool = True, tasks: int | None = None) -> DataFrame:
    """(video, frame_index) -> the frames, as FrameSource gives them. A video is one task's, and only what is picked of it is decoded.

    `tasks`: how many videos are decoded at a time, at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = named(decoder)
        for batch in batches:
            for path, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for frame in frames_of(decode, path, wanted=wanted, accurate=accurate):
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(_row(path, *frame), _ARROW, strict=True)], schema=_ARROW)

    wanted = picks.select("video", "frame_index").groupBy("video").agg(F.sort_array(F.collect_set("frame_index")).alias("wanted"))
    return (wanted.repartition(tasks, "video") if tasks else wanted).mapInArrow(run, SCHEMA)


def probed(videos: DataFrame, decoder: str) -> DataFrame:
    """(video, fps, frame_count, width, height, duration_s); a decoder without probe() has to go through the video, and its pixels go nowhere."""

    def one(decode: Callable, path: str) -> tuple:
        if hasattr(decode, "probe"):
            fps, n, w, h = decode.probe(path)
        else:
            first = last = None
            for last in ((i, t, image.shape) for i, t, image in frames_of(decode, path, step=1 << 30)):
                first = first or last
            if last is None:
                return path, 0.0, 0, 0, 0, 0.0
            span = last[1] - first[1]
            fps, n, (h, w) = ((last[0] - first[0]) / span if span > 0 else 0.0), last[0] + 1, last[2][:2]
        return path, float(fps), int(n), int(w), int(h), n / fps if fps > 0 else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = named(decoder)
        kinds = [pa.string(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(one(decode, path), kinds, strict=True)], ["video", "fps", "frame_count", "width", "height", "duration_s"])

    return videos.select("video").repartition("video").mapInArrow(run, "video string, fps double, frame_count long, width int, height int, duration_s double")


def scanned(videos: DataFrame, decoder: str, skip: int = 4) -> DataFrame:
    """(video, frame_index, t, height, width, delta) of every (skip + 1)-th frame, and of the last: how much its content
    differs from that of the one before it. Pixels stay in the task, two small frames at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = named(decoder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, before = [], None
                for index, t, image in frames_of(decode, path, step=skip + 1):
                    small = kernels.small_hsv(image)
                    delta = kernels.content_delta(before, small) if before is not None and before.shape == small.shape else None
                    rows.append((path, index, t, *image.shape[:2], delta))
                    before = small
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCAN_ARROW, strict=True)], schema=_SCAN_ARROW)

    return videos.select("video").repartition("video").mapInArrow(run, SCAN)


def keyframes(videos: DataFrame, decoder: str, most: int = 200) -> DataFrame:
    """The first `most` key frames of each video, from a decoder that can stream them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = named(decoder).keyframes
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for frame in stream(path, most):
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(_row(path, *frame), _ARROW, strict=True)], schema=_ARROW)

    return videos.select("video").repartition("video").mapInArrow(run, SCHEMA)
