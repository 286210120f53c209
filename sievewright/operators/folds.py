"""Order-dependent filters: a frame is compared with the last ones that were accepted, not with the last ones seen.

Rows are dealt by video, sorted, and read once; a task holds the vectors of the last accepted frames of
one video, whatever the video's length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.vectors import C1, C2


class Filter(Protocol):
    """Names its rejections; knows whether a vector passes, and remembers those that the caller accepts."""

    name: str

    def passes(self, vector: np.ndarray) -> bool: ...
    def accept(self, vector: np.ndarray) -> None: ...
    def reset(self) -> None: ...


class _Recent:
    def __init__(self, most: int | None):
        self.kept: deque[np.ndarray] = deque(maxlen=most)

    def accept(self, vector: np.ndarray) -> None:
        self.kept.append(vector)

    def reset(self) -> None:
        self.kept.clear()


def ssim_to_all(vector: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Structural similarity of a vector to each row, by moments; one product of a matrix and a vector."""
    n = vector.shape[-1]
    mean, means = vector.mean(), others.mean(1)
    var, vars_ = vector @ vector / n - mean * mean, (others * others).sum(1) / n - means * means
    cov = others @ vector / n - mean * means
    return ((2 * mean * means + C1) * (2 * cov + C2)) / ((mean * mean + means * means + C1) * (var + vars_ + C2))


class Diverse(_Recent):
    """Passes if no accepted vector is more similar than the threshold."""

    name = "ssim"

    def __init__(self, threshold: float = 0.85, most: int | None = 20):
        super().__init__(most)
        self.threshold = threshold

    def passes(self, vector: np.ndarray) -> bool:
        return not self.kept or bool((ssim_to_all(vector, np.array(self.kept)) <= self.threshold).all())


class Colourful(_Recent):
    """Passes if no accepted histogram is nearer than the distance, by chi squared."""

    name = "color"

    def __init__(self, distance: float = 0.08, most: int | None = 15):
        super().__init__(most)
        self.distance = distance

    def passes(self, vector: np.ndarray) -> bool:
        if not self.kept:
            return True
        others = np.array(self.kept)
        total = others + vector
        gaps = np.divide((others - vector) ** 2, total, out=np.zeros_like(total), where=total > 0).sum(1)
        return bool((gaps >= self.distance).all())


class Unseen:
    """Passes if no accepted hash (a uint64) is within the distance.

    It remembers all of a video's accepted hashes, as whatever was kept rules out what is near it: eight bytes each, in
    one array that doubles when it is full.
    """

    name = "dup"

    def __init__(self, distance: int = 5):
        self.distance = distance
        self.reset()

    def reset(self) -> None:
        self.held, self.n = np.zeros(64, np.uint64), 0

    def passes(self, vector: np.ndarray) -> bool:
        return bool((np.bitwise_count(self.held[: self.n] ^ vector) > self.distance).all())

    def accept(self, vector: np.ndarray) -> None:
        if self.n == len(self.held):
            self.held = np.concatenate((self.held, np.zeros_like(self.held)))
        self.held[self.n] = vector
        self.n += 1


def fold(rows: DataFrame, filters: dict[str, Filter], video: str = "video", index: str = "idx", most: int | None = None) -> DataFrame:
    """(video, index, reason): an empty reason is an accepted frame, else the first filter that refused it, or 'max' after `most`.

    filters: column -> filter, in order. A frame enters the filters' memories only if all of them pass it.
    Vectors are arrays of doubles; a long is a hash. Nulls in a vector's column pass, and aren't remembered.
    """
    names = list(filters)
    keys = [video, index]
    schema = f"{video} {rows.schema[video].dataType.simpleString()}, {index} {rows.schema[index].dataType.simpleString()}, reason string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, accepted = object(), 0
        for batch in batches:
            columns = [_vectors(batch.column(n)) for n in names]
            reasons = []
            for row, v in enumerate(batch.column(video).to_pylist()):
                if v != now:
                    now, accepted = v, 0
                    for f in filters.values():
                        f.reset()
                vectors = [c[row] for c in columns]
                reason = "max" if most is not None and accepted >= most else ""
                if not reason:
                    reason = next((f.name for f, x in zip(filters.values(), vectors, strict=True) if x is not None and not f.passes(x)), "")
                if not reason:
                    accepted += 1
                    for f, x in zip(filters.values(), vectors, strict=True):
                        if x is not None:
                            f.accept(x)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([batch.column(video), batch.column(index), pa.array(reasons, pa.string())], [*keys, "reason"])

    ordered = rows.select(*keys, *names).repartition(video).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, schema)


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    if pa.types.is_integer(column.type):
        return [None if x is None else np.uint64(x & (2**64 - 1)) for x in column.to_pylist()]
    return [None if x is None else np.array(x, float) for x in column.to_pylist()]
