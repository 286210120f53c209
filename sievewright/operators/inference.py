"""Running a tagger over images: the model is made once in each worker by a function of the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import kernels


def probabilities(images: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], image: str = "path", batch_size: int = 8, side: int = 448) -> DataFrame:
    """(image, probs array<float>, error string) of images (path, height, width, channels, data).

    make_model gives a function from a batch of float pixels to a batch of scores. A batch that fails is
    halved until its one bad image is alone, which then has the error.
    """
    schema = pa.schema([("image", pa.string()), ("probs", pa.list_(pa.float32())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()

        def scored(part: list[tuple[str, np.ndarray]]) -> list[dict]:
            try:
                scores = model(np.stack([x for _, x in part]))
                return [{"image": n, "probs": np.asarray(s, np.float32), "error": None} for (n, _), s in zip(part, scores, strict=True)]
            except Exception as e:  # noqa: BLE001  whatever a model raises belongs to its images
                if len(part) == 1:
                    return [{"image": part[0][0], "probs": None, "error": f"{type(e).__name__}: {e}"}]
                half = len(part) // 2
                return scored(part[:half]) + scored(part[half:])

        for batch in batches:
            for k in range(0, batch.num_rows, batch_size):
                good, bad = [], []
                for r in batch.slice(k, batch_size).to_pylist():
                    try:
                        pixels = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])
                        good.append((r["image"], kernels.tagger_input(pixels if r["channels"] > 1 else pixels[..., 0], side)))
                    except (ValueError, TypeError) as e:
                        bad.append({"image": r["image"], "probs": None, "error": f"{type(e).__name__}: {e}"})
                yield pa.RecordBatch.from_pylist((scored(good) if good else []) + bad, schema)

    picked = images.select(images[image].alias("image"), "height", "width", "channels", "data")
    return picked.mapInArrow(run, "image string, probs array<float>, error string")
