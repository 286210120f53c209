"""A decoder for tests: a path such as 'clip_3.mp4' is a video of seeded frames."""

import os

import numpy as np


def image(video: str, index: int) -> np.ndarray:
    rng = np.random.default_rng([sum(video.encode()), index // 2])  # frames come in equal pairs
    small = rng.integers(0, 255, (12, 16, 3), dtype=np.uint8)
    out = np.kron(small, np.ones((6, 6, 1), np.uint8))
    if index % 10 == 9:
        out[:] = 128
    return out


def decode(path: str, lo: int | None, hi: int | None):
    for i in range(0 if lo is None else max(0, lo), 20 if hi is None else min(20, hi + 1)):
        yield i, i / 10, image(path, i)


def log(path: str, index: int) -> None:
    """Remember that a frame was decoded, where a test asks for it."""
    if folder := os.environ.get("FRAMES_LOG"):
        with open(os.path.join(folder, "log"), "a") as f:
            f.write(f"{path}\t{index}\n")


LENGTH = 120


def scene_image(index: int) -> np.ndarray:
    """Three scenes of 40 frames, each of a ground of its own with a little that moves."""
    out = np.kron(np.random.default_rng(index // 40).integers(0, 255, (12, 16, 3), dtype=np.uint8), np.ones((6, 6, 1), np.uint8))
    out[(index % 40) : (index % 40) + 6, 10:40] = 200
    return out


def scenes(path: str, lo: int | None, hi: int | None, wanted=None, step: int = 1):
    last = LENGTH - 1 if hi is None else min(hi, LENGTH - 1)
    for i in range(lo or 0, last + 1):
        if wanted is not None and i not in wanted or wanted is None and i % step and i != last:
            continue
        log(path, i)
        yield i, i / 10, scene_image(i)


def able(path: str, lo: int | None, hi: int | None, wanted=None, step: int = 1):
    yield from scenes(path, lo, hi, wanted, step)


able.probe = lambda path: (10.0, LENGTH, 96, 72)


def streaming(path: str, lo: int | None, hi: int | None):
    yield from scenes(path, lo, hi)


streaming.keyframes = lambda path, most: ((i, i / 10, scene_image(i)) for i in range(0, LENGTH, 12)[:most])
