"""A decoder that reads raw frames from the ffmpeg program's pipe, where it is installed on the executors.

Frame numbers and times follow from the frame rate, which the program's own description of the file tells.
"""

from __future__ import annotations

import re
import shutil
import subprocess
from collections.abc import Iterator

import numpy as np

Frame = tuple[int, float, np.ndarray]


def program() -> str:
    found = shutil.which("ffmpeg")
    if not found:
        raise FileNotFoundError("ffmpeg is not installed here; name a decoder of your own")
    return found


def probe(path: str) -> tuple[float, int, int, int]:
    """(fps, frame_count, width, height); zeros for what the program doesn't tell."""
    said = subprocess.run([program(), "-hide_banner", "-i", path], capture_output=True, text=True, errors="replace", timeout=60).stderr
    stream = next((line for line in said.splitlines() if "Video:" in line), "")
    size = re.search(r"(\d{2,5})x(\d{2,5})", stream)
    rate = re.search(r"([\d.]+)\s*fps", stream)
    length = re.search(r"Duration:\s*(\d+):(\d+):([\d.]+)", said)
    fps = float(rate[1]) if rate else 0.0
    seconds = int(length[1]) * 3600 + int(length[2]) * 60 + float(length[3]) if length else 0.0
    return fps, int(seconds * fps + 0.5), *(int(size[k]) if size else 0 for k in (1, 2))


def _raw(before: list[str], path: str, after: list[str], width: int, height: int) -> Iterator[np.ndarray]:
    command = [program(), "-hide_banner", "-loglevel", "error", *before, "-i", path, *after, "-an", "-f", "rawvideo", "-pix_fmt", "bgr24", "-"]
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
        try:
            while len(data := run.stdout.read(width * height * 3)) == width * height * 3:
                yield np.frombuffer(data, np.uint8).reshape(height, width, 3)
        finally:
            run.kill()


def decode(path: str, lo: int | None, hi: int | None, wanted: list[int] | None = None, step: int = 1, accurate: bool = True) -> Iterator[Frame]:
    """Frames lo..hi, of these the wanted or every step-th ones and the last.

    A few wanted frames of a long video are sought one by one, if need be to the nearest key frame only.
    """
    fps, n, width, height = probe(path)
    if not (fps > 0 and width):
        raise OSError(f"{path} can't be read")
    if wanted is not None and len(wanted) * 20 < (hi if hi is not None else n) - (lo or 0):
        for i in wanted:
            seek = ["-ss", f"{i / fps:.3f}", *([] if accurate else ["-noaccurate_seek"])]
            for image in _raw(seek, path, ["-frames:v", "1"], width, height):
                yield i, i / fps, image
        return
    first, chosen, last = lo or 0, set(wanted or ()), None
    for i, image in enumerate(_raw(["-ss", f"{first / fps:.3f}"] if first else [], path, ["-frames:v", str(hi - first + 1)] if hi is not None else [], width, height), first):
        last = i, i / fps, image
        if i in chosen if wanted is not None else i % step == 0:
            yield last
            last = None
    if last and wanted is None:
        yield last


def keyframes(path: str, most: int) -> Iterator[Frame]:
    """The first `most` key frames, with the times that the program shows for them."""
    fps, _, width, height = probe(path)
    if not (fps > 0 and width):
        raise OSError(f"{path} can't be read")
    shown = subprocess.run([program(), "-hide_banner", "-skip_frame", "nokey", "-i", path, "-vf", "showinfo", "-vsync", "vfr", "-an", "-frames:v", str(most), "-f", "null", "-"], capture_output=True, text=True, errors="replace").stderr
    times = [float(t) for t in re.findall(r"pts_time:\s*([\d.]+)", shown)]
    for t, image in zip(times, _raw(["-skip_frame", "nokey"], path, ["-vsync", "vfr", "-frames:v", str(most)], width, height), strict=False):
        yield int(t * fps + 0.5), t, image


decode.probe, decode.keyframes = probe, keyframes
