"""Which frames are candidates, and that only these are decoded."""

import json
import os
import stat

import numpy as np
import pytest

import frames_for_tests
from sievewright import cli
from sievewright.config import Config
from sievewright.plans import candidates
from sievewright.sources import ffmpeg, video

SIZES = ("resolution=256", "min_bucket=64", "max_bucket=256", "min_pixels=1000", "min_per_video=0", "ssim_filter=false", "color_diversity=false", "dedup=false", "blur_threshold=0", "detect_watermark=false")


@pytest.fixture
def videos(spark):
    return spark.createDataFrame([("/v/a.mp4",), ("/v/b.mp4",)], "video string")


def indices(found):
    out = {}
    for r in found.frames.select("video", "frame_index").collect():
        out.setdefault(r.video, []).append(r.frame_index)
    return {k: sorted(v) for k, v in out.items()}


def both(expected):
    return {"/v/a.mp4": expected, "/v/b.mp4": expected}


def by_hand(count):
    """Evenly spaced frames of scenes 0..40, 40..80, 80..120, a margin of a tenth away from their ends."""
    return sorted({int(np.rint(s + 4 + i * 32 / (count - 1))) for s in (0, 40, 80) for i in range(count)})


def test_scenes(videos):
    got = candidates.candidates(videos, "frames_for_tests:scenes", Config(sampling="scene", frames_per_scene=3))
    assert indices(got) == both(by_hand(3))
    assert [(r.frame_count, round(r.fps)) for r in got.meta.collect()] == [(120, 10)] * 2


def test_hybrid_takes_more_of_long_scenes(videos):
    got = candidates.candidates(videos, "frames_for_tests:scenes", Config(sampling="hybrid", frames_per_scene=2, interval_seconds=0.9))
    assert indices(got) == both(by_hand(4))  # four seconds a scene


def test_short_scenes_are_none(videos, spark):
    from sievewright.operators import sampling

    rows = [("v", i, i / 10, 99.0 if i in (5, 20, 25, 40) else 0.0) for i in range(0, 60, 5)]
    got = sampling.scenes(spark.createDataFrame(rows, "video string, frame_index long, t double, delta double"), 27.0, delta="delta", least=15)
    assert sorted((r.start_frame, r.end_frame) for r in got.collect()) == [(0, 20), (20, 40), (40, 56)]


def test_intervals_and_segments(videos):
    config = Config(sampling="interval", interval_seconds=1.0)
    assert indices(candidates.candidates(videos, "frames_for_tests:able", config)) == both(list(range(0, 120, 10)))
    config = Config(sampling="interval", interval_seconds=1.0, segments={"a.mp4": [[2.0, 3.0], [11.0, 99.0]]})  # as TOML has them
    assert indices(candidates.candidates(videos, "frames_for_tests:scenes", config)) == {"/v/a.mp4": [20, 30, 110], "/v/b.mp4": list(range(0, 120, 10))}


def test_key_frames(videos):
    config = Config(decode_mode="keyframe", sampling="interval", interval_seconds=0.5)
    assert indices(candidates.candidates(videos, "frames_for_tests:able", config)) == both([0, 30, 60, 90])  # two seconds, thirty frames at least
    got = candidates.candidates(videos, "frames_for_tests:streaming", config)
    assert got.meta is None and indices(got) == both(list(range(0, 120, 12)))


@pytest.mark.parametrize("mode, decoder, extra, most", [
    ("interval", "able", ["interval_seconds=3"], 4 + 4),  # what is measured, and what is kept once more
    ("scene", "able", ["frames_per_scene=2"], 25 + 6 + 6),
    ("hybrid", "able", ["frames_per_scene=2", "interval_seconds=2"], 25 + 6 + 6),
])
def test_only_candidates_are_decoded(spark, tmp_path, monkeypatch, capsys, mode, decoder, extra, most):
    log = tmp_path / "log"
    inner = frames_for_tests.able

    module = tmp_path / f"logged_{mode}.py"
    module.write_text(f"import os\nimport frames_for_tests as f\ndef decode(path, lo, hi, wanted=None, step=1):\n    os.environ['FRAMES_LOG'] = {str(tmp_path)!r}\n    yield from f.able(path, lo, hi, wanted, step)\ndecode.probe = f.able.probe\n")
    spark.sparkContext.addPyFile(str(module))
    monkeypatch.syspath_prepend(str(tmp_path))
    cli.main(["extract", *[x for s in (*SIZES, f"sampling={mode}", *extra) for x in ("--set", s)], "--decoder", f"logged_{mode}:decode", str(tmp_path / "out"), "/v/a.mp4"])
    said = json.loads(capsys.readouterr().out)
    assert said["written"] == {"interval": 4, "scene": 6, "hybrid": 6}[mode] and inner.probe("x")[1] == 120
    assert len(log.read_text().splitlines()) <= most
    assert (tmp_path / "out/_contact_sheet.png").exists() and (tmp_path / "out/_gallery.html").read_text().count("<figure") == said["written"]


def test_a_decoder_of_few_abilities():
    got = [i for i, _, _ in video.frames_of(frames_for_tests.decode, "x", wanted=[3, 7])]
    assert got == [3, 7] and [i for i, _, _ in video.frames_of(frames_for_tests.decode, "x", step=6)] == [0, 6, 12, 18, 19]
    assert list(video.frames_of(frames_for_tests.decode, "x", wanted=[])) == []


PROGRAM = """#!{python}
import re, sys
import numpy as np
args = sys.argv[1:]
value = lambda name, other=None: args[args.index(name) + 1] if name in args else other
sys.stderr.write("Input #0\\n  Duration: 00:00:02.00, start: 0\\n  Stream #0:0: Video: h264, yuv420p, 64x48 [SAR 1:1], 10 fps, 10 tbr\\n")
frames = range(0, 20, 5 if "-skip_frame" in args else 1)
frames = [i for i in frames if i / 10 >= float(value("-ss", 0)) - 1e-6][: int(value("-frames:v", 99))]
if "showinfo" in args:
    for i in frames:
        sys.stderr.write(f"[Parsed_showinfo] n:{{i}} pts_time:{{i / 10}} \\n")
elif "rawvideo" in args:
    for i in frames:
        sys.stdout.buffer.write(np.full((48, 64, 3), i, np.uint8).tobytes())
"""


def test_ffmpeg(tmp_path, monkeypatch):
    import sys

    fake = tmp_path / "ffmpeg"
    fake.write_text(PROGRAM.format(python=sys.executable))
    fake.chmod(fake.stat().st_mode | stat.S_IXUSR)
    monkeypatch.setenv("PATH", f"{tmp_path}{os.pathsep}{os.environ['PATH']}")
    seen = lambda frames: [(i, t, int(image[0, 0, 0])) for i, t, image in frames]
    assert ffmpeg.probe("x") == (10.0, 20, 64, 48)
    assert seen(ffmpeg.decode("x", None, None)) == [(i, i / 10, i) for i in range(20)]
    assert seen(ffmpeg.decode("x", 4, 6)) == [(i, i / 10, i) for i in (4, 5, 6)]
    assert seen(ffmpeg.decode("x", None, None, step=8)) == [(i, i / 10, i) for i in (0, 8, 16, 19)]
    assert seen(video.frames_of(ffmpeg.decode, "x", wanted=[2, 9])) == [(2, 0.2, 2), (9, 0.9, 9)]
    assert seen(ffmpeg.decode("x", None, None, wanted=[17])) == [(17, 1.7, 17)]  # sought
    assert seen(ffmpeg.keyframes("x", 3)) == [(0, 0.0, 0), (5, 0.5, 5), (10, 1.0, 10)]
    monkeypatch.setenv("PATH", str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        ffmpeg.program()


def test_what_cannot_be_done_is_refused(spark):
    for bad in ("gpu_accel=true", "phash_size=16", "output_format=webp", "tag_images=true"):
        with pytest.raises(ValueError, match=bad.partition("=")[0]):
            cli.main(["extract", "--set", bad, "--decoder", "frames_for_tests:decode", "out", "a.mp4"])


def test_every_setting_is_read():
    import dataclasses
    import re
    from pathlib import Path

    root = Path(cli.__file__).parent
    code = "\n".join(f.read_text() for f in root.rglob("*.py") if f.name != "config.py" and "llm" not in f.parts)
    unread = [f.name for f in dataclasses.fields(Config) if not re.search(rf"config\.{f.name}\b", code)]
    assert unread == ["input"]  # a note of what was read
