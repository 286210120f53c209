import json

import numpy as np
import pytest

import frames_for_tests
from sievewright import cli, sinks


def make_model():
    return lambda batch: np.tile([0.9, 0.5, 0.95], (len(batch), 1))


def test_presets(capsys):
    assert cli.main(["presets"]) == 0 and "preview\t" in capsys.readouterr().out


def test_dry_run_layers(spark, capsys, tmp_path):
    (tmp_path / "c.toml").write_text("resolution = 512\nmin_contrast = 1.0\n")
    cli.main(["extract", "--preset", "preview", "--config", str(tmp_path / "c.toml"), "--set", "min_contrast=2", "--set", "dedup=false", "--segment", "a.mp4:1-2", "--decoder", "x:y", "--dry-run", "out", "a.mp4"])
    got = json.loads(capsys.readouterr().out)
    assert (got["resolution"], got["min_contrast"], got["dedup"], got["interval_seconds"], got["segments"]) == (512, 2.0, False, 5.0, {"a.mp4": [[1.0, 2.0]]})
    for bad in ("nothing=1", "dedup=maybe", "resolution=x", "resolution"):
        with pytest.raises(SystemExit):
            cli.main(["extract", "--set", bad, "--decoder", "x:y", "out", "a.mp4"])


def test_extract(spark, capsys, tmp_path):
    sizes = [s for n in ("resolution=256", "min_bucket=64", "max_bucket=256", "min_pixels=1000", "min_per_video=0") for s in ("--set", n)]
    cli.main(["extract", *sizes, "--set", "sampling=interval", "--set", "interval_seconds=0.1", "--segment", "clip.mp4:0-0.7", "--decoder", "frames_for_tests:decode", str(tmp_path / "out"), "clip.mp4"])
    assert json.loads(capsys.readouterr().out)["written"] == 4
    assert (tmp_path / "out/_gallery.html").read_text().count("<figure") == 4 and (tmp_path / "out/_contact_sheet.png").exists()
    assert len(list((tmp_path / "out/clip").glob("*.png"))) == 4 and (tmp_path / "out/_report.html").exists()
    assert json.loads((tmp_path / "out/clip.mp4/_stats.json").read_text())["written"] == 4


def test_extract_samples_skips_and_remembers(spark, capsys, tmp_path):
    def run(out, *settings, videos=("clip.mp4",)):
        sizes = ("resolution=256", "min_bucket=64", "max_bucket=256", "min_pixels=1000", "min_per_video=0", *settings)
        cli.main(["extract", *[s for n in sizes for s in ("--set", n)], "--decoder", "frames_for_tests:decode", str(tmp_path / out), *videos])
        return json.loads(capsys.readouterr().out)["written"]

    index = f"dedup_index={tmp_path / 'index.json'}"
    assert run("a", "sampling=interval", "interval_seconds=0.4", index) == 5
    assert json.loads((tmp_path / "a/clip.mp4/_stats.json").read_text())["candidates"] == 5
    assert run("a", "sampling=interval", "interval_seconds=0.4") == 0  # finished
    assert run("a", "sampling=interval", "interval_seconds=0.4", videos=("clip.mp4", "clip_2.mp4")) == 5
    assert len(json.loads((tmp_path / "index.json").read_text())["entries"]) == 5
    assert run("b", "sampling=interval", "interval_seconds=0.4", index) == 0  # all known
    assert run("b", "sampling=interval", "interval_seconds=0.4", "skip_existing=false") == 5


def test_rejects_move(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(sinks.png(frames_for_tests.image("x", 0)))
    (tmp_path / "in/a.txt").write_text("old")
    (tmp_path / "tags.csv").write_text("id,name,category\n0,1girl,0\n1,long_hair,0\n2,miku,4\n")
    cli.main(["tag", "--model", "test_cli:make_model", "--vocabulary", str(tmp_path / "tags.csv"), "--exclude", "miku", str(tmp_path / "in")])
    got = json.loads(capsys.readouterr().out)
    assert (got["total"], got["tagged"], got["rejected"], got["failed"]) == (1, 0, 1, 0)
    assert (tmp_path / "in/_rejected/a.png").exists() and (tmp_path / "in/_rejected/a.txt").read_text() == "old" and not (tmp_path / "in/a.png").exists()


def test_tag(spark, capsys, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for k, name in enumerate(("a.png", "sub/b.png")):
        (tmp_path / "in" / name).write_bytes(sinks.png(frames_for_tests.image("x", 2 * k)))
    (tmp_path / "in/broken.png").write_bytes(b"no")
    (tmp_path / "tags.csv").write_text("id,name,category\n0,1girl,0\n1,long_hair,0\n2,miku,4\n")
    cli.main(["tag", "--model", "test_cli:make_model", "--vocabulary", str(tmp_path / "tags.csv"), "--trigger", "x", "--blacklist", "long hair", str(tmp_path / "in")])
    got = json.loads(capsys.readouterr().out)
    assert (got["total"], got["tagged"], got["rejected"], got["failed"], got["top"]) == (3, 2, 0, 1, [["1girl", 2], ["miku", 2]])
    assert (tmp_path / "in/a.txt").read_text() == "x, miku, 1girl\n" == (tmp_path / "in/sub/b.txt").read_text()


def test_extract_in_jpeg_and_tag(spark, capsys, tmp_path):
    (tmp_path / "tags.csv").write_text("id,name,category\n0,1girl,0\n1,long_hair,0\n2,miku,4\n")
    names = ("resolution=256", "min_bucket=64", "max_bucket=256", "min_pixels=1000", "min_per_video=0", "sampling=interval", "interval_seconds=0.4", "output_format=jpg", "tag_images=true", "trigger_word=x", "flatten_output=true", "log_level=ERROR")
    cli.main(["extract", *[s for n in names for s in ("--set", n)], "--model", "test_cli:make_model", "--vocabulary", str(tmp_path / "tags.csv"), "--decoder", "frames_for_tests:decode", str(tmp_path / "out"), "clip.mp4"])
    got = json.loads(capsys.readouterr().out)
    assert got["written"] == got["tags"]["tagged"] == 5
    images = sorted((tmp_path / "out").glob("clip_*.jpg"))
    assert len(images) == 5 and all(f.with_suffix(".txt").read_text() == "x, miku, 1girl, long hair\n" for f in images)
    page = (tmp_path / "out/_gallery.html").read_text()
    assert page.count("<figure") == 5 and page.count("tags: x, miku") == 5 and "miku" in (tmp_path / "out/_report.html").read_text()
