import pytest

from sievewright.config import Config, list_presets, load_preset


def test_defaults_and_bounds():
    c = Config()
    assert (c.sampling, c.frames_per_scene, c.color_distance, c.auto_quality, c.decode_mode, c.max_per_video) == ("hybrid", 5, 0.08, False, "accurate", None)
    for bad in ({"resolution": 1001}, {"resolution": 128}, {"sampling": "all"}, {"interval_seconds": 0}, {"jpg_quality": 20}, {"frames_per_scene": 2.5}, {"dedup": 1}, {"unknown": 1}):
        with pytest.raises(ValueError):
            Config.layered(bad)
    with pytest.raises(ValueError):
        Config(output_format=None)


def test_toml_and_overrides(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("resolution = 768\nblur_threshold = 50\n")
    c = Config.from_toml(path, {"input": "~/x", "blur_threshold": None, "min_contrast": 3})
    assert (c.resolution, c.blur_threshold, c.min_contrast) == (768, 50, 3) and "~" not in c.input
    assert "max_per_video" not in c.to_dict() and Config.layered(c.to_dict()) == c


def test_presets():
    assert [n for n, _ in list_presets()] == ["character", "preview", "style"] and all(d for _, d in list_presets())
    assert Config.from_preset("preview", {"input": "a"}).resolution == 768 and "description" not in load_preset("style")
    with pytest.raises(FileNotFoundError, match="preview"):
        load_preset("nothing")
