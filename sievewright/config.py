"""Settings of a curation run: one frozen class, checked when made; TOML files, presets and overrides in layers."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

PRESETS = Path(__file__).parent / "presets"


def _f(default: Any, *, least: float | None = None, most: float | None = None, over: float | None = None, of: tuple | None = None, eights: bool = False) -> Any:
    extra = {"least": least, "most": most, "over": over, "of": of, "eights": eights}
    return field(default_factory=lambda: default.copy(), metadata=extra) if isinstance(default, dict) else field(default=default, metadata=extra)


@dataclass(frozen=True)
class Config:
    """Defaults are those of a careful single run. Bounds are inclusive but for `over`."""

    # input and output
    input: str = _f("")
    output: str = _f("output")
    flatten_output: bool = _f(False)
    output_format: str = _f("png", of=("png", "jpg", "webp"))
    jpg_quality: int = _f(95, least=50, most=100)
    webp_quality: int = _f(95, least=50, most=100)
    # sampling
    sampling: str = _f("hybrid", of=("hybrid", "scene", "interval"))
    scene_threshold: float = _f(27.0, least=1.0, most=100.0)
    frames_per_scene: int = _f(5, least=1, most=30)
    interval_seconds: float = _f(2.0, over=0.0)
    # gates
    blur_threshold: float = _f(100.0, least=0.0)
    min_brightness: float = _f(15.0, least=0.0, most=255.0)
    max_brightness: float = _f(245.0, least=0.0, most=255.0)
    min_contrast: float = _f(10.0, least=0.0)
    detect_letterbox: bool = _f(True)
    letterbox_threshold: int = _f(16, least=0, most=128)
    letterbox_min_ratio: float = _f(0.98, least=0.5, most=1.0)
    # buckets
    resolution: int = _f(1024, least=256, most=4096, eights=True)
    min_bucket: int = _f(512, least=64, eights=True)
    max_bucket: int = _f(2048, least=64, eights=True)
    bucket_step: int = _f(64, least=8)
    min_pixels: int = _f(500_000, least=0)
    resize_mode: str = _f("cover", of=("cover", "contain", "longest"))
    # duplicates
    dedup: bool = _f(True)
    phash_size: int = _f(8, least=4, most=16)
    phash_distance: int = _f(5, least=0, most=64)
    dedup_index: str | None = _f(None)
    # diversity
    ssim_filter: bool = _f(True)
    ssim_threshold: float = _f(0.85, least=0.0, most=1.0)
    color_diversity: bool = _f(True)
    color_distance: float = _f(0.08, least=0.0)
    completeness_filter: bool = _f(False)
    completeness_threshold: float = _f(0.35, least=0.0, most=1.0)
    subject_size_filter: bool = _f(False)
    subject_min_ratio: float = _f(0.15, least=0.0, most=1.0)
    min_per_video: int = _f(3, least=0)
    # thresholds from the data
    auto_quality: bool = _f(False)
    auto_quality_percentile: float = _f(60.0, least=10.0, most=95.0)
    # decoding and overlays
    crop_watermark: bool = _f(False)
    detect_watermark: bool = _f(True)
    gpu_accel: bool = _f(False)
    decode_mode: str = _f("accurate", of=("accurate", "keyframe"))
    # tags
    tag_images: bool = _f(False)
    trigger_word: str = _f("")
    tagger_model: str = _f("")
    tag_general_threshold: float = _f(0.35, least=0.0, most=1.0)
    tag_character_threshold: float = _f(0.85, least=0.0, most=1.0)
    kohya_repeats: int = _f(0, least=0, most=1000)
    tag_blacklist: str = _f("")
    tag_always: str = _f("")
    trait_prune_threshold: float = _f(0.0, least=0.0, most=1.0)
    tag_require: str = _f("")
    tag_exclude: str = _f("")
    # time segments by video
    segments: dict = _f({})
    # galleries
    contact_sheet: bool = _f(True)
    html_gallery: bool = _f(True)
    # running
    workers: int = _f(0, least=0, most=32)
    seek_accurate: bool = _f(True)
    skip_existing: bool = _f(True)
    max_per_video: int | None = _f(None, least=1)
    log_level: str = _f("INFO", of=("DEBUG", "INFO", "WARNING", "ERROR"))

    def __post_init__(self) -> None:
        for f in dataclasses.fields(self):
            value, m = getattr(self, f.name), f.metadata
            if value is None:
                if f.default is not None:
                    raise ValueError(f"{f.name} must not be empty")
                continue
            kind = str(f.type).split(" |")[0]
            if kind in ("int", "float") and (isinstance(value, bool) or not isinstance(value, (int, float)) or kind == "int" and value != int(value)):
                raise ValueError(f"{f.name} must be a number ({kind}), not {value!r}")
            if kind in ("bool", "str", "dict") and not isinstance(value, {"bool": bool, "str": str, "dict": dict}[kind]):
                raise ValueError(f"{f.name} must be {kind}, not {value!r}")
            if m["of"] and value not in m["of"]:
                raise ValueError(f"{f.name} must be one of {', '.join(m['of'])}, not {value!r}")
            if m["least"] is not None and value < m["least"] or m["most"] is not None and value > m["most"] or m["over"] is not None and value <= m["over"]:
                raise ValueError(f"{f.name} is out of bounds: {value}")
            if m["eights"] and value % 8:
                raise ValueError(f"{f.name} must be a multiple of 8, not {value}")
        for name in ("input", "output", "dedup_index"):
            if isinstance(value := getattr(self, name), str):
                object.__setattr__(self, name, os.path.expanduser(value))

    @classmethod
    def layered(cls, *layers: dict | None) -> Config:
        """Later layers win; values of None are no opinion. The whole is checked, not each layer."""
        merged = {k: v for layer in layers for k, v in (layer or {}).items() if v is not None}
        if unknown := sorted(merged.keys() - {f.name for f in dataclasses.fields(cls)}):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**merged)

    @classmethod
    def from_toml(cls, path: str | Path, overrides: dict | None = None) -> Config:
        with open(path, "rb") as file:
            return cls.layered(tomllib.load(file), overrides)

    @classmethod
    def from_preset(cls, name: str, overrides: dict | None = None) -> Config:
        return cls.layered(load_preset(name), overrides)

    def to_dict(self) -> dict:
        """Settings for a TOML file: those that are empty are left out."""
        return {k: v for k, v in dataclasses.asdict(self).items() if v is not None}


def list_presets() -> list[tuple[str, str]]:
    """(name, description) of each preset, by name."""
    return [(p.stem, tomllib.loads(p.read_text()).get("description", "")) for p in sorted(PRESETS.glob("*.toml"))]


def load_preset(name: str) -> dict:
    """A preset's settings without its description; an unknown name is an error that lists the known ones."""
    path = PRESETS / f"{name}.toml"
    if not path.is_file():
        raise FileNotFoundError(f"no preset {name!r}; there are {', '.join(n for n, _ in list_presets())}")
    settings = tomllib.loads(path.read_text())
    settings.pop("description", None)
    return settings
