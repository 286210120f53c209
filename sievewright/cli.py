"""Command line: presets, extract, tag.

    python -m sievewright presets
    python -m sievewright extract --preset style --decoder module:function --set sampling=interval --set interval_seconds=3 OUTPUT VIDEO...
    python -m sievewright tag --model module:function --vocabulary tags.csv --trigger word FOLDER
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sinks
from .config import Config, list_presets, load_preset
from .functions import text
from .operators import inference, quality, reports, tagging
from .plans import candidates, extract
from .plans.shipping import ship
from .plans.storage import run_tables, written
from .sources import files, settings, video
from .sources.video import named as _named


def _override(spec: str) -> tuple[str, object]:
    """name=value, the value typed as the setting is."""
    name, sep, value = spec.partition("=")
    kinds = {f.name: str(f.type).split(" |")[0] for f in dataclasses.fields(Config)}
    if not sep or name not in kinds:
        raise argparse.ArgumentTypeError(f"{spec!r}: NAME=VALUE with the name of a setting is expected")
    if kinds[name] == "bool":
        if value.lower() not in ("true", "false"):
            raise argparse.ArgumentTypeError(f"{name} is true or false")
        return name, value.lower() == "true"
    try:
        return name, {"int": int, "float": float}.get(kinds[name], str)(value)
    except ValueError:
        raise argparse.ArgumentTypeError(f"{name} is a number ({kinds[name]})") from None


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sievewright")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("presets", help="list the presets")
    run = commands.add_parser("extract", help="make a training set of videos' frames")
    run.add_argument("output")
    run.add_argument("videos", nargs="+")
    run.add_argument("--preset")
    run.add_argument("--config")
    run.add_argument("--decoder", required=True, help="module:function that gives a video's frames")
    run.add_argument("--encoder", help="module:function that makes the bytes of an image, for formats other than PNG and JPEG")
    run.add_argument("--model", help="module:function that makes a tagger, for the setting tag_images")
    run.add_argument("--vocabulary", help="the tagger's tags")
    run.add_argument("--segment", action="append", default=[], help="NAME:START-END in seconds")
    run.add_argument("--set", action="append", default=[], type=_override, metavar="NAME=VALUE")
    run.add_argument("--dry-run", action="store_true", help="print the settings and stop")
    tag = commands.add_parser("tag", help="caption the images of a folder")
    tag.add_argument("folder")
    tag.add_argument("--model", required=True, help="module:function that makes a function from pixels to scores")
    tag.add_argument("--vocabulary", required=True)
    for name, default in (("trigger", ""), ("blacklist", ""), ("always", ""), ("require", ""), ("exclude", "")):
        tag.add_argument(f"--{name}", default=default)
    for name, default in (("threshold", 0.35), ("character-threshold", 0.85), ("prune-threshold", 0.0)):
        tag.add_argument(f"--{name}", type=float, default=default)
    return out


def _unfinished(spark: SparkSession, videos: Sequence[str], output: str) -> list[str]:
    """The videos whose numbers no earlier run has written."""
    path = lambda video: spark._jvm.org.apache.hadoop.fs.Path(f"{output}/{video}/_stats.json")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = [(v,) for v in videos if path(v).getFileSystem(conf).exists(path(v))]
    left = quality.pending(spark.createDataFrame([(v,) for v in videos], "video string"), spark.createDataFrame(done, "video string"))
    return [r.video for r in left.collect()]


def _settings(args: argparse.Namespace) -> Config:
    """The run's settings in layers."""
    import tomllib

    layers: list[dict] = [load_preset(args.preset)] if args.preset else []
    if args.config:
        with open(args.config, "rb") as f:
            layers.append(tomllib.load(f))
    return Config.layered(*layers, dict(args.set), {"output": args.output, "input": ",".join(args.videos), "segments": settings.parse_segments(args.segment) or None})


def _refuse(config: Config, args: argparse.Namespace) -> None:
    """An error for what this engine can't do, before anything is read."""
    if config.gpu_accel:
        raise ValueError("gpu_accel: there are no GPU kernels here")
    if config.phash_size > 8:
        raise ValueError("phash_size: hashes of over 64 bits aren't supported")
    if config.output_format == "webp" and not args.encoder:
        raise ValueError("output_format webp: name an --encoder; PNG and JPEG are built in")
    if config.tag_images and not (args.model or config.tagger_model) or config.tag_images and not args.vocabulary:
        raise ValueError("tag_images needs --model (or the setting tagger_model, as module:function) and --vocabulary")


def _encoder(config: Config, name: str | None):
    """An image's bytes. A caller's encoder gets the quality that is set for its format."""
    quality_ = {"jpg": config.jpg_quality, "webp": config.webp_quality}.get(config.output_format)
    if not name:
        return sinks.encoder(config.output_format, quality=quality_ or 95)
    encode = _named(name)
    return encode if quality_ is None else lambda image: encode(image, quality_)


def _extract(spark: SparkSession, args: argparse.Namespace) -> dict:
    config = _settings(args)
    if args.dry_run:
        return config.to_dict()
    _refuse(config, args)
    spark.sparkContext.setLogLevel("WARN" if config.log_level == "WARNING" else config.log_level)
    start = time.time()
    left = _unfinished(spark, args.videos, config.output) if config.skip_existing else args.videos
    if not left:
        return {"written": 0, "output": config.output}
    videos = spark.createDataFrame([(v,) for v in left], "video string")
    found = candidates.candidates(videos, args.decoder, config)
    marks = written(candidates.overlaid(videos, args.decoder, found.meta)) if config.detect_watermark or config.crop_watermark else None
    index = files.load_index(spark, config.dedup_index, config.phash_distance, config.phash_size)[0] if config.dedup and config.dedup_index else None
    done = extract.curated(extract.measured(found.frames, config, marks), config, index=index, watermarks=marks)
    records = written(done.records)
    sinks.refuse_repeats(records)
    # a stream of key frames is read again; of other videos only what is kept is decoded
    again = found.frames if found.meta is None else video.decoded(records, args.decoder, config.seek_accurate, config.workers or None)
    n = sinks.save_files(extract.rendered(records, again, config, _encoder(config, args.encoder)), config.output)
    tags = None
    if config.tag_images:
        tags = tag_folder(spark, config.output, _named(args.model or config.tagger_model), args.vocabulary, config.trigger_word, config.tag_general_threshold, config.tag_character_threshold, config.tag_blacklist, config.tag_always, config.tag_require, config.tag_exclude, config.trait_prune_threshold)
    sinks.save_files(sinks.stats_files(done.stats), config.output)
    top = spark.createDataFrame([tuple(t) for t in tags["top"]], "token string, n long") if tags else None
    pages = [("_report.html", sinks.report_html(done.stats, records, top).encode()), ("_run_summary.json", sinks.run_summary(done.stats, time.time() - start).encode())]
    images = records.select("path")
    if tags:
        gone = files.collect_images(spark, config.output).select(F.expr(f"substring(path, {len(config.output.rstrip('/')) + 2})").alias("path"))
        images = images.join(gone, "path", "left_semi")
    if config.contact_sheet and (sheet := sinks.sheet_of(images, config.output)) is not None:
        pages.append(("_contact_sheet.png", sinks.png(sheet, 6)))
    sinks.save_files(spark.createDataFrame(pages, "path string, content binary"), config.output)
    if config.html_gallery and n:
        captions = sinks.caption_tokens(images, config.output) if tags else None
        sinks.save_files(sinks.gallery_pages(reports.gallery_rows(images, records, captions)), config.output)
    if index is not None:
        new = records.where("hash is not null").select("hash", F.col("path").alias("source"))
        files.save_index(index.unionByName(new), config.dedup_index, config.phash_distance, config.phash_size)
    return {"written": n, "output": config.output, **({"tags": tags} if tags else {})}


def tag_folder(spark: SparkSession, folder: str, make_model, vocabulary: str, trigger: str = "", threshold: float = 0.35, character_threshold: float = 0.85, blacklist: str = "", always: str = "", require: str = "", exclude: str = "", prune_threshold: float = 0.0) -> dict:
    """Write a caption beside each image of a folder, and move rejected images, with their old captions, below `_rejected`.

    Returns numbers of what became of them.
    """
    listed = written(files.collect_images(spark, folder).select("path"))  # the folder changes below
    images = files.read_images(spark, folder).join(listed, "path", "left_semi")
    scores = written(inference.probabilities(images, make_model))
    good = scores.where("error is null").select("image")
    tags = tagging.picked(tagging.scored(scores.where("error is null"), files.load_vocabulary(spark, vocabulary)), threshold, character_threshold).persist()
    kept = tagging.accepted(good, tags, text.parse_tags(require), text.parse_tags(exclude))
    pruned = tagging.constant_tokens(good, tags, prune_threshold) if prune_threshold > 0 else None
    tokens = tagging.caption_tokens(kept, tags.join(kept, "image", "left_semi"), trigger, text.parse_tags(always), text.parse_tags(blacklist), pruned)
    captions = tagging.captions(tokens).persist()
    root = folder.rstrip("/")
    below = F.expr(f"substring(image, {len(root) + 2})")
    side = sinks.sidecars(captions.select(below.alias("image"), "caption"))
    tagged = sinks.save_files(side, root)
    refused = good.join(kept, "image", "left_anti").select(F.expr(f"substring(image, {len(root) + 2})").alias("path"))
    old = refused.select(F.regexp_replace("path", r"\.[^./]*$", ".txt").alias("path"))
    sinks.move_files(refused.select("path", sinks.rejected_path(F.col("path")).alias("target")), root)
    sinks.move_files(old.select("path", sinks.rejected_path(F.col("path")).alias("target")), root)
    n, ok, accepted = listed.count(), good.count(), kept.count()
    out = {"total": n, "tagged": tagged, "rejected": ok - accepted, "failed": n - ok + accepted - tagged}
    out["pruned"] = sorted(r.token for r in pruned.collect()) if pruned is not None else []
    out["top"] = [list(r) for r in tagging.top(tagging.frequencies(tokens, trigger), 10).collect()]
    for df in (captions, tags):
        df.unpersist()
    return out


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "presets":
        for name, description in list_presets():
            print(f"{name}\t{description}")
        return 0
    spark = SparkSession.builder.appName("sievewright").getOrCreate()
    ship(spark)
    if args.command == "extract":
        with run_tables(spark):
            print(json.dumps(_extract(spark, args), indent=1))
        return 0
    with run_tables(spark):
        names = ("trigger", "threshold", "character_threshold", "blacklist", "always", "require", "exclude", "prune_threshold")
        print(json.dumps(tag_folder(spark, args.folder, _named(args.model), args.vocabulary, **{n: getattr(args, n) for n in names}), indent=1))
    return 0
