import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import frames_for_tests
from sievewright import sinks
from sievewright.config import Config
from sievewright.functions import kernels
from sievewright.operators import geometry, inference, overlays, tagging
from sievewright.plans import extract
from sievewright.sources import files
from sievewright.sources.video import FrameSource

SETTINGS = {"resolution": 256, "min_bucket": 64, "max_bucket": 256, "bucket_step": 64, "min_pixels": 1000, "min_per_video": 0}


@pytest.fixture(scope="module")
def frames(spark):
    spark.dataSource.register(FrameSource)
    paths = "\n".join(f"clip {k}.mp4" for k in range(3))
    return spark.read.format("frames").option("paths", paths).option("decoder", "frames_for_tests:decode").load()


def test_source_and_its_bounds(spark, frames):
    assert frames.where("frame_index >= 4 and frame_index < 7").count() == 9 and frames.count() == 60
    reader = spark.read.format("frames").option("paths", "clip 1.mp4").option("decoder", "frames_for_tests:decode")
    got = reader.option("from", 4).option("to", 6).load().collect()
    assert [r.frame_index for r in got] == [4, 5, 6]
    first = got[0]
    assert np.array_equal(np.frombuffer(first.data, np.uint8).reshape(first.height, first.width, 3), frames_for_tests.image("clip 1.mp4", 4))


def test_curation(frames, tmp_path):
    config = Config.layered(SETTINGS)
    done = extract.curated(extract.measured(frames, config), config)
    reasons = {(r.video, r.frame_index): r.reason for r in done.decisions.collect()}
    assert len(reasons) == 60
    for v in range(3):
        for i in range(20):
            flat = i % 10 == 9
            want = "blur" if flat else "ssim" if i % 2 else ""
            assert reasons[f"clip {v}.mp4", i] == want, (v, i)
    stats = {r.video: r for r in done.stats.collect()}
    assert all((r.candidates, r.written, r.rejected_blur, r.rejected_ssim) == (20, 10, 2, 8) for r in stats.values())
    records = sorted(done.records.collect(), key=lambda r: (r.video, r.frame_index))
    assert [r.path for r in records[:2]] == ["clip_0/clip_0_00001.png", "clip_0/clip_0_00002.png"] and len({r.path for r in records}) == 30
    images = extract.rendered(done.records, frames, config, sinks.encoder("png"))
    assert sinks.save_files(images, str(tmp_path / "out")) == 30
    read = files.read_images(frames.sparkSession, str(tmp_path / "out"))
    assert {(r.height, r.width) for r in read.collect()} == {(r.bucket_h, r.bucket_w) for r in records}
    assert files.collect_images(frames.sparkSession, str(tmp_path / "out")).count() == 30
    page = sinks.report_html(done.stats, done.records)
    assert "30 of 60 kept" in page and "clip 0.mp4" in page
    assert sinks.save_files(sinks.stats_files(done.stats), str(tmp_path / "stats")) == 3
    summary = json.loads(sinks.run_summary(done.stats, 1.5))
    assert (summary["total_written"], summary["total_candidates"], len(summary["videos"])) == (30, 60, 3)


def test_backfill_caps_and_index(frames):
    strict = Config.layered(SETTINGS, {"color_distance": 50.0, "min_per_video": 4, "flatten_output": True, "kohya_repeats": 10, "trigger_word": " my  char "})
    done = extract.curated(extract.measured(frames, strict), strict)
    per = {r.video: (r.written, r.backfilled) for r in done.stats.collect()}
    assert all(w == 4 or b == 0 for w, b in per.values()) and any(b for _, b in per.values())
    assert all(r.path.startswith("10_my_char/") for r in done.records.collect())
    capped = Config.layered(SETTINGS, {"max_per_video": 2})
    measures = extract.measured(frames, capped)
    assert {r.written for r in extract.curated(measures, capped).stats.collect()} == {2}
    config = Config.layered(SETTINGS)
    index = measures.where("video = 'clip 1.mp4'").select("hash")
    again = extract.curated(extract.measured(frames, config), config, index=index)
    assert {r.video: r.written for r in again.stats.collect()}["clip 1.mp4"] == 0


def test_the_same_video_twice_is_kept_once(frames):
    config = Config.layered(SETTINGS)
    twice = frames.where("video = 'clip 0.mp4'").unionByName(frames.where("video = 'clip 0.mp4'").withColumn("video", F.lit("copy.mp4")))
    done = extract.curated(extract.measured(twice, config), config)
    assert {r.video: (r.written, r.rejected_dup) for r in done.stats.collect()} == {"clip 0.mp4": (10, 0), "copy.mp4": (0, 10)}


def test_bad_frames_and_options(frames):
    config = Config.layered(SETTINGS, {"auto_quality": True, "completeness_filter": True, "subject_size_filter": True, "resize_mode": "longest", "dedup": False, "ssim_filter": False, "color_diversity": False})
    broken = frames.where("video = 'clip 0.mp4'").withColumn("data", F.when(F.col("frame_index") == 3, F.lit(b"xx")).otherwise(F.col("data")))
    done = extract.curated(extract.measured(broken, config), config)
    assert done.decisions.where("reason = 'error'").count() == 1 and done.stats.first().errors == 1
    assert all(max(r.bucket_w, r.bucket_h) == 256 for r in done.records.collect())


def test_capture_passes_no_gate(frames):
    config = Config.layered(SETTINGS, {"min_pixels": 10**9})
    (row,) = extract.captured(frames, "clip 2.mp4", 9, config, 7, sinks.png).collect()
    assert row.path == "clip_2_manual_00007.png" and bytes(row.content).startswith(b"\x89PNG")
    assert extract.captured(frames, "clip 2.mp4", 99, config, 7, sinks.png).collect() == []


def test_tagging_of_images(frames, spark):
    images = frames.where("video = 'clip 0.mp4'").select(F.concat_ws("#", "video", "frame_index").alias("path"), "height", "width", "channels", "data")

    def make_model():
        def model(batch):
            if any(x.std() < 70 and (x == 128).mean() > 0.5 for x in batch):
                raise RuntimeError("flat")
            return np.tile([0.9, 0.4, 0.95], (len(batch), 1))

        return model

    got = inference.probabilities(images, make_model, side=32)
    bad = {r.image for r in got.where("error is not null").collect()}
    assert bad == {"clip 0.mp4#9", "clip 0.mp4#19"}
    vocabulary = spark.createDataFrame([(0, "1girl", 0), (1, "long_hair", 0), (2, "miku", 4)], "idx int, name string, category int")
    good = got.where("error is null")
    tags = tagging.picked(tagging.scored(good, vocabulary))
    captions = tagging.captions(tagging.caption_tokens(good.select("image"), tags, "x"))
    assert {r.caption for r in captions.collect()} == {"x, miku, 1girl, long hair"} and captions.count() == 18
    side = sinks.sidecars(captions).first()
    assert side.path.endswith(".txt") and bytes(side.content) == b"x, miku, 1girl, long hair\n"


def test_files(spark, tmp_path):
    for name in ("a.mp4", "sub/B.MKV", "sub/ignore.txt", "a.txt", "x.png", "_sheet.png", "_rejected/y.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"1")
    names = lambda df: sorted(r.path.rpartition("/")[2] for r in df.collect())
    assert names(files.discover_videos(spark, str(tmp_path))) == ["B.MKV", "a.mp4"]
    assert names(files.discover_videos(spark, str(tmp_path / "a.txt"))) == ["a.txt"]
    with pytest.raises(FileNotFoundError):
        files.discover_videos(spark, str(tmp_path / "none"))
    assert names(files.collect_images(spark, str(tmp_path))) == ["x.png"]


def test_vocabulary(spark, tmp_path):
    path = tmp_path / "tags.csv"
    path.write_text("tag_id,name,category,count\n1,1girl,0,5\n2,short\n3,miku,4,1\n4,odd,x,1\n5,general,9,1\n6,other,7,1\n")
    assert [tuple(r) for r in files.load_vocabulary(spark, str(path)).collect()] == [(0, "1girl", 0), (2, "miku", 4), (4, "general", 9)]
    path.write_text("1,1girl,0\n2,miku,4\n")
    assert files.load_vocabulary(spark, str(path)).count() == 2
    path.write_text("")
    assert files.load_vocabulary(spark, str(path)).count() == 0


def test_index_round_trip(spark, tmp_path):
    path = str(tmp_path / "index.json")
    empty, d = files.load_index(spark, path, 7)
    assert empty.count() == 0 and d == 7
    rows = [(-1, "a"), (5, "b/é"), (1 << 62, "c")]
    files.save_index(spark.createDataFrame(rows, "hash long, source string"), path, 5)
    assert json.loads(open(path).read())["entries"][0]["hash"] == "f" * 16
    again, d = files.load_index(spark, path, 9)
    assert sorted(map(tuple, again.collect())) == sorted(rows) and d == 9


def test_sheet_gallery_and_encoders():
    a = np.full((50, 100, 3), 200, np.uint8)
    sheet = sinks.contact_sheet([a, None, a] * 3, thumb=20, columns=8)
    assert sheet.shape == (48, 192, 3) and (sheet[:24, 24:48] == 32).all() and (sheet == 200).any()
    assert sinks.contact_sheet([]) is None
    page = sinks.gallery_html([("a/<b>.png", "blur 1.0\n&")])
    assert "&lt;b&gt;" in page and "<b>" not in page
    with pytest.raises(ValueError):
        sinks.encoder("webp")
    assert sinks.encoder("webp", {"webp": sinks.png}) is sinks.png and kernels.grey(a).shape == (50, 100)


def overlaid(spark, boxed=True):
    rows = []
    rng = np.random.default_rng(3)
    text = np.zeros((6, 40), np.uint8)
    text[:, ::8] = text[0] = 255
    for i in range(16):
        frame = rng.integers(60, 180, (240, 426)).astype(np.uint8)
        frame[100:160, 20 + 20 * i : 70 + 20 * i] = 220
        if boxed:
            frame[8:14, 360:400] = text
        image = np.repeat(frame[..., None], 3, 2)
        rows.append(("logo.mp4" if boxed else "plain.mp4", i, float(i), 240, 426, 3, image.tobytes()))
    return spark.createDataFrame(rows, "video string, frame_index long, t double, height int, width int, channels int, data binary")


def test_overlays_are_found_and_cropped(spark):
    both = overlaid(spark).unionByName(overlaid(spark, False))
    found = overlays.detected(both, min_confidence=0.2)
    got = {r.video: r.watermarks for r in found.collect()}
    assert got["plain.mp4"] == [] and got["logo.mp4"][0].location == "top-right"
    assert {r.video: r.watermarks for r in overlays.detected(both.where("frame_index < 4")).collect()} == {"plain.mp4": [], "logo.mp4": []}
    config = Config.layered(SETTINGS, {"crop_watermark": True, "detect_letterbox": False, "min_bucket": 64, "max_bucket": 256})
    rects = {r.video: (r.x, r.y, r.w, r.h) for r in extract.measured(both, config, found).collect()}
    box = got["logo.mp4"][0]
    assert rects["plain.mp4"] == (0, 0, 426, 240) and rects["logo.mp4"][1] == box.y + box.h + 2 and rects["logo.mp4"][2] == box.x - 2
    done = extract.curated(extract.measured(both, config, found), config, watermarks=found)
    assert "top-right" in sinks.report_html(done.stats, done.records)


def test_paths_are_unique(frames, spark):
    """Videos of one stem in different folders, of stems that become one, and a video of more frames than a number has digits."""
    base = frames.where("video = 'clip 0.mp4' and frame_index < 4")
    names = ["/a/clip.mp4", "/b/clip.mp4", "/b/clip.mkv", "/c/Clip?.mp4", "/d/other.mp4"]
    several = [base.withColumns({"video": F.lit(n), "frame_index": F.col("frame_index") + (199_990 if n.startswith("/d") else 0)}) for n in names]
    every = several[0]
    for one in several[1:]:
        every = every.unionByName(one)
    for layout in ({}, {"flatten_output": True}, {"flatten_output": True, "kohya_repeats": 3}):
        config = Config.layered(SETTINGS, {"dedup": False, "ssim_filter": False, "color_diversity": False}, layout)
        records = extract.curated(extract.measured(every, config), config).records
        paths = [r.path for r in records.collect()]
        assert len(paths) == len(set(map(str.lower, paths))) == 20
        sinks.refuse_repeats(records)
        assert sum(p.rpartition("/")[2].startswith("other_0") for p in paths) == 4
    with pytest.raises(ValueError, match="twice.png"):
        sinks.refuse_repeats(spark.createDataFrame([("twice.png",), ("twice.png",), ("once.png",)], "path string"))


def test_numbers_go_on_past_five_digits(spark):
    from sievewright.operators import selection

    rows = spark.range(100_002).select(F.lit("v").alias("video"), F.col("id").alias("frame_index"), F.lit(3).alias("p"))
    names = selection.sequence_numbers(rows, "p").select(selection.output_name(F.lit("v"), F.col("in_video"), "png").alias("n"))
    assert names.distinct().count() == 100_002
    some = spark.createDataFrame([(f"v{i:03d}",) for i in range(50)], "video string").repartition(5)
    assert [r.place for r in selection.places(some, "video").orderBy("video").collect()] == list(range(50))


@pytest.mark.parametrize("size", [(64, 96), (37, 51), (1, 1), (8, 200)])
def test_jpeg_is_read_by_another_decoder(spark, tmp_path, size):
    from sievewright.functions import jpeg

    y, x = np.mgrid[0 : size[0], 0 : size[1]]
    image = np.stack([x * 255 // size[1], y * 255 // size[0], (x + y) % 256 // 2], -1).astype(np.uint8)
    noisy = np.random.default_rng(1).integers(0, 255, (*size, 3), dtype=np.uint8)
    errors = {}
    for name, one in (("smooth", image), ("noisy", noisy), ("grey", image[..., 0]), ("flat", np.full((*size, 3), 77, np.uint8))):
        for q in (50, 95):
            (tmp_path / f"{name}-{q}.jpg").write_bytes(jpeg.encode(one, q))
    for r in files.read_images(spark, str(tmp_path)).collect():
        name, _, q = r.path.rpartition("/")[2].removesuffix(".jpg").partition("-")
        want = {"smooth": image, "noisy": noisy, "grey": np.repeat(image[..., :1], 3, 2), "flat": np.full((*size, 3), 77, np.uint8)}[name]
        got = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)[..., :3]
        assert got.shape == want.shape
        errors[name, q] = np.abs(got.astype(int) - want).mean()
    assert len(errors) == 8 and all(errors[n, "95"] < 3 for n in ("smooth", "grey", "flat")) and errors["noisy", "95"] <= errors["noisy", "50"] < 45


def test_moving_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"1")
    moves = spark.createDataFrame([("a.png", "_rejected/a.png"), ("none.png", "_rejected/none.png")], "path string, target string")
    assert sinks.move_files(moves, str(tmp_path)) == 1 == sinks.move_files(moves, str(tmp_path))
    assert (tmp_path / "_rejected/a.png").exists() and not (tmp_path / "a.png").exists()
