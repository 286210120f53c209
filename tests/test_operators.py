import random
from fractions import Fraction
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.functions import text
from sievewright.operators import folds, geometry, near_hash, quality, reports, sampling, selection, tagging
from sievewright.sources import settings


def values(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- gates ---


def test_gate_order_and_strictness(spark):
    rows = [(99.9, 0.0, 0.0, "blur"), (100.0, 14.9, 0.0, "too dark"), (100.0, 245.1, 0.0, "too bright"), (100.0, 15.0, 9.9, "low contrast"), (100.0, 245.0, 10.0, "")]
    got = spark.createDataFrame(rows, "b double, l double, c double, want string").select(quality.gate_reason(F.col("b"), F.col("l"), F.col("c")), "want").collect()
    assert all(a == b for a, b in got)


def test_auto_threshold_keeps_its_share(spark):
    rows = [(1, i, float(i)) for i in range(40)] + [(2, i, 7.0) for i in range(9)]
    got = {r.video: r.threshold for r in quality.auto_threshold(spark.createDataFrame(rows, "video int, frame_index int, blur double"), 60.0).collect()}
    assert got[1] == pytest.approx(np.percentile(range(40), 40)) and got[2] == 50.0


def test_percentiles_round_once(spark):
    rng = random.Random(3)
    rows = [(v, i, round(rng.expovariate(0.05), 2)) for v in range(200) for i in range(10 + v % 41)]
    got = {r.video: r.threshold for r in quality.auto_threshold(spark.createDataFrame(rows, "video int, frame_index int, blur double")).collect()}
    for v in range(200):
        scores = sorted(x for w, _, x in rows if w == v)
        at = (len(scores) - 1) * 0.4
        lo, d = int(at), at - int(at)
        want = Fraction(scores[lo]) * Fraction(1 - d) + Fraction(scores[lo + (d > 0)] * d)
        assert got[v] == float(want)


def test_percentile_of_odd_scores(spark):
    inf, nan = float("inf"), float("nan")
    cases = [[], [3.3], [2.5] * 7, [-inf, inf], [1.0, inf], [1.0, nan], [-inf, -inf, 0.0], [5e-324, 1e308]]
    got = [r.p for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v array<double>").select("i", quality.percentile_of(F.col("v"), 0.4).alias("p")).orderBy("i").collect()]
    assert list(map(repr, got)) == list(map(repr, [None, 3.3, 2.5, nan, inf, nan, -inf, 1e308 * 0.4]))


def test_segments(spark):
    frames = spark.createDataFrame([(v, float(t)) for v in "ab" for t in range(12)], "video string, t double")
    spans = spark.createDataFrame([("a", 9.0, 3.0), ("a", 5.0, 6.0)], "video string, start double, stop double")
    got = quality.in_segments(frames, spans).collect()
    assert sorted(r.t for r in got if r.video == "a") == list(range(3, 10)) and sum(r.video == "b" for r in got) == 12


def test_segment_settings(spark):
    assert settings.parse_segments(["a:b.mp4:3-9", "a:b.mp4:20-30.5", "c:1-2"]) == {"a:b.mp4": [(3, 9), (20, 30.5)], "c": [(1, 2)]}
    for bad in ("a", "a:3", "a:x-4", "a:9-3"):
        with pytest.raises(ValueError):
            settings.parse_segments([bad])
        assert values(spark, settings.segment_column(F.lit(bad)))[0] is None
    assert settings.segments(spark, ["c:1-2"]).collect() == [("c", 1.0, 2.0)]


# --- sampling ---


def slow_scene(start, end, count):
    n = max(1, end - start)
    if n <= 1:
        return [start]
    if count <= 1:
        return [(start + end) // 2]
    margin = max(1, n // 10)
    lo, hi = (start + margin, end - margin) if end - margin > start + margin else (start, end)
    return [round(lo + i * ((hi - lo) / (count - 1))) for i in range(count)]


def test_scene_indices(spark):
    rows = [(a, a + n, k) for a in (0, 7) for n in (0, 1, 2, 3, 10, 25, 101) for k in (0, 1, 2, 5, 8)]
    got = spark.createDataFrame(rows, "a int, b int, k int").select(sampling.scene_indices(F.col("a"), F.col("b"), F.col("k"))).collect()
    assert [r[0] for r in got] == [slow_scene(*r) for r in rows]


def test_thinning(spark):
    rng = random.Random(1)
    rows = [(v, rng.randrange(3000)) for v in range(5) for _ in range(200)]
    want = []
    for v in range(5):
        last = None
        for i in sorted({i for w, i in rows if w == v}):
            if last is None or i - last >= 60:
                want.append((v, i))
                last = i
    got = sampling.thinned(spark.createDataFrame(rows, "video int, frame_index int").repartition(7), 60).collect()
    assert sorted(map(tuple, got)) == want


# --- geometry ---


@pytest.mark.parametrize(("size", "want"), [((1920, 1920), (1024, 1024)), ((640, 480), (1024, 768)), ((1920, 1080), (1024, 576)), ((1500, 1000), (1152, 768))])
def test_buckets(spark, size, want):
    assert tuple(values(spark, geometry.nearest_bucket(F.lit(size[0]), F.lit(size[1]), geometry.bucket_sizes()))[0]) == want


def test_grid():
    grid = geometry.bucket_sizes()
    assert len(grid) == 191 and all(w * h <= 1024**2 and w % 64 == h % 64 == 0 for w, h in grid)
    for bad in ({"resolution": 1000}, {"min_bucket": 500}, {"max_bucket": 2000}, {"min_bucket": 1024, "max_bucket": 512}):
        with pytest.raises(ValueError):
            geometry.bucket_sizes(**bad)


def test_overlay_crop(spark):
    box = "array<struct<x:bigint,y:bigint,w:bigint,h:bigint>>"
    rows = [([(10, 10, 100, 30)],), ([(450, 450, 100, 100)],), ([(880, 960, 100, 30)],), ([],)]
    zero, side = F.lit(0).cast("long"), F.lit(1000).cast("long")
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, f"o {box}").select(geometry.crop_around(zero, zero, side, side, F.col("o"))).collect()]
    assert got == [(112, 42, 888, 958), (0, 0, 1000, 1000), (0, 0, 878, 958), (0, 0, 1000, 1000)]


# --- selection ---


def test_backfill(spark):
    gated = spark.createDataFrame([(1, i, float(i % 7)) for i in range(20)] + [(2, 0, 1.0)], "video int, frame_index int, blur double")
    accepted = gated.where("video = 1 and frame_index in (6, 3)")
    got = {tuple(r) for r in selection.backfilled(gated, accepted, 4).collect()}
    assert got == {(1, 3, 3.0, False), (1, 6, 6.0, False), (1, 13, 6.0, True), (1, 5, 5.0, True), (2, 0, 1.0, True)}
    assert selection.backfilled(gated, accepted, 4, max_per_video=2).where("video = 1").count() == 2
    assert selection.reserve_size(0) == 0 and selection.reserve_size(1) == 5 and selection.reserve_size(3) == 9


# --- folds ---


def test_ssim_of_many_is_that_of_pairs():
    rng = np.random.default_rng(1)
    a, others = rng.uniform(0, 255, 50), rng.uniform(0, 255, (6, 50))
    for b, got in zip(others, folds.ssim_to_all(a, others), strict=True):
        cov = ((a - a.mean()) * (b - b.mean())).mean()
        want = ((2 * a.mean() * b.mean() + 6.5025) * (2 * cov + 58.5225)) / ((a.mean() ** 2 + b.mean() ** 2 + 6.5025) * (a.var() + b.var() + 58.5225))
        assert got == pytest.approx(want, abs=1e-6)
    assert folds.ssim_to_all(a, a[None])[0] == pytest.approx(1)


def test_fold(spark):
    rng = np.random.default_rng(2)
    rows = [(v, i, rng.uniform(0, 255, 4).round().tolist(), int(rng.integers(0, 60))) for v in range(3) for i in range(80)]
    got = {(r.video, r.idx): r.reason for r in folds.fold(spark.createDataFrame(rows, "video int, idx int, vec array<double>, hash long").repartition(5), {"vec": folds.Diverse(0.6, 3), "hash": folds.Unseen(1)}, most=9).collect()}
    for v in range(3):
        kept, n = [], 0
        hashes = []
        for _, i, vec, h in (r for r in rows if r[0] == v):
            vec = np.array(vec)
            reason = "max" if n >= 9 else "ssim" if kept and (folds.ssim_to_all(vec, np.array(kept[-3:])) > 0.6).any() else "dup" if any((h ^ x).bit_count() <= 1 for x in hashes) else ""
            if not reason:
                kept.append(vec)
                hashes.append(h)
                n += 1
            assert got[v, i] == reason
    assert {"", "ssim", "dup", "max"} == set(got.values())


# --- near hashes ---


def slow_first_wins(rows, distance, index=()):
    kept = []
    for _, h in sorted(rows):
        kept.append((h, all((h ^ k).bit_count() > distance for k in [*index, *(k for k, won in kept if won)])))
    return [w for _, w in kept]


@pytest.mark.parametrize("distance", [0, 1, 3, 5, 14])
def test_pairs_and_first_wins(spark, distance):
    rng = random.Random(distance)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    hashes = [s ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(distance + 3))}) for s in seeds for _ in range(10)]
    hashes += hashes[:15]
    rng.shuffle(hashes)
    signed = lambda n: n - (n >> 63 << 64)
    frame = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hashes)], "ord long, hash long").repartition(3)
    want = {(i, j, (hashes[i] ^ hashes[j]).bit_count()) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (hashes[i] ^ hashes[j]).bit_count() <= distance}
    for m in {None, 1 if distance < 3 else 4, distance // 2 + 1, distance + 1}:
        pairs = [tuple(r) for r in near_hash.near_pairs(frame, distance, segments=m).collect()]
        assert set(pairs) == want and len(pairs) == len(want)
    got = [r.kept for r in near_hash.first_wins(frame, distance).orderBy("ord").collect()]
    assert got == slow_first_wins(list(enumerate(hashes)), distance)
    got = [r.kept for r in near_hash.first_wins(frame, distance, local=4).orderBy("ord").collect()]  # components, and rounds in the larger ones
    assert got == slow_first_wins(list(enumerate(hashes)), distance)
    known = hashes[:20]
    index = spark.createDataFrame([(signed(h),) for h in known], "hash long")
    got = [r.kept for r in near_hash.first_wins(frame.where("ord >= 20"), distance, index=index).orderBy("ord").collect()]
    assert got == slow_first_wins(list(enumerate(hashes))[20:], distance, known)


def test_segments_cover_all_bits():
    for bits in (16, 36, 64):
        for m in range(1, 13):
            cuts = near_hash.cuts(m, bits)
            assert len(cuts) == m and sum(((1 << w) - 1) << shift for shift, w in cuts) == 2**bits - 1


def test_segments_grow_longer_with_the_rows():
    few, many = near_hash.plan(1000, 5), near_hash.plan(10**9, 5)
    assert few == 6 and many == 2  # 32 bits, of which two may differ
    for n, d in ((10**3, 20), (10**6, 11), (10**3, 64)):
        assert 1 <= near_hash.plan(n, d) <= 64


def test_long_chains_are_decided_at_once(spark):
    """Each row is near to the next one only: every second one stays, and no round is needed for each."""
    n = 3000
    code = lambda i: sum(1 << (k % 64) for k in range(i, i + 32))
    signed = lambda x: x - (x >> 63 << 64)
    rows = [(i, signed(code(i % 64) if i < 30 else code(i % 64))) for i in range(30)]
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert sorted(r.ord for r in near_hash._losers(edges).collect()) == list(range(1, n + 1, 2))
    frame = spark.createDataFrame(rows, "ord long, hash long")
    got = [r.kept for r in near_hash.first_wins(frame, 2).orderBy("ord").collect()]
    assert got == slow_first_wins([(i, h & 2**64 - 1) for i, h in rows], 2)


# --- tags ---

VOCABULARY = [(0, "1girl", 0), (1, "long_hair", 0), (2, "^_^", 0), (3, "hatsune_miku", 4), (4, "vocaloid", 3), (5, "general", 9), (6, "sensitive", 9)]
PROBS = [0.90, 0.40, 0.20, 0.95, 0.50, 0.80, 0.10]


@pytest.fixture(scope="module")
def scores(spark):
    images = spark.createDataFrame([("a", PROBS), ("b", [float("nan"), 0.35, 2.0, 0.85, 0.0, 0.3, 0.3, 0.9]), ("c", [0.0] * 7)], "image string, probs array<double>")
    return images, tagging.scored(images, spark.createDataFrame(VOCABULARY, "idx int, name string, category int"))


def test_picking(scores):
    images, s = scores
    got = {i: [r["name"] for r in sorted(tagging.ranked(tagging.picked(s)).collect(), key=lambda r: r.place) if r.image == i] for i in "abc"}
    assert got == {"a": ["hatsune_miku", "1girl", "long_hair"], "b": ["hatsune_miku", "^_^", "long_hair"], "c": []}
    assert {r.image: r.rating for r in tagging.ratings(s).collect()} == {"a": "general", "b": "general", "c": "general"}


def test_captions(scores):
    images, s = scores
    tags, names = tagging.picked(s), images.select("image")
    got = lambda **k: {r.image: r.caption for r in tagging.captions(tagging.caption_tokens(names, tags, **k)).collect()}
    assert got(trigger="mychar")["a"] == "mychar, hatsune miku, 1girl, long hair"
    assert got(trigger=" my\nchar  v1 ")["c"] == "my char v1" and "c" not in got()
    assert got(trigger="mychar", always=["anime screencap"], drop=["Long Hair"])["a"] == "mychar, anime screencap, hatsune miku, 1girl"
    pruned = tagging.constant_tokens(names.where("image <> 'c'"), tags, 0.9)
    assert {r.token for r in pruned.collect()} == {"hatsune miku", "long hair"}
    assert got(pruned=pruned) == {"a": "1girl", "b": "^_^"}
    assert tagging.constant_tokens(names, tags, 0.0).count() == 0


def test_accepting(scores):
    images, s = scores
    names = images.select("image")
    keep = lambda **k: sorted(r.image for r in tagging.accepted(names, tagging.picked(s), **k).collect())
    assert keep() == ["a", "b", "c"] and keep(require=["Long Hair"]) == ["a", "b"] and keep(exclude=["1girl"]) == ["b", "c"] and keep(require=["1girl"], exclude=["hatsune miku"]) == []


def test_text(spark):
    assert text.parse_tags("long_hair, Long Hair, , watermark") == ["long hair", "watermark"]
    assert values(spark, text.parse_tag_list(F.lit("long_hair, Long  Hair, , ^_^")))[0] == ["long hair", "^_^"]
    stems = {"a/b: c?.mp4": "ab_c.mp4", "  x\t y ": "x_y", "é": "é", "..a_": "a"}
    for name, want in stems.items():
        assert values(spark, text.sanitize_stem(F.lit(name)))[0] == want
    odd = values(spark, text.sanitize_stem(F.lit("???")), text.sanitize_stem(F.lit("x" * 200)))
    assert odd[0].startswith("video_") and len(odd[0]) == 14 and len(odd[1]) == 80
    assert values(spark, text.file_stem(F.lit("/a/b.c.mp4")), text.file_stem(F.lit(".hidden")), text.escape_html(F.lit("<a&'\">")))[:] == ("b.c", ".hidden", "&lt;a&amp;&#x27;&quot;&gt;")
    newer = [values(spark, text.is_newer(F.lit(a), F.lit("1.9.2")))[0] for a in ("v1.10", "1.9.2", "1.9.10-beta", "0.9", "v2")]
    assert newer == [True, False, True, False, True]


# --- reports ---


def test_histogram(spark):
    frame = spark.createDataFrame([(0.0,), (1.0,), (11.9,), (12.0,), (None,)], "blur double")
    got = reports.histogram(frame).orderBy("bin").collect()
    assert [r.n for r in got] == [1, 1] + [0] * 9 + [2] and got[0].low == 0 and got[-1].high == 12
    same = reports.histogram(spark.createDataFrame([(3.0,), (3.0,)], "blur double")).collect()
    assert [tuple(r) for r in same] == [(0, 3.0, 3.0, 2)]
    assert reports.histogram(frame.where("false")).collect() == []


def test_scenes(spark):
    content = [0, 0, 0, 200, 200, 0, 0]  # at every fifth frame
    rows = [(1, 5 * k + j, float(c if j == 0 else 99), (5 * k + j) / 10) for k, c in enumerate(content) for j in range(5)]
    got = sampling.scenes(spark.createDataFrame(rows, "video int, frame_index int, luma double, t double"), 100).orderBy("scene").collect()
    assert [(r.start_frame, r.end_frame) for r in got] == [(0, 15), (15, 25), (25, 35)]
    assert all(a.end_time == b.start_time for a, b in pairwise(got))


def test_run_can_be_watched(spark):
    from sievewright.plans import running

    with running.run_named(spark, "watched"):
        spark.range(100, numPartitions=3).selectExpr("sum(id)").collect()
    done, known = running.progress(spark, "watched")
    assert 0 <= done <= known  # stages that are skipped stay undone
    running.stop(spark, "watched")
