"""A query for each operator over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text, vectors
from ..operators import folds, geometry, near_hash, overlays, quality, reports, sampling, selection, tagging
from ..sources.tables import SQL, frames, hash_rows, patterned_frames, size_rows, stream_table, table, vector_rows
from . import extract

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _gated(spark: SparkSession, sf_dir: str, blur: float = 100.0) -> DataFrame:
    f = frames(spark, sf_dir)
    return f.withColumn("reason", quality.gate_reason(F.col("blur"), F.col("luma"), F.col("contrast"), blur))


_REASON = """CASE WHEN blur < {b} THEN 'blur' WHEN luma < 15 THEN 'too dark' WHEN luma > 245 THEN 'too bright' WHEN contrast < 10 THEN 'low contrast' ELSE '' END"""
_GATED = f"{SQL['frames']}, gated AS (SELECT *, {_REASON.format(b=100)} AS reason FROM frames)"


# --- gates --------------------------------------------------------------------------------------------


@query(f"WITH {_GATED} SELECT video, frame_index, reason, reason = '' AS passed FROM gated")
def quality_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("video", "frame_index", "reason", (F.col("reason") == "").alias("passed"))


@query(
    f"""WITH {_GATED} SELECT video, frame_index, CASE reason WHEN 'blur' THEN printf('blur %.1f < 100.0', round(blur, 1)) WHEN 'low contrast' THEN printf('low contrast (%.1f)', contrast)
    WHEN '' THEN '' ELSE reason || printf(' (%.1f)', luma) END AS message FROM gated"""
)
def gate_messages(spark, sf_dir):
    g = _gated(spark, sf_dir)
    return g.select("video", "frame_index", quality.gate_message(F.col("reason"), F.col("blur"), F.col("luma"), F.col("contrast"), F.lit(100.0)).alias("message"))


_COUNTERS = "count(*) AS candidates, count(*) FILTER (reason = '') AS passed, count(*) FILTER (reason = 'blur') AS rejected_blur, count(*) FILTER (reason NOT IN ('', 'blur')) AS rejected_luma"


@query(f"WITH {_GATED} SELECT video, {_COUNTERS} FROM gated GROUP BY video")
def reject_counters(spark, sf_dir):
    return quality.reject_counters(_gated(spark, sf_dir))


@query(f"WITH {_GATED} SELECT video, {_COUNTERS} FROM gated GROUP BY ROLLUP (video)")
def run_rollup(spark, sf_dir):
    return quality.run_totals(_gated(spark, sf_dir))


@query(f"WITH {_GATED}, c AS (SELECT video, {_COUNTERS} FROM gated GROUP BY video) SELECT video, passed + rejected_blur + rejected_luma AS candidates, round(passed * 100.0 / greatest(1, candidates), 4) AS acceptance FROM c")
def acceptance_rate(spark, sf_dir):
    c = quality.reject_counters(_gated(spark, sf_dir))
    total = F.col("passed") + F.col("rejected_blur") + F.col("rejected_luma")
    return c.select("video", total.alias("candidates"), F.round(reports.acceptance(F.col("passed"), F.col("candidates")), 4).alias("acceptance"))


_AUTO = f"""{SQL['frames']}, ranked AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY md5(video || ':' || frame_index), frame_index) AS r FROM frames),
auto AS (SELECT video, count(*) AS n_frames, CASE WHEN count(*) < 10 THEN 50.0::DOUBLE ELSE quantile_cont(blur, 0.4) FILTER (r <= 50) END AS threshold FROM ranked GROUP BY video)"""


@query(f"WITH {_AUTO} SELECT video, n_frames, round(threshold, 4) AS threshold FROM auto")
def auto_blur_threshold(spark, sf_dir):
    return quality.auto_threshold(frames(spark, sf_dir)).withColumn("threshold", F.round("threshold", 4))


@query(f"WITH {_AUTO} SELECT video, frame_index, {_REASON.format(b='threshold')} AS reason FROM frames JOIN auto USING (video)")
def auto_gated_frames(spark, sf_dir):
    f = frames(spark, sf_dir)
    joined = f.join(quality.auto_threshold(f).select("video", "threshold"), "video")
    return joined.select("video", "frame_index", quality.gate_reason(F.col("blur"), F.col("luma"), F.col("contrast"), F.col("threshold")).alias("reason"))


_SEGMENTS = "segments AS (SELECT n_nationkey::BIGINT AS video, a AS start, b AS stop FROM nation, (VALUES (1e5::DOUBLE, 9e5::DOUBLE), (3e6::DOUBLE, 2e6::DOUBLE)) AS s(a, b) WHERE n_nationkey % 2 = 0)"


@query(f"WITH {SQL['frames']}, {_SEGMENTS} SELECT video, frame_index FROM frames f WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.video = f.video) OR EXISTS (SELECT 1 FROM segments s WHERE s.video = f.video AND t BETWEEN least(start, stop) AND greatest(start, stop))")
def segment_filter(spark, sf_dir):
    both = F.explode(F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in ((1e5, 9e5), (3e6, 2e6))))).alias("s")
    segments = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("video"), both).select("video", "s.*")
    return quality.in_segments(frames(spark, sf_dir), segments).select("video", "frame_index")


@query("SELECT c_custkey AS video FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey % 7 = 0)")
def resume_anti(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("video"))
    return quality.pending(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video")), done)


# --- sampling -----------------------------------------------------------------------------------------

_SCENES = f"""{SQL['frames']}, seen AS (SELECT * FROM (SELECT *, max(frame_index) OVER (PARTITION BY video) + 1 AS n, max(t) OVER (PARTITION BY video) AS last FROM frames) WHERE frame_index % 5 = 0),
jumps AS (SELECT *, coalesce((abs(luma - lag(luma) OVER (PARTITION BY video ORDER BY frame_index)) >= 90)::INT, 0) AS cut FROM seen),
numbered AS (SELECT *, sum(cut) OVER (PARTITION BY video ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS scene FROM jumps),
starts AS (SELECT video, scene::BIGINT AS scene, min(frame_index) AS f, min(t) AS start_time, max(n) AS n, max(last) AS last FROM numbered GROUP BY ALL),
scenes AS (SELECT video, scene, CASE WHEN scene = 0 THEN 0 ELSE f END AS start_frame, coalesce(lead(f) OVER w, n) AS end_frame, start_time, coalesce(lead(start_time) OVER w, last) AS end_time FROM starts WINDOW w AS (PARTITION BY video ORDER BY scene))"""


def _scenes(spark, sf_dir):
    return sampling.scenes(frames(spark, sf_dir), threshold=90)


@query(f"WITH {_SCENES} SELECT video, scene, start_frame, end_frame, round(start_time, 4) AS start_time, round(end_time, 4) AS end_time FROM scenes")
def scene_islands(spark, sf_dir):
    return _scenes(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("start_time", "end_time")})


@query(
    f"""WITH RECURSIVE {SQL['frames']}, cuts AS (SELECT video, frame_index FROM frames WHERE frame_index = 0 OR luma >= 200),
    kept AS (SELECT video, min(frame_index) AS frame_index FROM cuts GROUP BY video UNION ALL
      SELECT k.video, (SELECT min(c.frame_index) FROM cuts c WHERE c.video = k.video AND c.frame_index >= k.frame_index + 15) FROM kept k WHERE k.frame_index IS NOT NULL),
    n AS (SELECT video, max(frame_index) + 1 AS n FROM frames GROUP BY video)
    SELECT video, row_number() OVER w - 1 AS scene, frame_index AS start_frame, coalesce(lead(frame_index) OVER w, n) AS end_frame FROM kept JOIN n USING (video) WHERE frame_index IS NOT NULL WINDOW w AS (PARTITION BY video ORDER BY frame_index)"""
)
def scene_cuts(spark, sf_dir):
    """As the run does it: the difference is a column, and a scene has fifteen frames at least."""
    cut = sampling.scenes(frames(spark, sf_dir), 200, skip=0, delta="luma", least=15)
    return cut.select("video", "scene", "start_frame", "end_frame")


_PICK = """SELECT DISTINCT video, i AS frame_index FROM (
  SELECT video, unnest(CASE WHEN n <= 1 THEN [a] WHEN k <= 1 THEN [(a + b) // 2]
    ELSE list_transform(range(0, k), lambda j: round_even(lo + j * ((hi - lo) / greatest(k - 1, 1)), 0)::BIGINT) END) AS i FROM (
    SELECT *, CASE WHEN b - m > a + m THEN a + m ELSE a END AS lo, CASE WHEN b - m > a + m THEN b - m ELSE b END AS hi FROM (
      SELECT *, greatest(1, n // 10) AS m FROM (
        SELECT video, start_frame AS a, end_frame AS b, greatest(1, end_frame - start_frame) AS n, {k} AS k FROM scenes))))"""


@query(f"WITH {_SCENES} {_PICK.format(k='5')}")
def scene_sample(spark, sf_dir):
    return sampling.sampled(_scenes(spark, sf_dir), per_scene=5)


@query(f"WITH {_SCENES} {_PICK.format(k='greatest(2, floor((end_time - start_time) / 200000)::INT)')}")
def hybrid_sample(spark, sf_dir):
    return sampling.sampled(_scenes(spark, sf_dir), per_scene=2, interval_seconds=200_000)


_VIDEOS = "videos AS (SELECT c_custkey AS video, (c_custkey % 4) * 7.5 AS fps, c_custkey * 13 % 400 AS frame_count FROM customer)"


@query(f"WITH {_VIDEOS} SELECT video, unnest(range(0, frame_count, greatest(1, floor(2.0 * fps)::BIGINT))) AS frame_index FROM videos WHERE fps > 0 AND frame_count > 0")
def interval_sample(spark, sf_dir):
    k = F.col("c_custkey")
    videos = table(spark, sf_dir, "customer").select(k.alias("video"), ((k % 4) * 7.5).alias("fps"), (k * 13 % 400).alias("frame_count"))
    return sampling.at_intervals(videos, 2.0)


@query(
    """WITH RECURSIVE pts AS (SELECT DISTINCT user_id AS video, event_id AS frame_index FROM events),
    kept AS (SELECT video, min(frame_index) AS frame_index FROM pts GROUP BY video UNION ALL
      SELECT k.video, (SELECT min(p.frame_index) FROM pts p WHERE p.video = k.video AND p.frame_index >= k.frame_index + 300) FROM kept k WHERE k.frame_index IS NOT NULL)
    SELECT video, frame_index FROM kept WHERE frame_index IS NOT NULL"""
)
def gop_thin(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("frame_index"))
    return sampling.thinned(e, 300)


@query(f"WITH {SQL['frames']} SELECT video, frame_index FROM frames QUALIFY row_number() OVER (PARTITION BY video ORDER BY frame_index) <= 20")
def keyframe_cap(spark, sf_dir):
    return sampling.first_frames(frames(spark, sf_dir), 20).select("video", "frame_index")


@query("""WITH v AS (SELECT c_custkey AS video, c_custkey * 13 % 400 AS n FROM customer)
    SELECT video, i * greatest(1, n // 8) AS frame_index FROM v, range(8) r(i) WHERE n >= 5 AND i * greatest(1, n // 8) < n""")
def overlay_sample(spark, sf_dir):
    k = F.col("c_custkey")
    return sampling.even_sample(table(spark, sf_dir, "customer").select(k.alias("video"), (k * 13 % 400).alias("frame_count")), 8)


@query("""WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Video: none' ELSE 'Video: h264, yuv420p, ' || (p_partkey % 3000) || 'x' || (p_size * 20) || ', 30 fps' END AS line FROM part)
    SELECT p_partkey, coalesce(try_cast(regexp_extract(line, '(\\d{2,5})x(\\d{2,5})', 1) AS INT), 0) AS w, coalesce(try_cast(regexp_extract(line, '(\\d{2,5})x(\\d{2,5})', 2) AS INT), 0) AS h FROM l""")
def probe_resolution(spark, sf_dir):
    k = F.col("p_partkey")
    line = F.when(k % 4 == 0, "Video: none").otherwise(F.concat(F.lit("Video: h264, yuv420p, "), (k % 3000).cast("string"), F.lit("x"), (F.col("p_size") * 20).cast("string"), F.lit(", 30 fps")))
    return table(spark, sf_dir, "part").select("p_partkey", sampling.probed_size(line).alias("s")).select("p_partkey", "s.w", "s.h")


@query(f"""WITH {SQL['frames']}, asked AS (SELECT n_nationkey::BIGINT AS video, 1e5::DOUBLE * i AS t FROM nation, range(40) r(i))
    SELECT a.video, a.t, f.frame_index FROM asked a ASOF JOIN (SELECT video, t, min(frame_index) AS frame_index FROM frames GROUP BY ALL) f ON a.video = f.video AND a.t <= f.t""")
def frames_at_times(spark, sf_dir):
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("video"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: i * F.lit(1e5))).alias("t"))
    return sampling.at_times(frames(spark, sf_dir), asked)


@query(f"""WITH {SQL['frames']}, m AS (SELECT video, max(frame_index) AS l, arg_max(t, frame_index) - arg_min(t, frame_index) AS span FROM frames GROUP BY video)
    SELECT video, round(CASE WHEN span > 0 THEN l / span ELSE 0 END * 1e6, 4) AS fps, l + 1 AS frame_count FROM m""")
def video_meta(spark, sf_dir):
    f = frames(spark, sf_dir).withColumns({"width": F.lit(16), "height": F.lit(9)})
    return sampling.video_meta(f).select("video", F.round(F.col("fps") * 1e6, 4).alias("fps"), "frame_count")


@query(
    """WITH i AS (SELECT p_partkey::VARCHAR AS path FROM part WHERE p_partkey % 9 <> 0), r AS (SELECT p_partkey::VARCHAR AS path, p_retailprice AS blur, p_size * 64 AS bw, p_partkey AS f, p_brand AS v FROM part WHERE p_partkey % 2 = 0),
    t AS (SELECT p_partkey::VARCHAR AS path, p_type AS a, p_name AS b FROM part WHERE p_partkey % 3 = 0)
    SELECT i.path, concat_ws(chr(10), printf('blur %.1f', round(blur, 1)), 'bucket ' || bw || 'x512', 'frame #' || f, 'src: ' || v, 'tags: ' || a || ', ' || b) AS hover FROM i LEFT JOIN r USING (path) LEFT JOIN t USING (path)"""
)
def gallery_rows(spark, sf_dir):
    p, path = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string").alias("path")
    records = p.where("p_partkey % 2 = 0").select(path, F.col("p_retailprice").alias("blur"), (F.col("p_size") * 64).alias("bucket_w"), F.lit(512).alias("bucket_h"), F.col("p_partkey").alias("frame_index"), F.col("p_brand").alias("video"))
    tags = p.where("p_partkey % 3 = 0").select(path, F.array("p_type", "p_name").alias("tokens"))
    return reports.gallery_rows(p.select(path), records, tags, p.where("p_partkey % 9 = 0").select(path))


# --- buckets and geometry -----------------------------------------------------------------------------

_GRID = "grid AS (SELECT w.r AS bucket_w, h.r AS bucket_h FROM range(512, 2049, 64) w(r), range(512, 2049, 64) h(r) WHERE w.r * h.r <= 1024 * 1024)"
_BUCKETED = f"""{SQL['sizes']}, {_GRID}, best AS (SELECT w, h, arg_min({{'bw': bucket_w, 'bh': bucket_h}}, (abs(bucket_w / bucket_h - w / h), -bucket_w * bucket_h, bucket_w, bucket_h)) AS b
  FROM (SELECT DISTINCT w, h FROM sizes), grid GROUP BY w, h),
bucketed AS (SELECT l_orderkey, l_linenumber, w, h, b.bw AS bucket_w, b.bh AS bucket_h FROM sizes JOIN best USING (w, h))"""


def _bucketed(spark, sf_dir):
    return geometry.with_bucket(size_rows(spark, sf_dir), geometry.bucket_sizes())


@query(f"WITH {_GRID} SELECT bucket_w, bucket_h FROM grid")
def bucket_grid(spark, sf_dir):
    return geometry.bucket_grid(spark)


@query(f"WITH {_BUCKETED} SELECT l_orderkey, l_linenumber, bucket_w, bucket_h FROM bucketed")
def bucket_assign(spark, sf_dir):
    return _bucketed(spark, sf_dir).select("l_orderkey", "l_linenumber", "bucket_w", "bucket_h")


@query(f"WITH {_BUCKETED} SELECT bucket_w || 'x' || bucket_h AS bucket, count(*) AS n FROM bucketed GROUP BY ALL")
def bucket_histogram(spark, sf_dir):
    return reports.bucket_histogram(_bucketed(spark, sf_dir))


@query(f"WITH {_BUCKETED} SELECT l_orderkey, l_linenumber FROM bucketed WHERE bucket_w * bucket_h >= 500000")
def min_pixels_gate(spark, sf_dir):
    return geometry.enough_pixels(_bucketed(spark, sf_dir)).select("l_orderkey", "l_linenumber")


def _geometry(spark, sf_dir, columns):
    s = size_rows(spark, sf_dir)
    return s.select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in columns(F.col("w"), F.col("h")).items()))


@query(
    f"""WITH {SQL['sizes']}, c AS (SELECT *, w / h > 1152 / 896 AS wide FROM sizes), d AS (SELECT *, CASE WHEN wide THEN round_even(896 * (w / h), 0)::BIGINT ELSE 1152 END AS new_w, CASE WHEN wide THEN 896 ELSE round_even(1152 / (w / h), 0)::BIGINT END AS new_h FROM c)
    SELECT l_orderkey, l_linenumber, new_w, new_h, floor((new_w - 1152) / 2)::BIGINT AS x, floor((new_h - 896) / 2)::BIGINT AS y, new_w < w OR new_h < h AS shrinks FROM d"""
)
def cover_geometry(spark, sf_dir):
    return _geometry(spark, sf_dir, lambda w, h: geometry.cover(w, h, F.lit(1152), F.lit(896)))


@query(
    f"""WITH {SQL['sizes']}, c AS (SELECT *, least(1152 / w, 896 / h) AS s FROM sizes), d AS (SELECT *, greatest(1, round_even(w * s, 0)::BIGINT) AS new_w, greatest(1, round_even(h * s, 0)::BIGINT) AS new_h FROM c)
    SELECT l_orderkey, l_linenumber, new_w, new_h, floor((1152 - new_w) / 2)::BIGINT AS x, floor((896 - new_h) / 2)::BIGINT AS y FROM d"""
)
def contain_geometry(spark, sf_dir):
    return _geometry(spark, sf_dir, lambda w, h: geometry.contain(w, h, F.lit(1152), F.lit(896)))


@query(
    f"""WITH {SQL['sizes']} SELECT l_orderkey, l_linenumber, CASE WHEN greatest(w, h) = 1024 THEN w ELSE greatest(1, round_even(w * (1024.0::DOUBLE / greatest(w, h)), 0)::BIGINT) END AS new_w,
    CASE WHEN greatest(w, h) = 1024 THEN h ELSE greatest(1, round_even(h * (1024.0::DOUBLE / greatest(w, h)), 0)::BIGINT) END AS new_h FROM sizes"""
)
def longest_geometry(spark, sf_dir):
    return _geometry(spark, sf_dir, lambda w, h: geometry.longest(w, h, 1024))


_BOXES = """boxes AS (SELECT l_orderkey, l_linenumber, l_partkey * 7 % 1800 AS x, l_suppkey * 11 % 1000 AS y, 30 + l_partkey % 170 AS w, 10 + l_suppkey % 90 AS h,
  (l_orderkey % 50) / 100.0::DOUBLE AS edge, (l_partkey % 5) / 100.0::DOUBLE AS static, (l_partkey % 100) / 100.0::DOUBLE AS bimodal FROM lineitem)"""


def _boxes(spark, sf_dir):
    p, s, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (p * 7 % 1800).alias("x"), (s * 11 % 1000).alias("y"), (30 + p % 170).alias("w"), (10 + s % 90).alias("h"),
        ((o % 50) / 100.0).alias("edge"), ((p % 5) / 100.0).alias("static"), ((p % 100) / 100.0).alias("bimodal"),
    )


@query(
    f"""WITH {_BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y) AS r FROM boxes), p AS (SELECT *,
      x + w / 2 < 384 OR x + w / 2 > 1920 - 384 OR y + h / 2 < 216 OR y + h / 2 > 1080 - 216 AS cut FROM o),
    e AS (SELECT l_orderkey, greatest(0, max(x + w + 2) FILTER (cut AND x < 960)) AS x0, greatest(0, max(y + h + 2) FILTER (cut AND y < 540)) AS y0,
      least(1920, min(x - 2) FILTER (cut AND x >= 960)) AS x1, least(1080, min(y - 2) FILTER (cut AND y >= 540)) AS y1 FROM p GROUP BY l_orderkey)
    SELECT l_orderkey, x0 AS x, y0 AS y, greatest(1, x1 - x0) AS w, greatest(1, y1 - y0) AS h FROM e"""
)
def wm_crop_expand(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    around = b.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "x", "y", "w", "h"))).alias("o"))
    zero = F.lit(0).cast("long")
    cut = geometry.crop_around(zero, zero, F.lit(1920).cast("long"), F.lit(1080).cast("long"), F.col("o"))
    return around.select("l_orderkey", cut.alias("c")).select("l_orderkey", "c.*")


@query(
    f"""WITH {_BOXES} SELECT l_orderkey, l_linenumber, CASE WHEN y + h / 2 < 1080 * 0.35 THEN 'top' WHEN y + h / 2 > 1080 * 0.65 THEN 'bottom' ELSE 'middle' END || '-' ||
    CASE WHEN x + w / 2 < 1920 * 0.35 THEN 'left' WHEN x + w / 2 > 1920 * 0.65 THEN 'right' ELSE 'center' END AS location FROM boxes"""
)
def wm_classify(spark, sf_dir):
    where = geometry.position(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(1920), F.lit(1080))
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", where.alias("location"))


_CONFIDENT = f"""{_BOXES}, c AS (SELECT *, least(1.0::DOUBLE, edge * 6.0::DOUBLE) * least(1.0::DOUBLE, w / greatest(1.0::DOUBLE, h * 1.5::DOUBLE)) * least(1.0::DOUBLE, bimodal * 1.5::DOUBLE) AS confidence FROM boxes
  WHERE w * h >= 800 AND w * h <= 1920 * 1080 * 0.04 AND w >= 30 AND h >= 10 AND (y + h / 2 < 1080 * 0.12 OR y + h / 2 > 1080 - 1080 * 0.12 OR x + w / 2 < 1920 * 0.12 OR x + w / 2 > 1920 - 1920 * 0.12)
    AND edge >= 0.02 AND edge <= 0.40 AND static >= 0.01 AND bimodal >= 0.45)"""


def _confident(spark, sf_dir):
    regions = _boxes(spark, sf_dir).withColumns({"frame_w": F.lit(1920), "frame_h": F.lit(1080)})
    return overlays.confident(regions, "l_orderkey", "l_linenumber", "x", "y")


@query(f"WITH {_CONFIDENT} SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY confidence DESC, l_linenumber, x, y) AS rank, x, y, round(confidence, 4) AS confidence FROM c WHERE confidence >= 0.6 QUALIFY rank <= 3")
def wm_confidence_top3(spark, sf_dir):
    return _confident(spark, sf_dir).select("l_orderkey", F.col("rank").cast("long").alias("rank"), "x", "y", F.round("confidence", 4).alias("confidence"))


@query(f"WITH {_CONFIDENT} SELECT l_orderkey AS video, x, y, w, h FROM c WHERE confidence >= 0.6 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY confidence DESC, l_linenumber, x, y) <= 3")
def wm_report_rows(spark, sf_dir):
    videos = _confident(spark, sf_dir).groupBy(F.col("l_orderkey").alias("video")).agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("watermarks"))
    return reports.overlay_rows(videos)


@query(f"WITH {SQL['frames']} SELECT video, event_id % 16 AS cell, round(stddev_pop(contrast), 4) AS spread, round(avg(contrast), 4) AS mean FROM frames GROUP BY ALL HAVING round(stddev_pop(contrast), 6) < 8.0")
def static_groups(spark, sf_dir):
    cells = frames(spark, sf_dir).groupBy("video", (F.col("event_id") % 16).alias("cell")).agg(F.stddev_pop("contrast").alias("spread"), F.avg("contrast").alias("mean"))
    return cells.where("round(spread, 6) < 8.0").select("video", "cell", F.round("spread", 4).alias("spread"), F.round("mean", 4).alias("mean"))


# --- selection ----------------------------------------------------------------------------------------


@query(f"WITH {_GATED} SELECT video, frame_index, blur FROM gated WHERE reason = '' QUALIFY row_number() OVER (PARTITION BY video ORDER BY blur DESC, frame_index) <= 9")
def blur_topk(spark, sf_dir):
    return selection.reserve(_gated(spark, sf_dir).where("reason = ''"), selection.reserve_size(3)).select("video", "frame_index", "blur")


@query(
    f"""WITH {_GATED}, ok AS (SELECT * FROM gated WHERE reason = ''), acc AS (SELECT * FROM ok WHERE event_id % 11 = 0), pool AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY video ORDER BY blur DESC, frame_index) <= 24),
    more AS (SELECT p.*, row_number() OVER (PARTITION BY p.video ORDER BY blur DESC, frame_index) AS r FROM pool p WHERE event_id % 11 <> 0)
    SELECT video, frame_index, blur, FALSE AS backfilled FROM acc UNION ALL
    SELECT m.video, m.frame_index, m.blur, TRUE FROM more m LEFT JOIN (SELECT video, count(*) AS n FROM acc GROUP BY video) a USING (video) WHERE r <= 8 - coalesce(n, 0)"""
)
def backfill_min(spark, sf_dir):
    ok = _gated(spark, sf_dir).where("reason = ''")
    return selection.backfilled(ok, ok.where("event_id % 11 = 0"), 8)


@query(f"WITH {_GATED} SELECT video, frame_index FROM gated WHERE reason = '' QUALIFY row_number() OVER (PARTITION BY video ORDER BY frame_index) <= 5")
def max_per_video(spark, sf_dir):
    return selection.capped(_gated(spark, sf_dir).where("reason = ''"), 5).select("video", "frame_index")


@query(f"WITH {_GATED} SELECT video, frame_index, video * 100000 + row_number() OVER (PARTITION BY video ORDER BY frame_index) AS seq FROM gated WHERE reason = ''")
def seq_numbering(spark, sf_dir):
    return selection.sequence_numbers(_gated(spark, sf_dir).where("reason = ''"), "video").select("video", "frame_index", "seq")


# --- vectors and hashes -------------------------------------------------------------------------------

_MOMENTS = "moments AS (SELECT video, idx, v, list_sum(v) / 64 AS m, list_inner_product(v, v) / 64 - (list_sum(v) / 64) ** 2 AS q FROM (SELECT video, idx, list_transform(vec, lambda x: 127.5 + 127.5 * x) AS v FROM vecs))"
_SSIM = "((2 * a.m * b.m + 6.5025) * (2 * (list_inner_product(a.v, b.v) / 64 - a.m * b.m) + 58.5225)) / ((a.m * a.m + b.m * b.m + 6.5025) * (a.q + b.q + 58.5225))"
_HISTS = "hists AS (SELECT video, idx, list_transform(vec, lambda x: abs(x) / list_sum(list_transform(vec, lambda y: abs(y)))) AS v FROM vecs)"
_CHI = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: CASE WHEN z[1] + z[2] > 0 THEN (z[1] - z[2]) ** 2 / (z[1] + z[2]) ELSE 0 END))"


def _neighbours(rows: DataFrame, column: str) -> DataFrame:
    order = Window.partitionBy("video").orderBy("idx")
    return rows.select("video", "idx", F.col(column).alias("a"), F.lead(column).over(order).alias("b")).where("b is not null")


@query(f"WITH {SQL['vecs']}, {_MOMENTS} SELECT a.video, a.idx, round({_SSIM}, 4) AS ssim FROM moments a JOIN (SELECT *, lag(idx) OVER (PARTITION BY video ORDER BY idx) AS before FROM moments) b ON a.video = b.video AND a.idx = b.before")
def ssim_pairs(spark, sf_dir):
    rows = vector_rows(spark, sf_dir).withColumn("vec", vectors.as_grey(F.col("vec")))
    return _neighbours(rows, "vec").select("video", "idx", F.round(vectors.ssim(F.col("a"), F.col("b")), 4).alias("ssim"))


@query(f"WITH {SQL['vecs']}, {_HISTS} SELECT a.video, a.idx, round({_CHI}, 4) AS distance FROM hists a JOIN (SELECT *, lag(idx) OVER (PARTITION BY video ORDER BY idx) AS before FROM hists) b ON a.video = b.video AND a.idx = b.before")
def chi2_pairs(spark, sf_dir):
    rows = vector_rows(spark, sf_dir).withColumn("vec", vectors.histogram(F.col("vec")))
    return _neighbours(rows, "vec").select("video", "idx", F.round(vectors.chi_squared(F.col("a"), F.col("b")), 4).alias("distance"))


_STATE = "struct_pack(v := {v}, m := {m}, q := {q})"
_GREEDY = """WITH RECURSIVE {views}, n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY idx) AS r FROM {rows}),
walk AS (SELECT video, idx, r, TRUE AS accepted, [{state}] AS state FROM n b WHERE r = 1 UNION ALL
  SELECT video, idx, r, ok, CASE WHEN ok THEN list_slice(list_append(before, own), -{k}, -1) ELSE before END FROM (
    SELECT b.video, b.idx, b.r, w.state AS before, {state} AS own, coalesce({test}, TRUE) AS ok FROM walk w JOIN n b ON b.video = w.video AND b.r = w.r + 1))
SELECT video, idx, accepted FROM walk"""


@query(_GREEDY.format(views=f"{SQL['vecs']}, {_MOMENTS}", rows="moments", state="struct_pack(v := b.v, m := b.m, q := b.q)", k=20, test=f"list_max(list_transform(w.state, lambda a: {_SSIM})) <= 0.20"))
def ssim_greedy_last20(spark, sf_dir):
    rows = vector_rows(spark, sf_dir).withColumn("vec", vectors.as_grey(F.col("vec")))
    return folds.fold(rows, {"vec": folds.Diverse(0.20, 20)}).select("video", "idx", (F.col("reason") == "").alias("accepted"))


@query(_GREEDY.format(views=f"{SQL['vecs']}, {_HISTS}", rows="hists", state="struct_pack(v := b.v)", k=15, test=f"list_min(list_transform(w.state, lambda a: {_CHI})) >= 0.42"))
def color_greedy_last15(spark, sf_dir):
    rows = vector_rows(spark, sf_dir).withColumn("vec", vectors.histogram(F.col("vec")))
    return folds.fold(rows, {"vec": folds.Colourful(0.42, 15)}).select("video", "idx", (F.col("reason") == "").alias("accepted"))


@query(f"WITH {SQL['hashes']} SELECT video, idx, hash FROM hashes")
def phash_bits(spark, sf_dir):
    return hash_rows(spark, sf_dir)


#: Four hashes of each vector, one to ten bits apart: what re-encoded and cropped copies of an image give.
_NEAR = f"""{SQL['hashes']}, flips AS (SELECT idx, hash, 1::BIGINT << (idx % 62) AS f1, xor(1::BIGINT << (idx * 7 % 62), 1::BIGINT << ((idx * 5 + 1) % 62)) AS f2, 15::BIGINT << (idx * 3 % 58) AS f3 FROM hashes),
near AS (SELECT idx * 4 AS idx, hash FROM flips UNION ALL SELECT idx * 4 + 1, xor(hash, f1) FROM flips UNION ALL SELECT idx * 4 + 2, xor(hash, xor(f1, f2)) FROM flips UNION ALL SELECT idx * 4 + 3, xor(hash, xor(f1, xor(f2, f3))) FROM flips)"""
_PAIRS = "SELECT a.idx AS a, b.idx AS b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM near a JOIN near b ON a.idx < b.idx AND bit_count(xor(a.hash, b.hash)) <= {d}"


def _near_hashes(spark, sf_dir):
    h, i = hash_rows(spark, sf_dir), F.col("idx")
    bit = lambda base, at: F.call_function("shiftleft", F.lit(base).cast("long"), at.cast("int"))
    f1, f2, f3 = bit(1, i % 62), bit(1, i * 7 % 62).bitwiseXOR(bit(1, (i * 5 + 1) % 62)), bit(15, i * 3 % 58)
    flips = F.array(F.lit(0).cast("long"), f1, f1.bitwiseXOR(f2), f1.bitwiseXOR(f2).bitwiseXOR(f3))
    return h.select("idx", "hash", F.posexplode(flips).alias("k", "f")).select((i * 4 + F.col("k")).alias("idx"), F.col("hash").bitwiseXOR(F.col("f")).alias("hash"))


@query(f"WITH {_NEAR} {_PAIRS.format(d=5)}")
def hamming_pairs(spark, sf_dir):
    return near_hash.near_pairs(_near_hashes(spark, sf_dir), 5, order="idx")


@query(f"WITH {_NEAR} {_PAIRS.format(d=12)}")
def hamming_pairs_wide(spark, sf_dir):
    return near_hash.near_pairs(_near_hashes(spark, sf_dir), 12, order="idx")


_FIRST = """WITH RECURSIVE {views}, n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY idx) AS r FROM {rows}),
walk AS (SELECT 0::BIGINT AS r, NULL::BIGINT AS idx, NULL::BIGINT AS hash, TRUE AS kept, {seed} AS state UNION ALL
  SELECT b.r, b.idx, b.hash, ok, CASE WHEN ok THEN list_append(state, b.hash) ELSE state END FROM (
    SELECT n.*, w.state, coalesce(list_min(list_transform(w.state, lambda s: bit_count(xor(s, n.hash)))) > {d}, TRUE) AS ok FROM walk w JOIN n ON n.r = w.r + 1) b)
SELECT idx AS ord, hash, kept FROM walk WHERE r > 0"""


@query(_FIRST.format(views=_NEAR, rows="near", seed="[]::BIGINT[]", d=5))
def dedup_greedy(spark, sf_dir):
    return near_hash.first_wins(_near_hashes(spark, sf_dir), 5, order="idx")


@query(_FIRST.format(views=SQL["hashes"], rows="hashes", seed="[]::BIGINT[]", d=16))
def dedup_greedy_wide(spark, sf_dir):
    return near_hash.first_wins(hash_rows(spark, sf_dir), 16, order="idx")


@query(_FIRST.format(views=_NEAR, rows="(SELECT * FROM near WHERE idx % 3 <> 0)", seed="(SELECT list(hash) FROM near WHERE idx % 3 = 0)", d=5))
def dedup_cross_run(spark, sf_dir):
    rows = _near_hashes(spark, sf_dir)
    return near_hash.first_wins(rows.where("idx % 3 <> 0"), 5, order="idx", index=rows.where("idx % 3 = 0"))


@query("SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY md5(text)) AS kept FROM documents")
def exact_text_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "hash").select("doc_id", (F.col("doc_id") == F.col("first")).alias("kept"))


@query(
    f"""WITH RECURSIVE {SQL['hashes']}, {_MOMENTS}, {_HISTS}, n AS (SELECT a.video, a.idx, a.v, a.m, a.q, c.v AS hist, d.hash, row_number() OVER (PARTITION BY a.video ORDER BY a.idx) AS r FROM moments a JOIN hists c USING (video, idx) JOIN hashes d USING (video, idx)),
    walk AS (SELECT video, idx, r, '' AS reason, [struct_pack(v := b.v, m := b.m, q := b.q)] AS s, [struct_pack(v := hist)] AS c, [hash] AS h FROM n b WHERE r = 1 UNION ALL
      SELECT video, idx, r, reason, CASE WHEN reason = '' THEN list_slice(list_append(s, struct_pack(v := v, m := m, q := q)), -20, -1) ELSE s END,
        CASE WHEN reason = '' THEN list_slice(list_append(c, struct_pack(v := hist)), -15, -1) ELSE c END, CASE WHEN reason = '' THEN list_append(h, hash) ELSE h END FROM (
        SELECT b.*, w.s, w.c, w.h, CASE WHEN list_max(list_transform(w.s, lambda a: {_SSIM})) > 0.20 THEN 'ssim'
          WHEN list_min(list_transform(w.c, lambda a: {_CHI.replace('b.v', 'b.hist')})) < 0.40 THEN 'color'
          WHEN list_min(list_transform(w.h, lambda a: bit_count(xor(a, b.hash)))) <= 24 THEN 'dup' ELSE '' END AS reason FROM walk w JOIN n b ON b.video = w.video AND b.r = w.r + 1))
    SELECT video, idx, reason FROM walk"""
)
def full_fold(spark, sf_dir):
    v = vector_rows(spark, sf_dir)
    rows = v.select("video", "idx", vectors.as_grey(F.col("vec")).alias("grey"), vectors.histogram(F.col("vec")).alias("hist"), vectors.median_bits(F.col("vec")).alias("hash"))
    return folds.fold(rows, {"grey": folds.Diverse(0.20, 20), "hist": folds.Colourful(0.40, 15), "hash": folds.Unseen(24)})


# --- pixels -------------------------------------------------------------------------------------------

#: Images of 32 x 24 pixels by a rule, with black bars of 0 to 6 rows at the top; grey is that of the measures.
_PIXELS = """px AS (SELECT p_partkey AS k, x, y, 2 * (p_partkey % 4) AS bar, CASE WHEN y < 2 * (p_partkey % 4) THEN 0 ELSE 40 + (p_partkey * 7 + x * 13 + y * 29) % 200 END AS b,
  CASE WHEN y < 2 * (p_partkey % 4) THEN 0 ELSE 40 + (p_partkey * 11 + x * 5 + y * 17) % 200 END AS g, CASE WHEN y < 2 * (p_partkey % 4) THEN 0 ELSE 40 + (p_partkey * 3 + x * 23 + y * 7) % 200 END AS r FROM part, range(32) a(x), range(24) c(y)),
content AS (SELECT *, round_even(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0) AS grey FROM px WHERE bar < 4 OR y >= bar)"""


@query(
    f"""WITH {_PIXELS}, around AS (SELECT *, lag(grey) OVER h AS l, lead(grey) OVER h AS e, lag(grey) OVER v AS u, lead(grey) OVER v AS d FROM content
      WINDOW h AS (PARTITION BY k, y ORDER BY x), v AS (PARTITION BY k, x ORDER BY y)),
    lap AS (SELECT k, y, grey, coalesce(l, e) + coalesce(e, l) + coalesce(u, d) + coalesce(d, u) - 4 * grey AS l FROM around)
    SELECT k AS p_partkey, 0 AS x, min(y)::INT AS y, 32 AS w, (24 - min(y))::INT AS h, round(var_pop(l) + 1e-6, 4) AS blur, round(avg(grey) + 1e-6, 4) AS luma, round(stddev_pop(grey) + 1e-6, 4) AS contrast FROM lap GROUP BY k"""
)
def pixel_measures(spark, sf_dir):
    config = Config(ssim_filter=False, color_diversity=False, dedup=False)
    m = extract.measured(patterned_frames(spark, sf_dir), config)
    return m.select(F.col("frame_index").alias("p_partkey"), *"xywh", *(F.round(F.col(c) + 1e-6, 4).alias(c) for c in ("blur", "luma", "contrast")))  # off the ties


@query(
    f"""WITH {_PIXELS}, span AS (SELECT *, greatest(b, g, r)::DOUBLE AS v, greatest(b, g, r) - least(b, g, r) AS s FROM content),
    hue AS (SELECT k, v, s, CASE WHEN s = 0 THEN 0 WHEN v = r THEN 60.0::DOUBLE * (g - b) / s WHEN v = g THEN 120 + 60.0::DOUBLE * (b - r) / s ELSE 240 + 60.0::DOUBLE * (r - g) / s END AS a FROM span),
    bins AS (SELECT k, (round_even((CASE WHEN a < 0 THEN a + 360 ELSE a END) / 2, 0)::INT % 180) * 16 // 180 AS h, CASE WHEN v > 0 THEN round_even(255.0::DOUBLE * s / v, 0) ELSE 0 END::INT * 8 // 256 AS c, v::INT * 4 // 256 AS w FROM hue),
    n AS (SELECT k, h * 32 + c * 4 + w AS bin, count(*) AS n FROM bins GROUP BY ALL)
    SELECT k AS p_partkey, bin::INT AS bin, round(n / sum(n) OVER (PARTITION BY k), 4) AS share FROM n"""
)
def colour_bins(spark, sf_dir):
    config = Config(ssim_filter=False, dedup=False)
    m = extract.measured(patterned_frames(spark, sf_dir), config)
    bins = m.select(F.col("frame_index").alias("p_partkey"), F.posexplode("colours").alias("bin", "share")).where("share > 0")
    return bins.select("p_partkey", "bin", F.round(F.col("share").cast("double"), 4).alias("share"))


# --- reports ------------------------------------------------------------------------------------------


@query(
    f"""WITH {SQL['frames']}, e AS (SELECT min(blur) AS lo, max(blur) AS hi FROM frames), b AS (SELECT least(11, floor((blur - lo) / (hi - lo) * 12)::INT) AS bin, count(*) AS n FROM frames, e GROUP BY ALL)
    SELECT i::INT AS bin, round(lo + (hi - lo) / 12 * i, 4) AS low, round(lo + (hi - lo) / 12 * (i + 1), 4) AS high, coalesce(n, 0) AS n FROM e, range(12) r(i) LEFT JOIN b ON b.bin = i"""
)
def blur_hist12(spark, sf_dir):
    return reports.histogram(frames(spark, sf_dir)).withColumns({c: F.round(c, 4) for c in ("low", "high")})


@query("SELECT page_id, (row_number() OVER (ORDER BY page_id) - 1) // 8 AS row, (row_number() OVER (ORDER BY page_id) - 1) % 8 AS col FROM pages QUALIFY row_number() OVER (ORDER BY page_id) <= 200")
def contact_layout(spark, sf_dir):
    cells = reports.sheet_cells(table(spark, sf_dir, "pages").select("page_id"), "page_id")
    return cells.select("page_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


@query(
    """WITH p AS (SELECT *, page_id * 7 % 900 + 0.3 AS blur, string_split(regexp_extract(url, '[^/]*$'), '?') AS tags FROM pages)
    SELECT page_id, printf('blur %.1f', blur) || chr(10) || 'bucket 1024x768' || chr(10) || 'frame #' || page_id || chr(10) || 'src: ' || regexp_extract(url, '([^/\\\\]*)$', 1) || chr(10) || 'tags: ' || array_to_string(tags[1:1], ', ') || CASE WHEN len(tags) > 1 THEN ' …' ELSE '' END AS hover,
    replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM p"""
)
def gallery_card(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    tags = F.split(F.regexp_extract("url", "[^/]*$", 0), r"\?")
    lines = reports.hover_lines(F.col("page_id") * 7 % 900 + 0.3, F.lit("1024x768"), F.col("page_id"), text.file_name(F.col("url")), tags, shown=1)
    return p.select("page_id", lines.alias("hover"), text.escape_html(F.col("url")).alias("escaped"))


@query(
    f"""WITH {_GATED}, c AS (SELECT video, {_COUNTERS} FROM gated GROUP BY video)
    SELECT video, CASE WHEN candidates <= 0 THEN 'kept: ' || passed ELSE 'kept ' || repeat('█', k) || repeat('░', 40 - k) || ' ' || passed || ' ' || printf('(%.1f%%)', round(passed * 100.0 / candidates, 1)) END AS bar
    FROM (SELECT *, round_even(passed * 40 / greatest(1, candidates), 0)::INT AS k FROM c)"""
)
def acceptance_bars(spark, sf_dir):
    c = quality.reject_counters(_gated(spark, sf_dir))
    return c.select("video", reports.bar(F.lit("kept"), F.col("passed"), F.col("candidates")).alias("bar"))


# --- tags and captions --------------------------------------------------------------------------------

_CATEGORY = "CASE WHEN i % 10 <= 6 THEN 0 WHEN i % 10 = 7 THEN 3 WHEN i % 10 = 8 THEN 4 ELSE 9 END"
_NAME = "CASE i WHEN 3 THEN '^_^' WHEN 14 THEN '>_<' WHEN 21 THEN 'Long_Hair' WHEN 22 THEN 'long_hair' ELSE 'tag_' || i END"
_TAGS = f"""vocabulary AS (SELECT i::INT AS idx, {_NAME} AS name, {_CATEGORY} AS category FROM range(64) r(i)),
scores AS (SELECT image, idx, name, category, CASE WHEN isnan(p) OR isinf(p) THEN 0.0 ELSE greatest(0.0, least(1.0, p)) END AS conf FROM (
  SELECT vec_id AS image, unnest(range(64))::INT AS idx, unnest(embedding)::DOUBLE * 4 AS p FROM embeddings) JOIN vocabulary USING (idx)),
picked AS (SELECT image, CASE WHEN category = 4 THEN 'character' ELSE 'general' END AS kind, idx, name, conf FROM scores WHERE category = 4 AND conf >= 0.85 OR category = 0 AND conf >= 0.35),
formatted AS (SELECT *, CASE WHEN name IN ({', '.join(repr(k) for k in text.KAOMOJI)}) THEN name ELSE replace(name, '_', ' ') END AS token, row_number() OVER (PARTITION BY image ORDER BY kind <> 'character', conf DESC, idx) AS place FROM picked),
tokens AS (SELECT DISTINCT image, lower(token) AS token FROM formatted)"""


def _vocabulary(spark):
    names = {3: "^_^", 14: ">_<", 21: "Long_Hair", 22: "long_hair"}
    rows = [(i, names.get(i, f"tag_{i}"), {7: 3, 8: 4, 9: 9}.get(i % 10, 0)) for i in range(64)]
    return spark.createDataFrame(rows, "idx int, name string, category int")


def _scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.transform("embedding", lambda x: x.cast("double") * 4).alias("probs"))
    return tagging.scored(e, _vocabulary(spark))


def _images(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"))


def _picked(spark, sf_dir):
    return tagging.picked(_scores(spark, sf_dir))


@query(f"WITH {_TAGS} SELECT image, kind, idx, name, round(conf, 4) AS conf FROM picked")
def tag_pick(spark, sf_dir):
    return _picked(spark, sf_dir).withColumn("conf", F.round("conf", 4))


@query(f"WITH {_TAGS} SELECT image, name AS rating, round(conf, 4) AS conf FROM scores WHERE category = 9 QUALIFY row_number() OVER (PARTITION BY image ORDER BY conf DESC, idx) = 1")
def rating_argmax(spark, sf_dir):
    return tagging.ratings(_scores(spark, sf_dir)).withColumn("conf", F.round("conf", 4))


@query(f"WITH {_TAGS} SELECT image, idx, token FROM formatted")
def format_tag(spark, sf_dir):
    return _picked(spark, sf_dir).select("image", "idx", text.format_tag(F.col("name")).alias("token"))


@query(f"WITH {_TAGS} SELECT token, count(*) AS n_images, round(count(*) / (SELECT count(DISTINCT vec_id) FROM embeddings), 4) AS share FROM tokens GROUP BY token HAVING count(*) / (SELECT count(DISTINCT vec_id) FROM embeddings) >= 0.25")
def trait_prune(spark, sf_dir):
    return tagging.constant_tokens(_images(spark, sf_dir), _picked(spark, sf_dir), 0.25).withColumn("share", F.round("share", 4))


@query(f"WITH {_TAGS} SELECT vec_id AS image FROM embeddings WHERE vec_id IN (SELECT image FROM tokens WHERE token = 'tag 4') AND vec_id NOT IN (SELECT image FROM tokens WHERE token IN ('tag 5', '^_^'))")
def require_exclude(spark, sf_dir):
    return tagging.accepted(_images(spark, sf_dir), _picked(spark, sf_dir), text.parse_tags("tag_4"), text.parse_tags("Tag_5, ^_^"))


_CAPTIONED = f"""{_TAGS}, pruned AS (SELECT token FROM tokens GROUP BY token HAVING count(*) / (SELECT count(DISTINCT vec_id) FROM embeddings) >= 0.28),
parts AS (SELECT vec_id AS image, 0 AS pos, 'my char' AS token FROM embeddings UNION ALL SELECT vec_id, 1, 'tag 8' FROM embeddings
  UNION ALL SELECT image, place + 2, token FROM formatted WHERE lower(token) NOT IN ('tag 10', 'tag 11') AND lower(token) NOT IN (SELECT token FROM pruned)),
firsts AS (SELECT image, pos, token FROM parts QUALIFY row_number() OVER (PARTITION BY image, lower(token) ORDER BY pos) = 1)"""


def _caption_tokens(spark, sf_dir):
    images, tags = _images(spark, sf_dir), _picked(spark, sf_dir)
    pruned = tagging.constant_tokens(images, tags, 0.28)
    return tagging.caption_tokens(images, tags, " my  char ", text.parse_tags("tag_8"), text.parse_tags("tag_10,TAG 11"), pruned)


@query(f"WITH {_CAPTIONED} SELECT image, string_agg(token, ', ' ORDER BY pos) AS caption FROM firsts GROUP BY image")
def caption(spark, sf_dir):
    return tagging.captions(_caption_tokens(spark, sf_dir))


@query(f"WITH {_CAPTIONED} SELECT image, pos::INT AS pos, token FROM firsts")
def blacklist_drop(spark, sf_dir):
    return _caption_tokens(spark, sf_dir)


@query(f"WITH {_CAPTIONED} SELECT token, count(*) AS n FROM firsts WHERE token <> 'my char' GROUP BY token ORDER BY n DESC, token LIMIT 30")
def tag_freq_top30(spark, sf_dir):
    return tagging.top(tagging.frequencies(_caption_tokens(spark, sf_dir), "my char"))


@query(
    f"""WITH {_TAGS}, ok AS (SELECT vec_id AS image FROM embeddings WHERE vec_id NOT IN (SELECT image FROM tokens WHERE token = 'tag 5')), cap AS (SELECT DISTINCT image FROM formatted)
    SELECT (SELECT count(*) FROM embeddings) AS total, (SELECT count(*) FROM ok JOIN cap USING (image)) AS tagged, (SELECT count(*) FROM embeddings) - (SELECT count(*) FROM ok) AS rejected, (SELECT count(*) FROM ok ANTI JOIN cap USING (image)) AS failed"""
)
def tag_summary(spark, sf_dir):
    images, tags = _images(spark, sf_dir), _picked(spark, sf_dir)
    good = tagging.accepted(images, tags, exclude=["tag 5"]).withColumn("ok", F.lit(True))
    done = tagging.captions(tagging.caption_tokens(images, tags)).select("image", F.lit(True).alias("captioned"))
    every = images.join(good, "image", "left").join(done, "image", "left")
    return every.agg(F.count("*").alias("total"), F.count_if(F.expr("ok and captioned")).alias("tagged"), F.count_if(F.expr("ok is null")).alias("rejected"), F.count_if(F.expr("ok and captioned is null")).alias("failed"))


# --- names --------------------------------------------------------------------------------------------

_STEM = r"""regexp_replace(regexp_replace(regexp_replace(nfc_normalize(url), '[<>:"/\\|?*\x00-\x1f]', '', 'g'), '\s+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g')"""


@query(f"WITH s AS (SELECT page_id, url, {_STEM} AS s FROM pages) SELECT page_id, CASE WHEN s = '' OR length(s) > 30 THEN left(CASE WHEN s = '' THEN 'video' ELSE s END, 21) || '_' || left(md5(url), 8) ELSE s END AS stem FROM s")
def sanitize_stem(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize_stem(F.col("url"), most=30).alias("stem"))


@query("SELECT c_custkey, regexp_replace(c_name, '[<>:\"/\\\\|?*]', '', 'g') || '_' || printf('%05d', c_custkey % 300000) || '.png' AS name FROM customer")
def output_naming(spark, sf_dir):
    stem = text.sanitize_stem(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", selection.output_name(stem, F.col("c_custkey") % 300000, "png").alias("name"))


@query(
    """WITH v AS (SELECT c_custkey, '/d' || (c_custkey % 2) || '/' || CASE WHEN c_custkey % 4 = 0 THEN 'Clip' ELSE 'clip' END || (c_custkey % 900) || '.mp4' AS video FROM customer),
    d AS (SELECT DISTINCT video, regexp_extract(video, '([^/]*)\\.mp4$', 1) AS stem FROM v),
    s AS (SELECT video, CASE WHEN count(*) OVER (PARTITION BY lower(stem)) > 1 THEN stem || '_' || left(md5(video), 8) ELSE stem END AS stem FROM d)
    SELECT video, c_custkey, stem || '/' || stem || '_' || printf('%05d', row_number() OVER (PARTITION BY video ORDER BY c_custkey)) || '.png' AS path FROM v JOIN s USING (video)"""
)
def unique_paths(spark, sf_dir):
    """Where the run writes its images: videos of one stem, whatever its case, have a part of their path's digest in theirs."""
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 4 == 0, "Clip").otherwise("clip"), (k % 900).cast("string"), F.lit(".mp4"))
    kept = table(spark, sf_dir, "customer").select(F.concat(F.lit("/d"), (k % 2).cast("string"), F.lit("/"), name).alias("video"), k.alias("frame_index"))
    return extract.named(kept, kept.select("video").distinct(), Config()).select("video", F.col("frame_index").alias("c_custkey"), "path")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'out' WHEN c_custkey % 3 = 1 THEN 'out/10_' || CASE WHEN c_custkey % 2 = 0 THEN 'dataset' ELSE 'my_char' END ELSE 'out/' || c_name END AS folder FROM customer")
def kohya_dir(spark, sf_dir):
    k = F.col("c_custkey")
    trigger = F.when(k % 2 == 0, " ").otherwise(" my  char ")
    folder = selection.folder(text.sanitize_stem(F.col("c_name")), k % 3 != 2, F.when(k % 3 == 1, 10).otherwise(0), trigger)
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("out"), F.when(folder == "", "").otherwise(F.concat(F.lit("/"), folder))).alias("folder"))


@query(
    """WITH s AS (SELECT c_custkey, 'clip:' || c_nationkey || '.mp4:' || (c_custkey % 50) || '-' || CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE (c_custkey % 90)::VARCHAR || '.5' END AS spec FROM customer)
    SELECT c_custkey, 'clip:' || regexp_extract(spec, 'clip:(.*):', 1) AS video, regexp_extract(spec, ':([0-9.]+)-([0-9.]+)$', 1)::DOUBLE AS start, regexp_extract(spec, ':([0-9.]+)-([0-9.]+)$', 2)::DOUBLE AS stop
    FROM s WHERE regexp_matches(spec, ':[0-9.]+-[0-9.]+$') AND regexp_extract(spec, '-([0-9.]+)$', 1)::DOUBLE > regexp_extract(spec, ':([0-9.]+)-', 1)::DOUBLE"""
)
def parse_segments(spark, sf_dir):
    from ..sources import settings

    k = F.col("c_custkey")
    end = F.when(k % 5 == 0, "x").otherwise(F.concat((k % 90).cast("string"), F.lit(".5")))
    spec = F.concat(F.lit("clip:"), F.col("c_nationkey").cast("string"), F.lit(".mp4:"), (k % 50).cast("string"), F.lit("-"), end)
    parsed = table(spark, sf_dir, "customer").select("c_custkey", settings.segment_column(spec).alias("s"))
    return parsed.where("s is not null").select("c_custkey", "s.video", "s.start", "s.stop")


@query(
    """WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS raw, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
    c AS (SELECT doc_id, i, trim(regexp_replace(replace(raw, '_', ' '), '[\\s]+', ' ', 'g')) AS token FROM t),
    f AS (SELECT doc_id, token, i FROM c WHERE token <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(token) ORDER BY i) = 1)
    SELECT doc_id, count(*) AS n_tokens FROM f GROUP BY doc_id"""
)
def tags_of_texts(spark, sf_dir):
    # exploded: a text has far more words than a list of tags has entries
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("raw"))
    token = text.collapse(F.replace("raw", F.lit("_"), F.lit(" ")))
    return d.select("doc_id", F.lower(token).alias("token")).where("token <> ''").groupBy("doc_id").agg(F.countDistinct("token").alias("n_tokens"))


@query("SELECT max(regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT) + 1 AS next FROM customer")
def capture_sequence(spark, sf_dir):
    from ..sources import settings

    return settings.next_number(table(spark, sf_dir, "customer"), "c_name")


@query(
    """WITH v AS (SELECT p_partkey, 'v' || (p_partkey % 3) || '.' || (p_size % 12) || '.' || (p_partkey % 5) AS version, p_partkey % 3 AS a, p_size % 12 AS b, p_partkey % 5 AS c FROM part)
    SELECT p_partkey, version, (a, b, c) > (1, 9, 2) AS newer FROM v"""
)
def version_compare(spark, sf_dir):
    k = F.col("p_partkey")
    version = F.concat(F.lit("v"), F.concat_ws(".", k % 3, F.col("p_size") % 12, k % 5))
    return table(spark, sf_dir, "part").select("p_partkey", version.alias("version"), text.is_newer(version, F.lit("1.9.2")).alias("newer"))




# --- streams ------------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, out: DataFrame, name: str) -> DataFrame:
    """What a stream gives for what there is now, by way of a table in the shared folder."""
    from .storage import new_folder

    folder = new_folder(spark, f"stream-{name}")
    query_ = out.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/data")


@query(ORACLES["ssim_greedy_last20"])
def stream_greedy(spark, sf_dir):
    from ..streaming.folds import stream_fold

    stream = stream_table(spark, sf_dir, "embeddings", "vec_id long, embedding array<float>, label int")
    rows = stream.select(F.col("label").cast("long").alias("video"), F.col("vec_id").alias("idx"), vectors.as_grey(F.col("embedding").cast("array<double>")).alias("vec"))
    return _streamed(spark, stream_fold(rows, lambda: folds.Diverse(0.20, 20)), "greedy")


@query(
    f"""WITH g AS (SELECT ts, {_REASON.format(b=100).replace('blur <', 'value <').replace('luma', '(event_id * 37 % 256)').replace('contrast <', '(event_id * 13 % 64) <')} AS reason FROM events)
    SELECT date_trunc('day', ts) AS start, {_COUNTERS} FROM g GROUP BY ALL"""
)
def windowed_gate_counters(spark, sf_dir):
    from ..streaming.windows import windowed_counters

    e = table(spark, sf_dir, "events")
    gated = e.select(F.col("ts").cast("timestamp").alias("ts"), quality.gate_reason(F.col("value"), F.col("event_id") * 37 % 256, F.col("event_id") * 13 % 64).alias("reason"))
    return windowed_counters(gated, window="1 day").drop("end")
