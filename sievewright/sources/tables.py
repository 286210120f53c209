"""Views that let the engine's operators run over plain tables: who plays frames, vectors, sizes, tags and names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """A table as a stream of its files; the file source wants a folder, so a table of one file is picked out of its own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: (video, frame_index, event_id, blur, t in seconds, luma, contrast)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video"),
        (F.row_number().over(order) - 1).cast("long").alias("frame_index"),
        "event_id",
        F.col("value").alias("blur"),
        ((micros - F.first(micros).over(order)) / 1e6).alias("t"),
        (F.col("event_id") * 37 % 256).cast("double").alias("luma"),
        (F.col("event_id") * 13 % 64).cast("double").alias("contrast"),
    )


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames with a vector: (video, idx, vec array<double>)."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("video"), F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("vec"))


def hash_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, idx, hash long): bit by bit, whether a vector's element is over its median."""
    return vector_rows(spark, sf_dir).select("video", "idx", vectors.median_bits(F.col("vec")).alias("hash"))


def size_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as image sizes: (l_orderkey, l_linenumber, w, h)."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (320 + 64 * (F.col("l_partkey") % 50)).alias("w"), (320 + 64 * (F.col("l_suppkey") % 40)).alias("h"))


#: The same views as SQL, for `WITH`.
SQL = {
    "frames": """frames AS (
  SELECT user_id AS video, row_number() OVER w - 1 AS frame_index, event_id, value AS blur,
    (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 1e6 AS t, (event_id * 37 % 256)::DOUBLE AS luma, (event_id * 13 % 64)::DOUBLE AS contrast
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
    "vecs": "vecs AS (SELECT label::BIGINT AS video, vec_id AS idx, embedding::DOUBLE[] AS vec FROM embeddings)",
    "hashes": """vecs AS (SELECT label::BIGINT AS video, vec_id AS idx, embedding::DOUBLE[] AS vec FROM embeddings),
medians AS (SELECT video, idx, vec, (list_sort(vec)[32] + list_sort(vec)[33]) / 2 AS m FROM vecs),
bits AS (SELECT video, idx, list_reduce(list_prepend(0::HUGEINT, list_transform(vec, lambda x: CASE WHEN x > m THEN 1::HUGEINT ELSE 0::HUGEINT END)), lambda a, b: a * 2 + b) AS u FROM medians),
hashes AS (SELECT video, idx, CASE WHEN u >= 9223372036854775808::HUGEINT THEN (u - 18446744073709551616::HUGEINT)::BIGINT ELSE u::BIGINT END AS hash FROM bits)""",
    "sizes": "sizes AS (SELECT l_orderkey, l_linenumber, 320 + 64 * (l_partkey % 50) AS w, 320 + 64 * (l_suppkey % 40) AS h FROM lineitem)",
}


def patterned_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as decoded frames of one video: 32 x 24 pixels by a rule, with black bars of 0, 2, 4 or 6 rows at the top."""

    def run(batches):
        y, x = np.mgrid[0:24, 0:32]
        for batch in batches:
            rows = []
            for k in batch.column(0).to_pylist():
                planes = [40 + (k * a + x * b + y * c) % 200 for a, b, c in ((7, 13, 29), (11, 5, 17), (3, 23, 7))]
                image = np.where((y < 2 * (k % 4))[..., None], 0, np.stack(planes, -1)).astype(np.uint8)
                rows.append(("part", k, k / 10, 24, 32, 3, image.tobytes()))
            kinds = [pa.string(), pa.int64(), pa.float64(), *[pa.int32()] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["video", "frame_index", "t", "height", "width", "channels", "data"])

    return table(spark, sf_dir, "part").select("p_partkey").mapInArrow(run, "video string, frame_index long, t double, height int, width int, channels int, data binary")
