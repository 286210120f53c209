"""Files: which videos and images there are, vocabularies, and the index of hashes from earlier runs."""

from __future__ import annotations

import csv
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name

#: What counts as a video and as an image, by extension.
VIDEO_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "webm", "m4v", "flv", "wmv", "ts")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp")


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def plain_path(path: Column) -> Column:
    """Local paths without a scheme, which Spark's sources write in different ways; others as they are."""
    return F.regexp_replace(path, r"^file:/+", "/")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of all files below a path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(plain_path(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified"))


def discover_videos(spark: SparkSession, path: str) -> DataFrame:
    """Videos below a folder; a path that is a file is taken as it is, whatever its extension. A missing path is an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        raise FileNotFoundError(path)
    files = _listed(spark, path)
    return files if fs.getFileStatus(hadoop).isFile() else files.where(_extension(F.col("path")).isin(*VIDEO_EXTENSIONS))


def collect_images(spark: SparkSession, folder: str, rejected: str = "_rejected") -> DataFrame:
    """Images below a folder, but those whose names begin with an underscore and those that an earlier run rejected."""
    files = _listed(spark, folder).where(_extension(F.col("path")).isin(*IMAGE_EXTENSIONS))
    return files.where(~file_name(F.col("path")).startswith("_") & ~F.col("path").contains(f"/{rejected}/"))


def read_images(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """(path, height, width, channels, data): decoded by the JVM, blue green red; what can't be decoded is left out."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(folder)
    return images.select(plain_path(F.col("image.origin")).alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(idx, name, category) of a CSV of tags: a row's place among the data rows is its place in a model's output.

    A header, if there is one, says where name and category are, else they are second and third. Rows that are
    short, and categories that are no numbers or mean nothing, keep their place and are left out. The file
    is a model's vocabulary, small by nature, and read whole.
    """
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    rows = list(csv.reader(text.splitlines()))
    head = [c.strip().lower() for c in rows[0]] if rows else []
    named = "name" in head and "category" in head
    name_at, category_at = (head.index("name"), head.index("category")) if named else (1, 2)
    out = []
    for idx, row in enumerate(rows[1:] if named else rows):
        if len(row) > max(name_at, category_at):
            try:
                category = int(row[category_at])
            except ValueError:
                continue
            if category in (0, 3, 4, 9):
                out.append((idx, row[name_at], category))
    return spark.createDataFrame(out, "idx int, name string, category int")


def load_index(spark: SparkSession, path: str, distance: int, hash_size: int = 8) -> tuple[DataFrame, int]:
    """((hash, source), distance) of an index file, or an empty one. The run's distance and size win over the stored ones."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "hash long, source string"), distance
    schema = "hash_size int, distance int, entries array<struct<hash:string,source:string>>"
    entries = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("entries"))
    value = F.conv("hash", 16, -10).cast("long")
    return entries.select(value.alias("hash"), "source"), distance


def save_index(index: DataFrame, path: str, distance: int, hash_size: int = 8) -> None:
    """One JSON file, as other tools read it. For indexes that outgrow a file there is plain Parquet."""
    entries = [{"hash": f"{r.hash & (1 << hash_size * hash_size) - 1:0{hash_size * hash_size // 4}x}", "source": r.source} for r in index.select("hash", "source").toLocalIterator()]
    spark = index.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(json.dumps({"hash_size": hash_size, "distance": distance, "entries": entries}).encode()))
    finally:
        out.close()
