"""First-wins dedup over runs and micro-batches: an index of hashes in Parquet that each batch is held against and adds to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.near_hash import first_wins


def _read(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "hash long, ord long, batch long")
    index = spark.read.schema("hash long, ord long, batch long").parquet(path)
    return index if before is None else index.where(F.col("batch") < before)


def add_batch(rows: DataFrame, batch: int, path: str, distance: int) -> None:
    """Keep the rows (ord, hash) that are near no kept one of earlier batches or before them in this one, and index them.

    A batch that is run again finds the same index as before, and replaces what it had written.
    """
    spark = rows.sparkSession
    kept = first_wins(rows, distance, index=_read(spark, path, before=batch)).where("kept").select("hash", "ord")
    kept.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def deduped(stream: DataFrame, path: str, checkpoint: str, distance: int = 5, **trigger):
    """Start a query that indexes the stream's kept rows (ord, hash) at `path`; without a trigger it ends with what is there."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: add_batch(rows, batch, path, distance))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def kept(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path).select("ord", "hash")
