"""Where lineage is cut: checkpoints and tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    It is the one named in spark.checkpoint.dir. Only a local master without that setting (tests)
    gets a temporary one; a cluster without it is an error, as no shared folder can be guessed.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="sievewright-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint; for narrow rows, as it isn't compressed."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders that this process has made and not yet deleted.
_MADE: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder. It goes with the run that it belongs to (see `run_tables`), at the latest when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    _MADE.append(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a compressed table in the shared folder."""
    spark = df.sparkSession
    folder = new_folder(spark, "table")
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def run_tables(spark: SparkSession) -> Iterator[None]:
    """What is written within the block is deleted at its end; results must have been used or saved by then."""
    first = len(_MADE)
    try:
        yield
    finally:
        for folder in _MADE[first:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        del _MADE[first:]


def apart(name: str) -> Column:
    """A long key as an expression that hides from the planner how its rows are partitioned.

    The planner then exchanges both sides of a join on it, and only then can adaptive execution
    split the partition of a hot key.
    """
    return F.col(name).bitwiseXOR(F.lit(0).cast("long")).alias(name)
