"""Watching and stopping a run: Spark's job groups do what threads and flags do on one machine."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def run_named(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs started inside belong to the run `name`, which stop() ends; what is already written stays."""
    spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def stop(spark: SparkSession, name: str) -> None:
    spark.sparkContext.cancelJobGroup(name)


def progress(spark: SparkSession, name: str) -> tuple[int, int]:
    """(tasks done, tasks known so far) of a run."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(name) if (job := tracker.getJobInfo(j)) for i in job.stageIds if (s := tracker.getStageInfo(i))]
    return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
