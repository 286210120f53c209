"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import apart, checkpointed, written
from .memo import forget

__all__ = ["apart", "checkpointed", "column_names", "columns", "numbered", "table", "words_of", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(batches: Iterator[pa.RecordBatch], *names: str, at_once: int = 256, remembers: bool = False) -> Iterator[list[list]]:
    """The named columns as Python lists, a few rows at a time, so that few texts are in memory twice.

    Work that doesn't remember anything begins by dropping what the worker remembers from other work.
    """
    if not remembers:
        forget()
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            part = batch.slice(start, at_once)
            yield [part.column(n).to_pylist() for n in names]


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.split() splits at exactly these six characters."""
    return text.encode().split() if text else []


def numbered(df: DataFrame) -> DataFrame:
    """`df` with its columns named c0, c1, ... in order, as Python functions over batches can't have names with dots or repeated ones; toDF() names them back."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def column_names(df: DataFrame, **wanted: str) -> list[Column]:
    """Only the wanted columns, under the operator's own names; whatever else `df` has stays out of its way."""
    return [F.col(f"`{source}`").alias(name) for name, source in wanted.items()]
