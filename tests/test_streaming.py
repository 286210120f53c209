import random

import numpy as np
from pyspark.sql import functions as F

from sievewright.operators import folds, near_hash
from sievewright.streaming import index
from sievewright.streaming.folds import stream_fold
from sievewright.streaming.windows import windowed_counters


def files_in_order(spark, rows, schema, path, parts):
    """A folder of files, each with the next rows; the file source takes the oldest first."""
    import os

    for k in range(parts):
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            full = os.path.join(path, name)
            if name.startswith("part-") and os.stat(full).st_mtime > 2e6:
                os.utime(full, (10**6 + k, 10**6 + k))


def test_stream_fold_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(v, i, rng.uniform(0, 255, 4).tolist()) for i in range(60) for v in range(3)]
    schema = "video int, idx int, vec array<double>"
    files_in_order(spark, rows, schema, str(tmp_path / "in"), 4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_fold(stream, lambda: folds.Diverse(0.5, 4)).writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.video, r.idx): r.accepted for r in spark.table("folded").collect()}
    want = {(r.video, r.idx): r.reason == "" for r in folds.fold(spark.createDataFrame(rows, schema), {"vec": folds.Diverse(0.5, 4)}).collect()}
    assert got == want and set(want.values()) == {True, False}


def test_index_over_batches_and_runs(spark, tmp_path):
    rng = random.Random(1)
    seeds = [rng.getrandbits(60) for _ in range(15)]
    rows = [(i, rng.choice(seeds) ^ (1 << rng.randrange(60))) for i in range(90)]
    files_in_order(spark, rows, "ord long, hash long", str(tmp_path / "in"), 3)
    stream = spark.readStream.schema("ord long, hash long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    at = str(tmp_path / "index")
    index.deduped(stream, at, str(tmp_path / "state"), distance=2).awaitTermination()
    want = {r.ord for r in near_hash.first_wins(spark.createDataFrame(rows, "ord long, hash long"), 2).where("kept").collect()}
    assert {r.ord for r in index.kept(spark, at).collect()} == want
    index.add_batch(spark.createDataFrame(rows[60:], "ord long, hash long"), 2, at, 2)  # a batch that is run again changes nothing
    assert {r.ord for r in index.kept(spark, at).collect()} == want
    assert index.kept(spark, str(tmp_path / "none")).count() == 0


def test_windows_of_a_stream(spark, tmp_path):
    rows = [(1_000_000 + 600 * i, "" if i % 3 else "blur") for i in range(40)]
    frame = spark.createDataFrame(rows, "s long, reason string").select(F.timestamp_seconds("s").alias("ts"), "reason")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = windowed_counters(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, windowed_counters(frame).collect()))
