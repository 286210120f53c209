"""Near-duplicate hashes: the Hamming join and first-wins dedup, over rows of one order.

If two hashes differ in at most d bits, then of m segments that make up all bits one differs in at most
floor(d / m). So pairs come from an equality join: one side with its segments, the other with each
segment and all that is so near to it. Few segments are selective but have many neighbours: `plan` weighs the rows
that are exchanged against the candidates that are compared, for the number of hashes that there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import apart, checkpointed
from .components import connected

BITS = 64
#: Neighbours of a segment at most; edges that a task decides by itself.
MOST_KEYS, LOCAL = 2000, 1 << 20


def cuts(segments: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(shift, width) of the segments."""
    at = [bits * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def plan(rows: int, distance: int, bits: int = BITS) -> int:
    """The number of segments with the least work: rows that are exchanged, and pairs that meet."""

    def work(m: int) -> float:
        spread = [(sum(comb(w, k) for k in range(distance // m + 1)), w) for _, w in cuts(m, bits)]
        return float("inf") if max(n for n, _ in spread) > MOST_KEYS else sum(rows * (n + 1) + rows * rows * n / 2**w for n, w in spread)

    return min(range(1, min(bits, distance + 1) + 1), key=work)


def _segment(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))


def _key(k: int, value: Column) -> Column:
    return F.struct(F.lit(k).alias("k"), value.alias("v"))


def _keys(k: int, value: Column, masks: Column) -> Column:
    return F.transform(masks, lambda x: _key(k, value.bitwiseXOR(x)))


def near_pairs(hashes: DataFrame, distance: int, order: str = "ord", value: str = "hash", bits: int = BITS, segments: int | None = None) -> DataFrame:
    """(a, b, distance int): pairs of rows with a < b in `order`, a unique long, and at most `distance` bits between them.

    Equal hashes are pairs too; dedupe them before where their number matters. Null hashes are in no pair.
    Hashes have `bits` bits, the lowest of a long. Both sides of the join are exchanged, so that adaptive execution can split a hot
    segment; a pair that meets in several segments is taken from the first.
    """
    rows = checkpointed(hashes.select(F.col(order).alias("ord"), F.col(value).alias("hash")).where("hash is not null"))  # else each segment works out its hash anew
    m = segments or plan(rows.count(), distance, bits)
    near = distance // m
    places = cuts(m, bits)
    own, around = [], []
    for k, (shift, width) in enumerate(places):
        flips = (sum(1 << i for i in some) for e in range(near + 1) for some in combinations(range(width), e))
        masks = F.expr(f"array({', '.join(f"bigint('{x - (x >> 63 << 64)}')" for x in flips)})")  # one literal
        own.append(_key(k, _segment(F.col("hash"), shift, width)))
        around.append(_keys(k, _segment(F.col("hash"), shift, width), masks))
    left = rows.select(F.explode(F.flatten(F.array(*around))).alias("key"), F.col("ord").alias("a"), F.col("hash").alias("ha"))
    right = rows.select(F.explode(F.array(*own)).alias("key"), F.col("ord").alias("b"), F.col("hash").alias("hb"))
    differ = F.col("ha").bitwiseXOR(F.col("hb"))
    first = F.coalesce(*(F.when(F.bit_count(_segment(differ, shift, width)) <= near, F.lit(k)) for k, (shift, width) in enumerate(places)))
    pairs = left.join(right.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance) & (F.col("key.k") == first))
    return pairs.select("a", "b", F.bit_count(differ).cast("int").alias("distance"))


def _decided(edges: DataFrame) -> DataFrame:
    """Edges (root, a, b), those of a root in one task -> (ord): the rows that lose. Rows come in order, so all before a row are decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = row = None
        lost: set[int] = set()
        for batch in batches:
            out = []
            for r, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != root:
                    root, row, lost = r, None, set()
                if a not in lost and b not in lost:
                    lost.add(b)
                    out.append(b)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["ord"])

    return edges.select("root", "b", "a").repartition("root").sortWithinPartitions("root", "b", "a").select("root", "a", "b").mapInArrow(run, "ord long")


def _losers(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(ord): the rows that the first maximal independent set of the edges (a < b) leaves out.

    What hangs together in up to `local` edges is decided by one task, in order, however long its chains are. Only a
    larger component goes in rounds: rows without an undecided row before them stay, rows next to one that stays go.
    """
    if edges.count() <= local:
        return _decided(edges.withColumn("root", F.lit(0).cast("long")))
    of = checkpointed(connected(edges))
    rooted = edges.join(of.select(apart("node").alias("a"), "root"), "a")
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n"))
    large = checkpointed(sizes.where(F.col("n") > local).select("root"))
    out = _decided(rooted.join(large, "root", "left_anti"))
    edges = checkpointed(rooted.join(large, "root", "left_semi").select("a", "b"))
    while n := edges.count():
        if n <= local:
            return out.unionByName(checkpointed(_decided(edges.withColumn("root", F.lit(0).cast("long")))))
        firsts = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        beaten = checkpointed(edges.join(firsts, "a").select("b").distinct())
        left = edges.join(beaten, "b", "left_anti").join(beaten.select(F.col("b").alias("a")), "a", "left_anti")
        edges = checkpointed(left.join(firsts, "a", "left_anti"))
        out = checkpointed(out.unionByName(beaten.select(F.col("b").alias("ord"))))
    return out


def first_wins(hashes: DataFrame, distance: int, order: str = "ord", value: str = "hash", index: DataFrame | None = None, bits: int = BITS, local: int = LOCAL) -> DataFrame:
    """(ord, hash, kept): a row is kept if no kept row before it, and no hash of `index` (column hash), is within the distance.

    The kept rows are the first maximal independent set, in this order, of the graph of near pairs. Equal hashes
    are one node from the start, as only their first row can be kept. Null hashes are kept.
    """
    rows = checkpointed(hashes.select(F.col(order).alias("ord"), F.col(value).alias("hash")))
    nodes = checkpointed(rows.where("hash is not null").groupBy("hash").agg(F.min("ord").alias("ord")))
    if index is not None:
        known = index.select(F.col("hash")).where("hash is not null").distinct().withColumn("ord", -1 - F.xxhash64("hash").bitwiseAND(F.lit((1 << 62) - 1)))
        pairs = near_pairs(nodes.unionByName(known), distance, "ord", "hash", bits)
        gone = checkpointed(pairs.where("a < 0 and b >= 0").select(F.col("b").alias("ord")).unionByName(nodes.join(known.select("hash"), "hash", "left_semi").select("ord")).distinct())
        nodes = checkpointed(nodes.join(gone, "ord", "left_anti"))
    edges = checkpointed(near_pairs(nodes, distance, bits=bits).select("a", "b"))
    winners = nodes.join(_losers(edges, local), "ord", "left_anti")
    named = rows.join(winners.select("ord", F.lit(True).alias("_won")), "ord", "left")
    return named.select("ord", "hash", (F.col("hash").isNull() | F.coalesce("_won", F.lit(False))).alias("kept"))
