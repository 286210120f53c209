"""Near-duplicates by SimHash, candidates by pigeonring filtering.

A fingerprint has four segments of 16 bits on a ring. If two fingerprints differ in at most three
bits, the pigeonring principle says that from some segment i on, every chain of l segments has at
most floor(3 l / 4) differing bits: none in segment i, at most one in the first two, two in the
first three. The first two conditions become an equality key: segment i is the same, and as at
most one bit of segment i + 1 differs, all but one of its `parts` equal parts are the same. The
longer chains are tested before the full Hamming distance.

Equal fingerprints are one node from the start. Buckets of many different fingerprints are dealt
out in blocks, each pair of blocks a cell of its own, so that no bucket meets in one task; each cell
gives a star for each of its components, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected
from .common import apart, checkpointed, column_names, columns

SEGMENTS, BITS, LIMIT = 4, 16, 3
#: Rows of a bucket that share a cell, and from which number of blocks on the cells grow too.
BLOCK, MANY_BLOCKS = 64, 64


def fingerprint(text: str | None, width: int = 3, seed: int = 42, at_once: int = 100_000) -> int:
    """64-bit SimHash of the word shingles of a text with A-Z lower-cased; null or no words: 0."""
    words = text.encode().lower().split() if text else []  # bytes.lower() changes A-Z only
    if not words:
        return 0
    line, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    one = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(words) - width + 1
    for k in range(0, n, at_once):
        spans = zip(starts[k : min(n, k + at_once)].tolist(), ends[k + width - 1 : k + width - 1 + at_once].tolist(), strict=False)
        hashes = np.array([one(line[a:b], seed) for a, b in spans], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long: the fingerprint's 64 bits as a signed number), a row for each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches, "doc_id", "text"):
            fps = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    picked = docs.select(*column_names(docs, doc_id=id_col, text=text_col)).withColumn("doc_id", F.col("doc_id").cast("long"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def _segment(i: int) -> Column:
    return F.shiftrightunsigned("fp", BITS * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))


def chain_keys(parts: int) -> Column:
    """A key for each start i on the ring and each part of the next segment that is left out."""
    size = BITS // parts
    keys = []
    for i in range(SEGMENTS):
        for j in range(parts):
            rest = 0xFFFF & ~(((1 << size) - 1) << (j * size))
            head = F.lit((i * parts + j) << 32)
            keys.append(head.bitwiseOR(F.shiftleft(_segment(i), 16)).bitwiseOR(_segment(i + 1).bitwiseAND(F.lit(rest))))
    return F.array(*keys)


def _chain_mask(i: int, length: int) -> int:
    return sum(0xFFFF << (BITS * ((i + k) % SEGMENTS)) for k in range(length))


_CHAINS = np.array([[_chain_mask(i, n) for n in (2, 3)] for i in range(SEGMENTS)], np.uint64)


def _stars(start: np.ndarray, fps: np.ndarray, edges: list, cells_at_once: int = 2_000_000) -> None:
    """start: (cells,), ring start of each cell; fps: (cells, rows). Adds the edges of a star for each component of each cell."""
    cells, rows = fps.shape
    for k in range(0, cells, step := max(1, cells_at_once // rows**2)):
        x = fps[k : k + step, :, None] ^ fps[k : k + step, None, :]
        near = np.ones(x.shape, bool)
        for n, most in ((0, 1), (1, 2)):  # chains of two and three segments
            near &= np.bitwise_count(x & _CHAINS[start[k : k + step], n][:, None, None]) <= most
        near[near] = np.bitwise_count(x[near]) <= LIMIT
        label = np.broadcast_to(np.arange(rows), x.shape[:2])
        while True:
            least = np.where(near, label[:, None, :], rows).min(2)
            if (least == label).all():
                break
            label = least
        cell, row = np.nonzero(label != np.arange(rows))
        if cell.size:
            edges.append((fps[k + cell, row], fps[k + cell, label[cell, row]]))


def _cell_edges(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, lo, hi, fp), those of a cell next to each other -> edges (a, b)."""

    def cells(key: np.ndarray, cell: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edges: list = []
        first = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]).any(1))))
        sizes = np.diff(np.append(first, len(fps)))
        for n in np.unique(sizes[sizes > 1]):
            at = first[sizes == n]
            _stars((key[at] >> 32) // parts, fps[at[:, None] + np.arange(n)], edges)
        a, b = (np.concatenate(x) if edges else np.empty(0, np.uint64) for x in (zip(*edges) if edges else ([], [])))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    rest = np.empty((0, 4), np.int64)
    for batch in batches:
        rows = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "lo", "hi", "fp")], 1).astype(np.int64)
        rows = np.concatenate([rest, rows])
        same = (rows[:, :3] == rows[-1, :3]).all(1)
        cut = int(np.argmax(same))  # rows are sorted: the last cell may go on in the next batch
        done, rest = rows[:cut], rows[cut:]
        if len(done):
            yield cells(done[:, 0], done[:, :3], done[:, 3].copy().view(np.uint64))
    if len(rest):
        yield cells(rest[:, 0], rest[:, :3], rest[:, 3].copy().view(np.uint64))


def links(classes: DataFrame, parts: int) -> DataFrame:
    """Different fingerprints (fp long, distinct) -> edges (a, b) that connect what links at 3 bits or fewer."""
    keyed = classes.select("fp", F.explode(chain_keys(parts)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    found = keyed.join(sizes.select(apart("key"), "n"), "key")
    blocks = F.ceil(F.when(F.col("n") <= BLOCK * MANY_BLOCKS, F.col("n") / BLOCK).otherwise(F.sqrt("n"))).cast("long")
    own = F.when(F.col("n") <= 2 * BLOCK, F.lit(0)).otherwise(F.pmod(F.xxhash64("fp", "key"), blocks))
    others = F.when(F.col("n") <= 2 * BLOCK, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))
    dealt = found.select("key", "fp", own.cast("long").alias("own"), F.explode(others).alias("other"))
    cells = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    ordered = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")
    return ordered.mapInArrow(lambda batches: _cell_edges(batches, parts), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide_from: int = 1 << 22) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of `docs`.

    component_id is the smallest doc_id that can be reached over links, its own included. Null and
    empty texts have fingerprint zero and link like any other. Repeated rows stay repeated. A null
    doc_id stays null and never is a component's id, unless its component has no other. From
    `wide_from` different fingerprints on, keys have 28 bits that must be equal, before that 24; the
    links are the same.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = checkpointed(connected(links(classes.select("fp"), 2 if classes.count() < wide_from else 4)).select(F.col("node").alias("fp"), "root"))
    least = found.join(classes, "fp").groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = found.join(least, "root").select("fp", "least_id")
    named = classes.join(linked, "fp", "left").select(apart("fp"), F.coalesce("least_id", "first_id").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is their component's smallest; of rows that repeat this id, the one whose text has the smallest hash.

    Rows with a null id stay: nothing says which of them are the same document. `docs` may have columns of any names.
    """
    picked = docs.select(*column_names(docs, doc_id=id_col, text=text_col)).where("doc_id is not null")
    groups = near_duplicates(picked)
    stay = groups.where("doc_id = component_id").select("doc_id").distinct()
    # whole rows go along as one struct: their names meet no others
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    held = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie"))
    named = held.where("doc_id is not null").join(stay, "doc_id", "left_semi")
    first = named.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("tie"))).where("place = 1")
    return first.select("row").unionByName(held.where("doc_id is null").select("row")).select("row.*")
