"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch retains every shingle hash below one fixed fraction of the hash range, 1 / SCALE, whatever the
document. So it grows with its document, sketches of parts merge to the sketch of the whole, and
containment can be estimated between documents of very unequal length. A text of few shingles may have an
empty sketch; then nothing tells it from any other such text, and two empty sketches are alike.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_names, columns, words_of

WIDTH, SCALE = 5, 4
#: Rows of a part of against_next(), about, where the session's shuffle partitions would be larger.
PART_ROWS = 500_000
_TOP = np.uint64(2**64 - 1)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """A hash of each sequence of `width` words, of all words if there are fewer; none for no words."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        out = (out * _MIX[0]) ^ (h[k : k + n] * _MIX[1])
        out ^= out >> np.uint64(29)
    out *= _MIX[2]
    return out ^ (out >> np.uint64(32))


def sketch(words: list[bytes], width: int = WIDTH, scale: int = SCALE) -> np.ndarray:
    """The retained hashes, distinct and ascending."""
    hashes = shingle_hashes(words, width)
    return np.unique(hashes[hashes < _TOP // np.uint64(scale)])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of all the shingles that either has."""
    return np.union1d(a, b)


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Estimates of (shared / all, share of the first that the second contains); two empty ones are alike."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    whole = len(a) + len(b) - shared
    return (shared / whole if whole else 1.0), (shared / len(a) if len(a) else 1.0)


def as_text(s: np.ndarray) -> str:
    return s.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


_RESULT = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "contained_edited": pa.float64(), "contained_next": pa.float64()}
_RESULT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"

Rank = tuple[bool, int, int]  # whether doc_id is null, its complement, the text's hash: ascending is descending doc_id, nulls last
_DEALT = {"part": pa.int64(), "guest": pa.bool_(), "none": pa.bool_(), "falling": pa.int64(), "tie": pa.int64(), "doc_id": pa.int64(), "packed": pa.binary()}


def _compare(doc: int | None, text: str, own: np.ndarray, next_text: str, next_own: np.ndarray) -> tuple:
    n = len(text)
    cut = n // 3
    edited = text[: n - cut] + next_text[:cut]
    changed = sketch(words_of(edited))
    (near, held), (near_next, held_next) = likeness(own, changed), likeness(own, next_own)
    return doc, n, hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(changed), near, near_next, held, held_next


def _parts(ranked: DataFrame) -> list[tuple[Rank, Rank]]:
    """(least, largest rank) of each part of the rows in order; a few numbers for each part come to the driver."""
    spark = ranked.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ranked.count() // PART_ROWS + 1)
    order = ["none", "falling", "tie"]
    dealt = ranked.select(*order).repartitionByRange(n, *order)
    rank = F.struct(*order)
    found = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(rank).alias("least"), F.max(rank).alias("most"))
    return sorted((tuple(r.least), tuple(r.most)) for r in found.collect())


def _dealer(parts: list[tuple[Rank, Rank]]):
    """Rows with their part; a part's first row goes to the part before it too, as a guest: there it follows the last row."""
    most = [m for _, m in parts]
    host = {least: (k - 1) % len(parts) for k, (least, _) in enumerate(parts)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # texts are compressed one by one: the sort and the exchange hold a good third less than with Spark's own block compression
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for none, falling, ties, ids, texts in columns(batches, "none", "falling", "tie", "doc_id", "text"):
            rows = []
            for rank, doc, text in zip(zip(none, falling, ties, strict=True), ids, texts, strict=True):
                rest = (*rank, doc, pack((text or "").encode()))
                rows.append((bisect_left(most, rank), False, *rest))
                if rank in host:
                    rows.append((host[rank], True, *rest))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _DEALT.values(), strict=True)], list(_DEALT))

    return run


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted parts, each with its guest at the end -> a row for each document but the guests."""
    unpack = zstandard.ZstdDecompressor().decompress
    last = None
    for parts, guests, ids, texts in columns(batches, "part", "guest", "doc_id", "packed"):
        rows = []
        for part, guest, doc, packed in zip(parts, guests, ids, texts, strict=True):
            if guest and last is None:
                continue  # a guest's repeated row
            text = unpack(packed).decode()
            own = sketch(words_of(text))
            if last is not None:
                rows.append(_compare(*last, text, own))
            last = None if guest else (doc, text, own)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _RESULT.values(), strict=True)], list(_RESULT))


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and how like they are; a row for each row of `docs`.

    The edited text has the last floor(n_chars / 3) code points replaced by as many of the first of the next
    document (all if it has fewer), in descending order of doc_id; the last document's next is the
    first, a lone document is its own. Null texts are empty, and texts without words have an empty
    fingerprint; two empty ones are alike (1), an empty one and another aren't (0). Rows with the same doc_id are ordered by a hash
    of their text, null doc_ids come last.

    The narrow columns of the order are sorted first, which gives the bounds of its parts. Then the texts are
    exchanged once: each part gets its documents and the first one of the part that follows.
    """
    picked = docs.select(*column_names(docs, doc_id=id_col, text=text_col)).withColumn("doc_id", F.col("doc_id").cast("long"))
    falling = F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long"))
    ranked = picked.select(F.col("doc_id").isNull().alias("none"), falling.alias("falling"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"), "doc_id", "text")
    parts = _parts(ranked)
    schema = "part long, guest boolean, none boolean, falling long, tie long, doc_id long, packed binary"
    dealt = ranked.mapInArrow(_dealer(parts), schema).repartition("part")
    return dealt.sortWithinPartitions("part", "guest", "none", "falling", "tie").mapInArrow(_in_order, _RESULT_SCHEMA)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(doc_id, fingerprint string: the sketch's hashes in hex), a row for each row of `docs`; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches, "doc_id", "text"):
            prints = [as_text(sketch(words_of(t), width, scale)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    picked = docs.select(*column_names(docs, doc_id=id_col, text=text_col)).withColumn("doc_id", F.col("doc_id").cast("long"))
    return picked.mapInArrow(run, "doc_id long, fingerprint string")
