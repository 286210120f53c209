"""Cross-entropy difference of two word bigram models, one of target text and one of all text.

Both models have one vocabulary, every word of the corpus, and one smoothing. All words and all bigrams are counted,
however large the corpus is: nothing is cut, and no table of counts is ever held whole by one process.

Texts are cut into blocks of about BLOCK words. A block's different words and bigrams, as sorted 64-bit hashes with their
counts in the block, are dealt out by ranges of the hash, so that a word, however frequent, is one entry of
each block. Whoever has a range adds up its entries and answers each block in the order of its question: with the
counts only, as the block still knows the hashes. With its answers a block's losses are a lookup. An entry
collides with another at a rate of 2^-64, the only inexactness.

A document's score is its mean loss per word under the target model less that under the background
model: the lower, the more it is like the target.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_names, columns, written

PRIOR = 2.0
#: Words of a block; entries of a range, about; bytes from which on a text is read in pieces.
BLOCK, SLICE, PIECE = 1 << 20, 1 << 19, 4 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
_ONE = np.uint64(1)
_SPACE = re.compile(rb"[\x09-\x0D\x20]")


# --- entries: a word's hash is odd, a bigram's is even ----------------------------------------------


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX[2]
    return h ^ (h >> np.uint64(32))


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def word_entries(h: np.ndarray) -> np.ndarray:
    return _stirred(h * _MIX[0]) | _ONE


def bigram_entries(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return _stirred(((before * _MIX[0]) ^ (before >> np.uint64(31))) + h * _MIX[1]) & ~_ONE


#: What stands before a text: no word is empty.
START = hashes_of([b""])[0]
START_ENTRY = word_entries(np.array([START]))[0]


def pieces_of(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text in pieces of about `size` bytes that end between words."""
    at = 0
    while len(data) - at > size:
        m = _SPACE.search(data, at + size)
        if not m:
            break
        yield data[at : m.end()]
        at = m.end()
    yield data[at:] if at else data


# --- packed arrays ----------------------------------------------------------------------------------


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers byte plane by byte plane: those of small numbers compress to little."""
    planes = b"".join(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(data: bytes, n: int) -> list[np.ndarray]:
    """The `n` arrays of equal length."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return [np.ascontiguousarray(p.reshape(8, -1).T).view("<u8").ravel() for p in planes.reshape(n, -1)]


def _gaps(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=np.uint64(0))


# --- blocks -----------------------------------------------------------------------------------------


@dataclass
class Block:
    """Pieces of texts, one after the other, as arrays over their words."""

    own: np.ndarray  # hash of each word
    before: np.ndarray  # and of the one before it
    sizes: np.ndarray  # words of each piece
    sizes: np.ndarray  # words of each piece

    @classmethod
    def of(cls, pieces: list[bytes], before: list[bytes]) -> Block:
        words = [p.split() for p in pieces]
        sizes = np.array([len(w) for w in words], np.int64)
        own = hashes_of([w for ws in words for w in ws])
        previous = np.concatenate((own[:1], own[:-1]))
        begin = (np.cumsum(sizes) - sizes)[sizes > 0]
        previous[begin] = hashes_of([b for b, n in zip(before, sizes, strict=True) if n])
        return cls(own, previous, sizes)

    def entries(self, wanted: np.ndarray | None = None) -> np.ndarray:
        """Entries of all words, or of the wanted ones: words, bigrams, and the start as often as it comes before one."""
        own, before = (self.own, self.before) if wanted is None else (self.own[wanted], self.before[wanted])
        starts = np.full(np.count_nonzero(before == START), START_ENTRY, np.uint64)
        return np.concatenate((word_entries(own), bigram_entries(before, own), starts))


def _blocks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Texts -> blocks: the rows' numbers, each with how many pieces it has here, the words before the pieces, and the pieces.

    A row's number is its partition's and its place there: written down at once, it needn't be the same in another attempt.
    """
    from pyspark import TaskContext

    first = (TaskContext.get().partitionId() + 1) << 36
    seen, blocks, held = 0, 0, 0
    rows: list[tuple] = []
    names = ["block", "n_words", "rows", "ids", "before", "sizes", "data"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]

    def block() -> pa.RecordBatch:
        numbers, ids, before, pieces = zip(*rows, strict=True)
        data = zstandard.ZstdCompressor(level=3).compress(b"".join(pieces))
        values = (first + blocks, held, numbers, ids, before, [len(p) for p in pieces], data)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    for ids, texts in columns(batches, "doc_id", "text"):
        for doc, text in zip(ids, texts, strict=True):
            before = b""
            for piece in pieces_of((text or "").encode()):
                own = piece.split()
                rows.append((first + seen, doc, before, piece))
                held += len(own)
                before = own[-1] if own else before
                if held >= words or len(rows) >= words:
                    yield block()
                    rows, held, blocks = [], 0, blocks + 1
            seen += 1
    if rows:
        yield block()


def _pieces(row: dict) -> list[bytes]:
    data, at = zstandard.ZstdDecompressor().decompress(row["data"]), 0
    out = []
    for n in row["sizes"]:
        out.append(data[at : at + n])
        at += n
    return out


def _questions(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[pa.RecordBatch]:
    """Blocks with the numbers of their target rows -> for each range of entries the block's own, with their counts."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            block = Block.of(_pieces(row), row["before"])
            entries, n = np.unique(block.entries(), return_counts=True)
            if not len(entries):
                continue
            target = np.zeros(len(entries), np.uint64)
            if row["target"]:
                flags = np.isin(np.array(row["rows"], np.int64), np.array(row["target"], np.int64))
                some, t = np.unique(block.entries(np.repeat(flags, block.sizes)), return_counts=True)
                target[np.searchsorted(entries, some)] = t
            places = ((entries >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
            last = np.append(first[1:], len(entries))
            data = [_packed(_gaps(entries[a:b]), n[a:b], target[a:b]) for a, b in zip(first, last, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(places[first]), pa.array(np.full(len(first), row["block"])), pa.array(data, pa.binary())], ["slice", "block", "data"])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions, those of a range next to each other -> the answers, the first of each range with the range's numbers."""

    def answer(place: int, blocks: list[int], data: list[bytes]) -> pa.RecordBatch:
        asked = [_unpacked(d, 3) for d in data]
        sizes = [len(a[0]) for a in asked]
        entries = np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in asked])
        every, which = np.unique(entries, return_inverse=True)
        n, t = (np.bincount(which, np.concatenate([a[k] for a in asked]), len(every)).astype(np.uint64) for k in (1, 2))
        word = (every & _ONE).astype(bool) & (every != START_ENTRY)
        cuts = np.cumsum(sizes)[:-1]
        out = [_packed(a, b) for a, b in zip(np.split(n[which], cuts), np.split(t[which], cuts), strict=True)]
        sums = [[int(x)] + [0] * (len(out) - 1) for x in (np.count_nonzero(word), n[word].sum(), t[word].sum())]
        arrays = [pa.array(blocks, pa.int64()), pa.array([place] * len(out), pa.int64()), pa.array(out, pa.binary()), *(pa.array(s, pa.int64()) for s in sums)]
        return pa.RecordBatch.from_arrays(arrays, ["block", "slice", "data", "kinds", "n", "t"])

    now: int | None = None
    blocks: list[int] = []
    data: list[bytes] = []
    for batch in batches:
        for place, block, some in zip(*(batch.column(c).to_pylist() for c in ("slice", "block", "data")), strict=True):
            if place != now and blocks:
                yield answer(now, blocks, data)
                blocks, data = [], []
            now = place
            blocks.append(block)
            data.append(some)
    if blocks:
        yield answer(now, blocks, data)


@dataclass
class Totals:
    """Different words of the corpus, words of all text, words of the target."""

    kinds: int
    background: int
    target: int

    def losses(self, word: np.ndarray, context: np.ndarray, pair: np.ndarray, total: int, prior: float = PRIOR) -> np.ndarray:
        """-log p(w | h), p(w | h) = (c(h, w) + prior p(w)) / (c(h) + prior), p(w) with one added to each word's count and to that of unknown ones."""
        return -np.log((pair + prior * (word + 1.0) / (total + self.kinds + 1)) / (context + prior))


def _losses(batches: Iterator[pa.RecordBatch], totals: Totals) -> Iterator[pa.RecordBatch]:
    """A block's row, then its answers by range -> (row, doc_id, words, loss under target, under background) of its pieces."""

    def scored(row: dict, answers: list[bytes]) -> pa.RecordBatch:
        block = Block.of(_pieces(row), row["before"])
        entries = np.unique(block.entries())
        found = [_unpacked(a, 2) for a in answers]
        counts = [np.concatenate([np.empty(0, np.uint64), *(f[k] for f in found)]).astype(float) for k in (0, 1)]
        owner = np.repeat(np.arange(len(block.sizes)), block.sizes)
        at = [np.searchsorted(entries, e) for e in (word_entries(block.own), word_entries(block.before), bigram_entries(block.before, block.own))]
        sums = [np.bincount(owner, totals.losses(*(c[i] for i in at), total), len(block.sizes)) for c, total in ((counts[1], totals.target), (counts[0], totals.background))]
        arrays = [pa.array(row["rows"], pa.int64()), pa.array(row["ids"], pa.int64()), pa.array(block.sizes), *(pa.array(x.astype(float)) for x in sums)]  # of nothing, bincount gives whole numbers
        return pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n", "t", "b"])

    now: dict | None = None
    answers: list[bytes] = []
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if row["slice"] < 0:
                if now:
                    yield scored(now, answers)
                now, answers = row, []
            else:
                answers.append(row["answer"])
    if now:
        yield scored(now, answers)


_BLOCK = "block long, n_words long, rows array<long>, ids array<long>, before array<binary>, sizes array<long>, data binary"


def score(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, difference), a row for each row of `docs`.

    Both models are counted over `docs`: the background over all, the target over those whose id is in
    target_ids' column doc_id, which may repeat. Null and empty texts have no words, and their losses are 0. Rows that
    repeat a doc_id are texts of their own. Null ids are no target. Without target documents the target
    model is uniform over the vocabulary and the unknown word.
    """
    picked = docs.select(*column_names(docs, doc_id=id_col, text=text_col)).withColumn("doc_id", F.col("doc_id").cast("long"))
    blocks = written(picked.mapInArrow(lambda batches: _blocks(batches, block), _BLOCK))
    words = blocks.agg(F.sum("n_words")).first()[0] or 0
    slices = 2 * words // slice_ + 1
    # narrow rows of both sides meet by id; what is found goes to the blocks, the texts stay out of it
    named = blocks.select("block", F.explode(F.arrays_zip("rows", "ids")).alias("r")).select("block", F.col("r.rows").alias("row"), F.col("r.ids").alias("doc_id"))
    wanted = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    targets = named.join(wanted.hint("merge"), "doc_id").groupBy("block").agg(F.collect_set("row").alias("target"))
    asked = blocks.join(targets.hint("merge"), "block", "left").mapInArrow(lambda batches: _questions(batches, slices), "slice long, block long, data binary")
    answers = written(asked.repartition("slice").sortWithinPartitions("slice", "block").mapInArrow(_answers, "block long, slice long, data binary, kinds long, n long, t long"))
    totals = Totals(*(x or 0 for x in answers.agg(F.sum("kinds"), F.sum("n"), F.sum("t")).first()))
    both = blocks.select("*", F.lit(-1).cast("long").alias("slice")).unionByName(answers.select("block", "slice", F.col("data").alias("answer")), allowMissingColumns=True)
    parts = both.repartition("block").sortWithinPartitions("block", "slice").mapInArrow(lambda batches: _losses(batches, totals), "row long, doc_id long, n long, t double, b double")
    found = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), *((F.sum(c) / F.greatest(F.sum("n"), F.lit(1))).alias(c) for c in "tb"))
    return found.select("doc_id", "n_tokens", F.col("t").alias("loss_target"), F.col("b").alias("loss_background"), (F.col("t") - F.col("b")).alias("difference"))


#: DuckDB SQL for score() of `documents` against those of quality 1, losses rounded to six places.
SQL = rf"""
WITH words AS (
  SELECT row, doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM (
    SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)
), pairs AS (
  SELECT row, word, coalesce(lag(word) OVER (PARTITION BY row ORDER BY i), '') AS prev, (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL))::INT AS target FROM words
), one AS (SELECT word, count(*) AS b, sum(target) AS t FROM pairs GROUP BY word
), two AS (SELECT prev, word, count(*) AS b, sum(target) AS t FROM pairs GROUP BY ALL
), context AS (
  SELECT word AS prev, b, t FROM one UNION ALL SELECT '', count(*), coalesce(sum(target), 0) FROM pairs WHERE prev = ''
), v AS (SELECT count(*) + 1 AS size, sum(b) AS b, sum(t) AS t FROM one
), loss AS (
  SELECT prev, word,
    -ln((two.t + {PRIOR}::DOUBLE * (one.t + 1) / (v.t + v.size)) / (context.t + {PRIOR}::DOUBLE)) AS t,
    -ln((two.b + {PRIOR}::DOUBLE * (one.b + 1) / (v.b + v.size)) / (context.b + {PRIOR}::DOUBLE)) AS b
  FROM two JOIN one USING (word) JOIN context USING (prev) CROSS JOIN v
), means AS (SELECT row, count(*) AS n, avg(t) AS t, avg(b) AS b FROM pairs JOIN loss USING (prev, word) GROUP BY row)
SELECT doc_id, coalesce(n, 0) AS n_tokens, round(coalesce(t, 0), 6) AS loss_target, round(coalesce(b, 0), 6) AS loss_background, round(coalesce(t - b, 0), 6) AS difference
FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) LEFT JOIN means USING (row)
"""
