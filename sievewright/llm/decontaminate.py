"""Benchmark decontamination: BM25 retrieval of test items by block-max WAND, then verification of overlap.

The test items, cut into parts of at most 64 words, are the indexed documents; every training passage
(128 words, a new one every 64) is a query. Scores are divided by each part's threshold, so that one
bound, 1, holds for all. The threshold is the score that a passage must have if it holds `least` of the
part's word shingles: the part's own score less what its heaviest words could take away. Each of an
item's shingles is in one part, so an item of which `least` is held has a part of which `least` is held.
Parts only retrieve: what counts is the whole item, its question and its answer, held against the words around the place.

Most passages can reach no part: over the arrays of a batch, block maxima alone tell which passages have a block in which
they could (its words of least weight, which can't reach `free` together, count at their most). Each of these
few passages goes through its words' postings by WAND: cursors in the order of their current parts, the
pivot where their maxima first reach the bound, the pivot's block maxima before any score, and, if these stay under the bound, a leap
beyond the block.

Items beyond SHARD_BYTES are indexed in shards. A shard is a pass over the documents that writes down its hits, so that
one index at a time is with the driver and the workers.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_names, columns, numbered, written

WIDTH, LEAST, SIDE = 5, 0.8, 0.5
PART, STEP = 64, 64
#: Items are indexed and broadcast so many UTF-8 bytes at a time; more take more passes over the documents.
SHARD_BYTES = 4 << 20
_SEPARATORS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """Lower-case words, split at ASCII characters that are neither letters nor digits."""
    return text.lower().encode().translate(_SEPARATORS).split() if text else []


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's answer is what follows its last question mark, else its last line, else its last sentence, else its second half."""
    text = text.strip()
    for ends in ("?", "\n", ".!"):
        follows = False  # whether a word comes after this place
        for i in range(len(text) - 1, -1, -1):
            if text[i].isalnum():
                follows = True
            elif follows and text[i] in ends and (ends != ".!" or text[i + 1].isspace()):
                return text[: i + 1], text[i + 1 :]
    words = text.split()
    return " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])


def shingles(words: list[bytes], width: int = WIDTH) -> set[tuple]:
    """Distinct sequences of `width` words; all words if there are fewer."""
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@dataclass(frozen=True)
class Part:
    item: int
    words: list[bytes]
    split: int  # of the words, those before it belong to the question
    start: int = 0  # place in the item
    whole: Part | None = None  # the item, if it has more parts


def parts_of(item: int, text: str | None, width: int = WIDTH) -> list[Part]:
    """Parts of PART words, each shingle of the item in one of them; no part for an item without words."""
    question, answer = map(normal_words, question_and_answer(text or ""))
    words = question + answer
    step = PART - width + 1
    starts = range(0, max(1, len(words) - width + 1), step) if words else ()
    whole = Part(item, words, len(question)) if len(starts) > 1 else None
    return [Part(item, words[s : s + PART], min(max(0, len(question) - s), PART), s, whole) for s in starts]


def overlaps(part: Part, passage: list[bytes], width: int = WIDTH) -> tuple[float, float, float]:
    """Shares of the part's, its question's and its answer's shingles that the passage holds; 1 for a side without words."""
    have: dict[int, set] = {}

    def share(words: list[bytes]) -> float:
        wanted = shingles(words, width)
        if not wanted:
            return 1.0
        n = min(width, len(words))
        if n not in have:
            have[n] = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
        return len(wanted & have[n]) / len(wanted)

    return share(part.words), share(part.words[: part.split]), share(part.words[part.split :])


def around(part: Part, words: list[bytes], at: int) -> tuple[float, float, float]:
    """overlaps() of the part's whole item with the words that it would cover, and PART more on either side, if the part is in the passage at `at`."""
    if not part.whole:
        return overlaps(part, words[at : at + STEP + PART])
    rest = len(part.whole.words) - part.start
    return overlaps(part.whole, words[max(0, at - part.start - PART) : at + STEP + PART + rest])


def expanded(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, index) for each index of each range start..stop."""
    n = stop - start
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


class Index:
    """BM25 postings of parts, in blocks of `block` parts with the maximum of each word's scores."""

    def __init__(self, parts: list[Part], k1: float = 1.2, b: float = 0.75, block: int = 8, least: float = LEAST, width: int = WIDTH, free: float = 0.3):
        self.parts, self.block, self.free = parts, block, free
        mean = sum(len(p.words) for p in parts) / max(1, len(parts))
        within = Counter(w for p in parts for w in set(p.words))
        scores: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for i, p in enumerate(parts):
            own = {}
            for w, tf in Counter(p.words).items():
                idf = math.log(1 + (len(parts) - within[w] + 0.5) / (within[w] + 0.5))
                own[w] = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(p.words) / mean))
            missing = int((1 - least) * len(shingles(p.words, width)) + 1e-9)  # so many shingles, and words, can be missing
            bound = sum(sorted(own.values(), reverse=True)[missing:])
            for w, s in own.items():
                scores[w].append((i, s / bound / (1 - 1e-9)))
        words = sorted(scores, key=lambda w: (max(s for _, s in scores[w]), w))  # a word's number grows with its weight
        self.number = {w: t for t, w in enumerate(words)}
        self.most = np.array([max(s for _, s in scores[w]) for w in words])
        self.first = np.cumsum([0, *(len(scores[w]) for w in words)])
        self.part = np.array([i for w in words for i, _ in scores[w]], np.int64)
        self.score = np.array([s for w in words for _, s in scores[w]])
        word = np.repeat(np.arange(len(words)), np.diff(self.first))
        self.blocks = max(1, -(-len(parts) // block))
        key = word * self.blocks + self.part // block
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        self.block_key = key[start]
        self.block_most = np.maximum.reduceat(self.score, start) if len(key) else np.empty(0)
        self.block_bound = dict(zip(self.block_key.tolist(), self.block_most.tolist(), strict=True))
        self.block_first = np.searchsorted(self.block_key, np.arange(len(words) + 1) * self.blocks)

    def retrieve(self, passage: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries as (passage, word) pairs -> (passage, part, score) of all scores of 1 or more."""
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if not len(word):
            return none
        pairs = np.unique(passage * len(self.most) + word)  # by passage, then by weight
        passage, word = np.divmod(pairs, len(self.most))
        weight = self.most[word]
        begin = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        size = np.diff(np.append(begin, len(passage)))
        sums = np.cumsum(weight)
        before = np.repeat(sums[begin] - weight[begin], size)
        within = sums - before
        alive = np.repeat(within[begin + size - 1] >= 1 - 1e-6, size)
        essential = alive & (within >= self.free)
        owner = np.repeat(np.arange(len(begin)), size)
        left_out = np.bincount(owner, np.where(essential, 0, weight), len(begin))
        at = np.flatnonzero(essential)
        which, posting = expanded(self.block_first[word[at]], self.block_first[word[at] + 1])
        cell = owner[at][which] * self.blocks + self.block_key[posting] % self.blocks
        cells, where = np.unique(cell, return_inverse=True)
        bound = np.bincount(where, self.block_most[posting], len(cells)) + left_out[cells // self.blocks]
        live = np.unique(cells[bound >= 1 - 1e-6] // self.blocks)
        out: list[tuple[int, int, float]] = []
        for q in live.tolist():
            out += ((int(passage[begin[q]]), part, score) for part, score in self.wand(word[begin[q] : begin[q] + size[q]].tolist()))
        return tuple(np.array(c, k) for c, k in zip(zip(*out, strict=True), (np.int64, np.int64, float), strict=True)) if out else none

    def wand(self, words: list[int], bound: float = 1.0) -> list[tuple[int, float]]:
        """(part, score) of every part that the query of these different words scores `bound` or more, by block-max WAND."""
        near, sure = bound - 1e-6, bound - 1e-9
        most = self.most[words].tolist()
        parts = [self.part[self.first[w] : self.first[w + 1]].tolist() for w in words]
        scores = [self.score[self.first[w] : self.first[w + 1]].tolist() for w in words]
        at = [0] * len(words)
        order = sorted((p[0], t) for t, p in enumerate(parts))  # (current part, term) of each cursor that isn't at its end
        out = []

        def move(n: int, to: int) -> None:
            """The first n cursors to the first part from `to` on."""
            moved = []
            for _, t in order[:n]:
                at[t] = bisect_left(parts[t], to, at[t])
                if at[t] < len(parts[t]):
                    moved.append((parts[t][at[t]], t))
            order[:n] = moved
            order.sort()

        while order:
            reach, n = 0.0, 0
            for _, t in order:
                reach += most[t]
                n += 1
                if reach >= near:
                    break
            else:
                return out  # all that is left can't reach the bound
            pivot = order[n - 1][0]
            while n < len(order) and order[n][0] == pivot:
                n += 1
            block = pivot // self.block
            if sum(self.block_bound.get(words[t] * self.blocks + block, 0.0) for _, t in order[:n]) < near:
                move(n, min((block + 1) * self.block, order[n][0] if n < len(order) else (block + 1) * self.block))
            elif order[0][0] == pivot:
                score = sum(scores[t][at[t]] for _, t in order[:n])
                if score >= sure:
                    out.append((pivot, score))
                move(n, pivot + 1)
            else:
                move(n, pivot)
        return out


def matches(texts: list[str | None], index: Index, least: float = LEAST, side: float = SIDE, whole: bool = False) -> list[dict[int, float]]:
    """For each text, item -> largest overlap of a part. The sides are the part's; with `whole` they, and another LEAST, are the item's."""
    words = [normal_words(t) for t in texts]
    number = index.number.get
    codes = np.fromiter((number(w, -1) for ws in words for w in ws), np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(codes)) - start[row] if len(codes) else codes
    hit = codes >= 0
    codes, row, k = codes[hit], row[hit], place[hit] // STEP
    first = np.cumsum(sizes // STEP + 1) - (sizes // STEP + 1)  # number of each text's first passage
    passage = first[row] + k
    second = k > 0
    found = index.retrieve(np.concatenate((passage, passage[second] - 1)), np.concatenate((codes, codes[second])))
    out: list[dict[int, float]] = [{} for _ in texts]
    owner = np.searchsorted(first, found[0], side="right") - 1
    for doc, p, part in zip(owner.tolist(), (found[0] - first[owner]).tolist(), found[1].tolist(), strict=True):
        entry = index.parts[part]
        shares = overlaps(entry, words[doc][p * STEP : p * STEP + STEP + PART])
        if shares[0] < least:
            continue
        item = around(entry, words[doc], p * STEP) if whole else shares
        if item[0] >= least and min(item[1:]) >= side:
            out[doc][entry.item] = max(shares[0], out[doc].get(entry.item, 0.0))
    return out


def _shards(benchmark: DataFrame, shard_bytes: int) -> tuple[int, Iterator[Index]]:
    """(number, indexes) of the items, each of a bounded size: items are dealt by a hash of their id into as many shards as their bytes ask for."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // shard_bytes)

    def indexes() -> Iterator[Index]:
        for k in range(shards):
            own = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k).where("item_id is not null")
            rows = sorted((r.item_id, r.text) for r in own.where("text is not null").distinct().toLocalIterator())
            yield Index([p for item, text in rows for p in parts_of(item, text)])

    return shards, indexes()


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(*column_names(benchmark, item_id=item_col, text=item_text_col)).withColumn("item_id", F.col("item_id").cast("long"))


def hits(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, text_hash, item, overlap) of the items that are found in the texts of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, texts in columns(batches, "doc_id", "text_hash", "text"):
            rows = [(d, h, i, s) for d, h, found in zip(ids, hashes, matches(texts, index, whole=True), strict=True) for i, s in found.items()]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "text_hash", "item", "overlap"])

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, item long, overlap double")


def _all_hits(docs: DataFrame, indexes: Iterator[Index]) -> DataFrame:
    """hits() of every shard, a pass each; the same text of the same doc_id counts once."""
    found = None
    for index in indexes:
        some = written(hits(docs, index))
        found = some if found is None else found.unionByName(some)
    return found.distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_items long, items string: 'item:overlap' by item, comma-joined, contaminated boolean), a row for each row of `docs`.

    An item is found in a document if LEAST of its word shingles, and SIDE of its question's and of its
    answer's, are around one place. `overlap` is the largest of its parts'. Null and empty texts hold no item; null
    and empty items are in no document; repeated rows of either side change nothing.
    """
    picked = docs.select(*column_names(docs, doc_id=id_col, text=text_col)).withColumn("doc_id", F.col("doc_id").cast("long"))
    shards, indexes = _shards(_items(benchmark, item_col, item_text_col), shard_bytes)
    if shards == 1:
        found = picked.mapInArrow(_runner(next(indexes)), "doc_id long, items string")
    elif shards:
        keys = [F.col("doc_id").eqNullSafe(F.col("_d")), F.col("text_hash") == F.col("_h")]
        line = F.struct("item", F.format_string("%d:%.4f", "item", "overlap").alias("text"))
        listed = _all_hits(picked, indexes).groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.array_sort(F.collect_list(line)).alias("_l"))
        rows = picked.select("doc_id", F.xxhash64("text").alias("text_hash")).join(listed, keys[0] & keys[1], "left")
        found = rows.select("doc_id", F.coalesce(F.array_join(F.col("_l.text"), ","), F.lit("")).alias("items"))
    else:
        found = picked.select("doc_id", F.lit("").alias("items"))
    n = F.size(F.filter(F.split("items", ","), lambda x: x != "")).cast("long")
    return found.select("doc_id", n.alias("n_items"), "items").withColumn("contaminated", F.col("n_items") > 0)


def _runner(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches, "doc_id", "text"):
            found = [",".join(f"{i}:{s:.4f}" for i, s in sorted(m.items())) for m in matches(texts, index, whole=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["doc_id", "items"])

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of `docs` in whose text no test item is found, with all of their columns; null texts hold none.

    With several shards, a pass for each, and what is left is written in between.
    """
    kept, text = numbered(docs), f"c{docs.columns.index(text_col)}"
    shards, indexes = _shards(_items(benchmark, item_col, item_text_col), shard_bytes)
    for k, index in enumerate(indexes):
        kept = kept.mapInArrow(_filter(index, text), kept.schema)
        kept = written(kept) if k + 1 < shards else kept
    return kept.toDF(*docs.columns)


def _filter(index: Index, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean: list[bool] = []
            for (texts,) in columns(iter([batch]), text_col):
                clean += [not m for m in matches(texts, index, whole=True)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run
