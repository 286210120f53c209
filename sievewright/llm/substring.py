"""Substring dedup: suffix trees over groups of suffixes that share a prefix, as long a prefix as memory asks for.

The suffixes are sparse: of each word window of `length` words the `gram`-word sequence that is lightest under a hash,
its anchor, begins one. Equal windows have equal anchors at equal offsets, so a repeat of `length` words has an anchor in both places
and no repeat crosses groups. A suffix comes with the words before it that its windows reach back to: one
segment of text for all windows of one anchor, not one for each.

The first prefix is the anchor itself. A group that is found in one document only has no repeat and is never built. A
group of over `heavy` segments is too large for a task: its prefix is doubled, until it is light or its prefix is a whole
window. As the longer prefix must lie in the window, it begins at the anchor or a fixed number of words before it, by
the anchor's offset; so equal windows still go the same way. Of a window that is still heavy nothing is left to compare:
it is one deep node, of which only the smallest doc_id counts, a minimum with map-side combine.

A group's tree is an enhanced suffix array: ranks by doubling (lengths 1, 2, 4, ... words), the suffixes in
their order, and the words that neighbours share, up to the ends of their segments, found by descending over the
ranks. Nodes that share `length` words or more are the deep ones. What their suffixes share is a repeat; merged along
their documents, repeats are the maximal passages that a document has from another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, column_names, columns, words_of, written

LENGTH, GRAM, HEAVY = 50, 8, 4096
#: A group up to so many times too heavy is parted by a longer prefix; the blocks of a heavier one are made at once.
TWICE = 2
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _gram_hashes(words: list[bytes], gram: int) -> np.ndarray:
    """A hash of each sequence of `gram` words (a power of two)."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    step = 1
    while step < gram:
        h = (h[:-step] * _MIX[0]) ^ (h[step:] * _MIX[1] + _MIX[2])
        h = (h ^ (h >> np.uint64(31))) * _MIX[2]
        step *= 2
    return h


def anchors(words: list[bytes], length: int = LENGTH, gram: int = GRAM, at_once: int = 1 << 18) -> tuple[np.ndarray, ...]:
    """Anchors of a document's windows, in order: hash, first and last window that have it, and its own place."""
    none = np.empty(0, np.int64)
    if len(words) < length:
        return none, none, none, none
    hashes, span = _gram_hashes(words, gram), length - gram + 1
    windows, at = len(words) - length + 1, []
    low = np.uint64((1 << 20) - 1)
    for k in range(0, windows, at_once):
        own = hashes[k : k + min(at_once, windows - k) + span - 1]
        least = (own & ~low) | np.arange(len(own), dtype=np.uint64)  # of equal ones the leftmost
        step = 1
        while 2 * step <= span:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if span > step:
            least = np.minimum(least[: step - span], least[span - step :])
        at.append((least & low).astype(np.int64) + k)
    at = np.concatenate(at)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], windows) - 1
    return hashes[at[first]].view(np.int64), first, last, at[first]


# --- prefixes ---------------------------------------------------------------------------------------


def prefix_lengths(length: int = LENGTH, gram: int = GRAM) -> list[int]:
    """The anchor's, doubled as long as it is shorter than a window, and a window's."""
    out = [gram]
    while 2 * out[-1] < length:
        out.append(2 * out[-1])
    return [*out, length] if out[-1] < length else out


def words_before(offset: int, prefix: int, length: int) -> int:
    """How many words before an anchor the prefix of its windows with this offset begins: it then lies in the window."""
    step = max(1, length - prefix)
    return -(-max(0, offset + prefix - length) // step) * step


def longer(words: list[bytes], first: int, last: int, at: int, prefix: int, length: int) -> Iterator[tuple[bytes, int, int]]:
    """(key of the prefix, first window, last window) of what a segment falls into; `words` begin with the first window."""
    w = first
    while w <= last:
        before = words_before(at - w, prefix, length)
        stop = w
        while stop < last and words_before(at - stop - 1, prefix, length) == before:
            stop += 1
        begin = at - before - first
        yield xxhash.xxh3_128_digest(b" ".join(words[begin : begin + prefix]), seed=before << 32 | prefix), w, stop
        w = stop + 1


# --- trees ------------------------------------------------------------------------------------------


class SuffixTree:
    """Enhanced suffix array of some suffixes of segments.

    words: the numbered words of all segments, one after the other, each followed by a number of its own that no other
    place has. starts: where the suffixes start. longest: words of the longest suffix, at most.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, longest: int):
        top = int(words.max(initial=0)) + 1
        ranks, size = [np.concatenate((words.astype(np.int64), np.arange(top, top + 2 * longest + 2)))], 1
        while 2 * size <= longest:
            a = ranks[-1]
            ranks.append(np.unique(a[:-size] * (a.max() + 1) + a[size:], return_inverse=True)[1])
            size *= 2
        a = ranks[-1]
        order = np.argsort(a[starts] * (a.max() + 1) + a[np.minimum(starts + size, len(a) - 1)], kind="stable")
        self.order, self.suffixes = order, starts[order]
        one, two = self.suffixes[:-1], self.suffixes[1:]
        self.common = np.zeros(len(one), np.int64)  # words that neighbours share
        for rank, n in zip(ranks[::-1], (1 << k for k in range(len(ranks) - 1, -1, -1)), strict=True):
            i, j = one + self.common, two + self.common
            self.common += n * (rank[np.minimum(i, len(rank) - 1)] == rank[np.minimum(j, len(rank) - 1)])

    def deep_nodes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(order of the suffixes, first of each node): the nodes nearest to the root that share `length` words; a node of one suffix is a leaf."""
        return self.order, np.flatnonzero(np.concatenate(([True], self.common < length)))

    def internal_nodes(self, length: int) -> list[tuple[int, int, int]]:
        """(shared words, first, last place in the order) of every internal node that shares `length` words or more, by a stack over `common`."""
        out: list[tuple[int, int, int]] = []
        stack: list[tuple[int, int]] = []  # (shared words, first)
        for k, n in enumerate([*self.common.tolist(), 0]):
            first = k
            while stack and stack[-1][0] > n:
                depth, first = stack.pop()
                out.append((depth, first, k))
            if n >= length and (not stack or stack[-1][0] < n):
                stack.append((n, first))
        return out


@dataclass
class Repeats:
    """Runs of windows whose words a smaller doc_id has too, and where it has them: the smallest such doc_id's first place."""

    segment: np.ndarray
    first: np.ndarray
    last: np.ndarray
    source: np.ndarray
    source_first: np.ndarray
    least: tuple[np.ndarray, np.ndarray, list[bytes]]  # of segments of blocks (segment, window, digest): windows that no smaller doc_id here has


def repeats(docs: np.ndarray, segments: list[bytes], from_: np.ndarray, to: np.ndarray, split: np.ndarray, length: int) -> Repeats:
    """What the deep nodes say of the segments of whole groups, or (split) of blocks; from_ and to are the segments' windows."""
    ids: dict = {}
    words_of_each = [t.split() for t in segments]
    flat: list[int] = []
    for own in words_of_each:
        flat += [ids.setdefault(w, len(ids)) for w in own]
        flat.append(-1)
    words = np.array(flat, np.int64)
    ends = np.flatnonzero(words < 0)
    words[ends] = len(ids) + np.arange(len(ends))
    offset = np.concatenate(([0], ends[:-1] + 1))
    n = to - from_ + 1
    segment = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    tree = SuffixTree(words, offset[segment] + place, max(map(len, words_of_each), default=1))
    order, first = tree.deep_nodes(length)
    sizes = np.diff(np.append(first, len(order)))
    doc, window = docs[segment], from_[segment] + place
    least, least_at = np.empty_like(doc), np.empty_like(window)
    lowest = np.repeat(np.minimum.reduceat(doc[order], first), sizes)
    least[order] = lowest
    least_at[order] = np.repeat(np.minimum.reduceat(np.where(doc[order] == lowest, window[order], np.iinfo(np.int64).max), first), sizes)
    hit = np.flatnonzero(doc > least)
    seg, w, src, src_w = segment[hit], window[hit], least[hit], least_at[hit]
    goes_on = (seg[1:] == seg[:-1]) & (w[1:] == w[:-1] + 1) & (src[1:] == src[:-1]) & (src_w[1:] == src_w[:-1] + 1)
    begin = np.flatnonzero(np.concatenate(([True], ~goes_on))[: len(hit)])
    end = np.append(begin[1:], len(hit))[: len(begin)] - 1
    open_ = np.flatnonzero((doc == least) & split[segment])
    digests = [xxhash.xxh3_128_digest(b" ".join(words_of_each[i][p : p + length])) for i, p in zip(segment[open_].tolist(), place[open_].tolist(), strict=True)]
    return Repeats(seg[begin], w[begin], w[end], src[begin], src_w[begin], (segment[open_], window[open_], digests))


# --- the passes -------------------------------------------------------------------------------------

_SEEN = "doc_id long, text_hash long, n_words long, sequence binary, hashes array<long>, first array<int>, last array<int>, at array<int>"


def _digests(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_hash", "n_words", "sequence", "hashes", "first", "last", "at"]
    for ids, texts in columns(batches, "doc_id", "text"):
        out: list[list] = [ids, [], [], [], [], [], [], []]
        for text in texts:
            words = words_of(text)
            found = anchors(words, length, gram)
            row = (_text_hash(text), len(words), xxhash.xxh3_128_digest(b" ".join(words)), *found)
            for col, value in zip(out[1:], row, strict=True):
                col.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def _text_hash(text: str | None) -> int:
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (h >> 63 << 64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the exchanges."""
    pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
    for ids, texts in columns(batches, "doc_id", "text"):
        arrays = [pa.array(ids, pa.int64()), pa.array(map(_text_hash, texts), pa.int64()), pa.array([pack((t or "").encode()) for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "packed"])


#: A segment (key, windows first..last, the anchor's place, text, segments of the group that it was in): open, to be sized by its new key, or to be built, with a whole group or (split) a block of one.
_SEGMENTS = {"key": pa.binary(), "open": pa.bool_(), "split": pa.bool_(), "doc_id": pa.int64(), "text_hash": pa.int64(), "first": pa.int64(), "last": pa.int64(), "at": pa.int64(), "segment": pa.binary(), "parent": pa.int64()}
_SEGMENTS_SCHEMA = "key binary, open boolean, split boolean, doc_id long, text_hash long, first long, last long, at long, segment binary, parent long"
#: What a pass gives: repeated spans with their source; blocks' windows that are still open (key: their digest); open segments, with their text.
_ROWS = {"key": pa.binary(), "doc_id": pa.int64(), "text_hash": pa.int64(), "first": pa.int64(), "last": pa.int64(), "at": pa.int64(), "segment": pa.binary(), "parent": pa.int64(), "source": pa.int64(), "source_first": pa.int64()}
_ROWS_SCHEMA = "key binary, doc_id long, text_hash long, first long, last long, at long, segment binary, parent long, source long, source_first long"


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def _parts(r: dict, words: list[bytes], prefix: int, length: int, heavy: int) -> list[tuple]:
    """What becomes of a segment whose group has r["n"] of them: built, or parted by a longer prefix, or dealt into a block."""
    key, doc, text_hash, first, last, at, n = r["key"], r["doc_id"], r["text_hash"], r["first"], r["last"], r["at"], r["n"]
    if n <= heavy:
        return [(key, False, False, doc, text_hash, first, last, at, b" ".join(words), n)]
    if prefix == length or n > TWICE * heavy:
        block = xxhash.xxh64_intdigest(b"%d %d" % (doc, text_hash)) % -(-n * 3 // (2 * heavy))
        return [(key + block.to_bytes(8, "little"), False, True, doc, text_hash, first, last, at, b" ".join(words), n)]
    return [(k, True, False, doc, text_hash, lo, hi, at, b" ".join(words[lo - first : hi - first + length]), n) for k, lo, hi in longer(words, first, last, at, prefix, length)]


def _segments(batches: Iterator[pa.RecordBatch], length: int, prefix: int, heavy: int) -> Iterator[pa.RecordBatch]:
    """Documents with their repeated anchors and their numbers -> the anchors' segments, those of heavy ones by the next `prefix`."""
    unpack = zstandard.ZstdDecompressor().decompress
    for ids, hashes, texts, found in columns(batches, "doc_id", "text_hash", "packed", "found", at_once=64):
        out: list[tuple] = []
        for doc, text_hash, packed, anchors_ in zip(ids, hashes, texts, found, strict=True):
            words = unpack(packed).split()
            for a in anchors_:
                row = a | {"key": a["hash"].to_bytes(8, "little", signed=True), "doc_id": doc, "text_hash": text_hash}
                out += _parts(row, words[a["first"] : a["last"] + length], prefix, length, heavy)
        if out:
            yield _batch(out, _SEGMENTS)


def _again(batches: Iterator[pa.RecordBatch], length: int, prefix: int, heavy: int) -> Iterator[pa.RecordBatch]:
    """The size of a group, if it is one of several documents, then its open segments -> the light ones to be built, the heavy ones by the next `prefix`."""
    now: tuple | None = None
    n = 0
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            out: list[tuple] = []
            for r in batch.slice(k, 256).to_pylist():
                if r["n"] is not None:
                    now, n = (r["key"], r["salt"]), r["n"]
                elif (r["key"], r["salt"]) == now:
                    out += _parts(r | {"n": n}, r["segment"].split(), prefix, length, heavy)
            if out:
                yield _batch(out, _SEGMENTS)


def _trees(batches: Iterator[pa.RecordBatch], length: int, at_once: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Segments, those of a light group or block next to each other -> spans that a smaller doc_id has too, and blocks' open windows; open segments pass.

    Groups are built together up to `at_once` bytes of text; a single group has `heavy` segments at most, a block about as many.
    """

    def build(rows: pa.Table) -> pa.RecordBatch:
        docs, hashes, first, last = (rows.column(c).to_numpy() for c in ("doc_id", "text_hash", "first", "last"))
        r = repeats(docs, rows.column("segment").to_pylist(), first, last, rows.column("split").to_numpy(), length)
        seg, at, digests = r.least
        both, few, many = np.concatenate((r.segment, seg)), [None] * len(r.segment), [None] * len(seg)
        values = (few + digests, docs[both], hashes[both], np.concatenate((r.first, at)), np.concatenate((r.last, at)), few + many, few + many, few + many, r.source.tolist() + many, r.source_first.tolist() + many)
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, _ROWS.values(), strict=True)], list(_ROWS))

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        open_ = batch.column("open")
        passes, batch = batch.filter(open_), batch.filter(pc.invert(open_))
        if passes.num_rows:
            none = pa.nulls(passes.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(passes.column(c) for c in list(_ROWS)[:8]), none, none], list(_ROWS))
        for k in range(0, batch.num_rows, 2048):
            part = batch.slice(k, 2048)
            held.append(part)
            size += part.nbytes
            if size < at_once:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows.column("key").to_pylist()
            cut = next(i for i in range(len(keys)) if keys[i] == keys[-1])  # sorted: the last group may go on
            if cut:
                yield build(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield build(pa.Table.from_batches(held))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    unpack = zstandard.ZstdDecompressor().decompress
    for ids, texts, spans, copies in columns(batches, "doc_id", "packed", "spans", "copy"):
        out: list[list] = [ids, [], [], [], []]
        for packed, found, copy in zip(texts, spans, copies, strict=True):
            words = unpack(packed).split()
            n = len(words)
            if copy:
                words = []
            elif found:
                drop = np.zeros(n + 1, np.int64)
                for s in found:
                    drop[s["start"]] += 1
                    drop[s["stop"]] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
            kept = b" ".join(words)
            for col, value in zip(out[1:], (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                col.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*arrays[:4], arrays[4].cast(pa.string())], names)


def _sized(rows: DataFrame, key: str) -> DataFrame:
    """`rows` whose key more than one doc_id has, with `n`, the number of rows that have it. A count with map-side
    combine; both sides of the join are exchanged, so that a hot key can be split."""
    shared = rows.groupBy(key).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    return rows.join(shared.select(apart(key), "n"), key)


def _with_sizes(open_: DataFrame, heavy: int) -> DataFrame:
    """Open segments, with `salt`, after a row that has their group's size `n`, if more than one doc_id has its key.

    A group's rows are dealt over as many salts as the group that they come from had blocks, and so is its size, so that a hot
    group is in no one task and no join has to find it.
    """
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("parent") * 3 / (2 * heavy)).cast("long"))
    counts = open_.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"), F.max("parent").alias("parent")).where("lo < hi")
    sizes = counts.select("key", "n", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("salt"))
    dealt = open_.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), blocks))
    both = sizes.unionByName(dealt, allowMissingColumns=True)
    return both.repartition("key", "salt").sortWithinPartitions("key", "salt", F.col("n").asc_nulls_last())


@dataclass
class Found:
    """texts: (doc_id, text_hash, packed), a row for each document. spans: (doc_id, text_hash, start, stop, source, source_start), not yet merged.
    copies: (doc_id, text_hash, source, n_words): documents whose words are all those of a smaller doc_id."""

    texts: DataFrame
    spans: DataFrame
    copies: DataFrame


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, heavy: int = HEAVY) -> Found:
    """What a smaller doc_id has too. Of documents with equal words only the one of smallest doc_id goes into trees: for the others it is the source of all their words."""
    picked = docs.select(*column_names(docs, doc_id=id_col, text=text_col)).withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = picked.mapInArrow(_packed, "doc_id long, text_hash long, packed binary")
    seen = written(picked.where("doc_id is not null").mapInArrow(lambda batches: _digests(batches, length, gram), _SEEN).where(f"n_words >= {length}"))
    least = seen.groupBy("sequence").agg(F.min("doc_id").alias("least"))
    marked = seen.join(least.select(F.concat("sequence", F.lit(b"")).alias("sequence"), "least"), "sequence")
    copies = marked.where("doc_id > least").select("doc_id", "text_hash", F.col("least").alias("source"), "n_words").distinct()
    occurs = marked.where("doc_id = least").select("doc_id", "text_hash", F.explode(F.arrays_zip("hashes", "first", "last", "at")).alias("a"))
    occurs = occurs.select("doc_id", "text_hash", F.col("a.hashes").alias("hash"), *(F.col(f"a.{c}").alias(c) for c in ("first", "last", "at")))
    lists = _sized(occurs, "hash").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("hash", "first", "last", "at", "n")).alias("found"))
    held = texts.join(lists, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", "packed", "found")

    def built(segments: DataFrame) -> DataFrame:
        # what is open only passes: it goes anywhere, so that a hot group doesn't go to one task
        dealt = F.when(F.col("open"), F.xxhash64("key", "doc_id", "first")).otherwise(F.xxhash64("key"))
        rows = segments.withColumn("dealt", dealt).repartition("dealt").sortWithinPartitions("dealt", "key").drop("dealt")
        return written(rows.mapInArrow(lambda batches: _trees(batches, length), _ROWS_SCHEMA))

    second, *rest = [*prefix_lengths(length, gram)[1:], length]
    passes = [built(held.mapInArrow(lambda batches: _segments(batches, length, second, heavy), _SEGMENTS_SCHEMA))]
    for prefix in rest:
        open_ = passes[-1].where("segment is not null").drop("source", "source_first")
        if open_.isEmpty():
            break
        passes.append(built(_with_sizes(open_, heavy).mapInArrow(lambda batches, p=prefix: _again(batches, length, p, heavy), _SEGMENTS_SCHEMA)))
    spans, windows = None, None
    for rows in passes:
        some = rows.where("source is not null").select("doc_id", "text_hash", F.col("first").alias("start"), (F.col("last") + length).alias("stop"), "source", F.col("source_first").alias("source_start"))
        whole = rows.where("key is not null and segment is null").select("key", "doc_id", "text_hash", "first")
        spans, windows = (some, whole) if spans is None else (spans.unionByName(some), windows.unionByName(whole))
    nodes = windows.groupBy("key").agg(F.min(F.struct("doc_id", "first")).alias("least"))
    deep = windows.join(nodes.select(F.concat("key", F.lit(b"")).alias("key"), "least"), "key").where("doc_id > least.doc_id")
    single = deep.select("doc_id", "text_hash", F.col("first").alias("start"), (F.col("first") + length).alias("stop"), F.col("least.doc_id").alias("source"), F.col("least.first").alias("source_start"))
    return Found(texts, spans.unionByName(single), copies)


def maximal_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, start, stop, source, source_start): passages of `length` words or more that a smaller doc_id has too, in words.

    For each window the source is the smallest doc_id that has it, at its first place there, but in a group that is heavy to the
    end the smallest one of a block; windows that follow each other
    in both documents are one passage, which can't be made longer with this source. A copy is one passage.
    """
    found = repeated_spans(docs, id_col, text_col, length, gram, heavy)
    keys = ["doc_id", "text_hash", "source", (F.col("start") - F.col("source_start")).alias("shift")]
    rows = found.spans.select(*keys, "start", "stop").distinct()
    order = Window.partitionBy("doc_id", "text_hash", "source", "shift").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    grouped = marked.withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy("doc_id", "text_hash", "source", "shift", "passage").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    zero = F.lit(0).cast("long")
    copies = found.copies.select("doc_id", zero.alias("start"), F.col("n_words").alias("stop"), "source", zero.alias("source_start"))
    return merged.select("doc_id", "start", "stop", "source", (F.col("start") - F.col("shift")).alias("source_start")).unionByName(copies)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept), a row for each row of `docs`.

    Removes each word that a window of `length` words covers whose word sequence also starts in a
    document with a smaller doc_id; windows are judged on the input. Null and empty texts have no
    words. Rows that repeat a doc_id don't count against each other; rows with a null doc_id
    lose nothing and count against none.
    """
    found = repeated_spans(docs, id_col, text_col, length, gram, heavy)
    spans = found.spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    copies = found.copies.select("doc_id", "text_hash", F.lit(None).cast("array<struct<start:bigint,stop:bigint>>").alias("spans"), F.lit(True).alias("copy"))
    both = spans.withColumn("copy", F.lit(False)).unionByName(copies)
    joined = found.texts.join(both, ["doc_id", "text_hash"], "left").select("doc_id", "packed", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))
    return joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


#: DuckDB SQL for remove_repeats() of `documents` without the kept text, by comparing all windows.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), k AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM k) WHERE doc_id > least
), marked AS (
  SELECT p.doc_id, j, word, max(hit.i) OVER (PARTITION BY p.doc_id ORDER BY j ROWS UNBOUNDED PRECEDING) >= j - 49 AS gone
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) p LEFT JOIN hit ON hit.doc_id = p.doc_id AND hit.i = j
), s AS (
  SELECT doc_id, count(*) FILTER (coalesce(gone, FALSE)) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT coalesce(gone, FALSE)) AS kept FROM marked GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""
