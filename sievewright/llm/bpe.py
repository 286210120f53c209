"""Byte-level BPE encoding and decoding with two tiers.

A minimal perfect hash over the vocabulary resolves pre-tokens that are tokens themselves: one slot for each
token and no empty slot, found by hash and displace and confirmed by comparing the bytes. Other
pre-tokens are merged by a heap of ranked pairs over a linked list of their bytes. Each worker remembers
a bounded number of pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_names, columns
from .memo import Memo, kept


def _mix(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    x = h ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: each has a slot of its own in range(len(keys))."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n, self.buckets = len(keys), max(1, len(keys) // per_bucket)
        hashes = self.hashes(keys)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, b in enumerate(bucket.tolist()):
            members[b].append(i)
        self.shift = np.zeros(self.buckets, np.int64)
        free = np.ones(self.n, bool)
        tries = np.arange(256)
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        for at, b in enumerate(order):
            own = hashes[members[b]]
            if len(own) < 2:
                break
            start = 0
            while True:
                slots = (_mix(own[None, :], (tries + start)[:, None]) % np.uint64(self.n)).astype(np.int64)
                fits = free[slots].all(1)
                for t in np.flatnonzero(fits):
                    if len(set(slots[t].tolist())) == len(own):
                        break
                else:
                    start += len(tries)
                    continue
                break
            self.shift[b] = start + t
            free[slots[t]] = False
        else:
            at = self.buckets
        left = iter(np.flatnonzero(free).tolist())
        for b in order[at:]:  # buckets of one name their slot
            if members[b]:
                self.shift[b] = -1 - next(left)

    @staticmethod
    def hashes(keys: Iterable[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """Slot of each key; of a key that isn't in the set, some slot."""
        hashes = self.hashes(keys)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        dealt = (_mix(hashes, np.maximum(shift, 0)) % np.uint64(self.n)).astype(np.int64)
        return np.where(shift < 0, -1 - shift, dealt)


class ByteBPE:
    """A vocabulary of ranked tokens. ranks: token -> id; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.ranks, self.pattern = ranks, pattern
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        self.of_two = [ranks.get(bytes(divmod(k, 256)), -1) for k in range(1 << 16)]
        self.by_slot: list = [None] * len(tokens)
        for t, s in zip(tokens, self.hash.slots(tokens).tolist(), strict=True):
            self.by_slot[s] = (t, (ranks[t],))
        self.name = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        """A file of lines 'base64-token rank'."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: always the leftmost pair of lowest rank is merged next.

        A heap entry is one number made of a pair's rank, start and end. Entries stay when one of
        their two parts is merged otherwise, and are passed over when they come up.
        """
        n, rank, two = len(piece), self.ranks.get, self.of_two
        bits = n.bit_length()
        twice, mask = 2 * bits, (1 << bits) - 1
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [r << twice | i << bits | i + 2 for i, (a, b) in enumerate(pairwise(piece)) if (r := two[a << 8 | b]) >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, end = entry >> bits & mask, entry & mask
            j = after[i]
            if j == 0 or j >= n or after[j] != end:
                continue
            after[i], after[j] = end, 0
            if end < n:
                before[end] = i
                e = after[end]
                if (r := rank(piece[i:e])) is not None:
                    heappush(heap, r << twice | i << bits | e)
            p = before[i]
            if p >= 0 and (r := rank(piece[p:end])) is not None:
                heappush(heap, r << twice | p << bits | end)
        ids, i = [], 0
        while i < n:
            ids.append(rank(piece[i : after[i]]))
            i = after[i]
        return tuple(ids)

    def encode_pieces(self, pieces: list[str]) -> Iterator[tuple[int, ...]]:
        raw = [p.encode() for p in pieces]
        for piece, slot in zip(raw, self.hash.slots(raw).tolist() if raw else (), strict=True):
            token, ids = self.by_slot[slot]
            yield ids if token == piece else self.merge(piece)

    def encode_texts(self, texts: Iterable[str | None]) -> list[list[int]]:
        split = regex.compile(self.pattern).findall
        memo = kept(("bpe", self.name), lambda: Memo(self.encode_pieces, most=300_000))
        out = []
        for text in texts:
            pieces = split(text) if text else []
            out.append(list(chain.from_iterable(map(memo.known(pieces).__getitem__, pieces))))
        return out

    def decoder(self) -> list[bytes | None]:
        tokens: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            tokens[i] = t
        return tokens


def encode(docs: DataFrame, model: ByteBPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary: the bytes that the ids stand for), a row for each row of `docs`.

    Each match of the model's pattern is encoded on its own; there are no special tokens, their strings
    are ordinary text. Null and empty texts have no ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = model.decoder().__getitem__
        for ids, texts in columns(batches, "doc_id", "text", remembers=True):
            codes = model.encode_texts(texts)
            ends = np.cumsum([0, *map(len, codes)])
            flat = pa.array(np.fromiter(chain.from_iterable(codes), np.int32, ends[-1]))
            decoded = pa.array([b"".join(map(token, c)) for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), decoded], ["doc_id", "ids", "decoded"])

    picked = docs.select(*column_names(docs, doc_id=id_col, text=text_col)).withColumn("doc_id", F.col("doc_id").cast("long"))
    return picked.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def decode(encoded: DataFrame, model: ByteBPE, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) of (doc_id, ids); null ids have no bytes, an id without a token is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = model.decoder()
        for keys, codes in columns(batches, "doc_id", "ids"):
            decoded = [b"".join([tokens[i] for i in c or ()]) for c in codes]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(decoded, pa.binary())], ["doc_id", "decoded"])

    picked = encoded.select(*column_names(encoded, doc_id=id_col, ids=ids_col)).withColumn("doc_id", F.col("doc_id").cast("long"))
    return picked.mapInArrow(run, "doc_id long, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what encode() gives."""
    line = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(line, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
