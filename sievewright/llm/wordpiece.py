"""Token counts by linear longest match over a trie with failure links.

Words are cut greedily into the longest vocabulary pieces, the first from the initial pieces, the
others from the continuation pieces. The trie's failure links say where matching goes on when a
byte doesn't fit, and each link carries the precomputed number of pieces that it pops, so that a word is
read once, without going back, and its pieces are counted without being built.
"""

from __future__ import annotations

import base64
import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_names, columns, words_of
from .memo import Memo, kept


class LongestMatch:
    """Automaton over bytes. State 0 starts a word, state 1 goes on with one."""

    def __init__(self, initial: Iterable[bytes], continuation: Iterable[bytes]):
        goto: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[], []]
        final = [False, False]
        for root, pieces in ((0, initial), (1, continuation)):
            for piece in pieces:
                at = root
                for c in piece:
                    if (to := goto.get(at << 8 | c)) is None:
                        to = goto[at << 8 | c] = len(children)
                        children[at].append((c, to))
                        children.append([])
                        final.append(False)
                    at = to
                if at > 1:
                    final[at] = True
        self.goto, n = goto, len(children)
        self.fail: list[int] = [-1] * n  # -1: no cut of what has been read
        self.pops = [0] * n
        queue = deque((0, 1))
        while queue:  # a node's links follow from those of nodes that are nearer to their root
            at = queue.popleft()
            for c, to in children[at]:
                queue.append(to)
                if final[to]:
                    self.fail[to], self.pops[to] = 1, 1
                    continue
                link, pops = self.fail[at], self.pops[at]
                while link >= 0 and (link << 8 | c) not in goto:
                    pops += self.pops[link]
                    link = self.fail[link]
                if link >= 0:
                    self.fail[to], self.pops[to] = goto[link << 8 | c], pops
        self.name = hashlib.sha256(repr((sorted(goto.items()), self.fail)).encode()).hexdigest()

    @classmethod
    def from_file(cls, path: str) -> LongestMatch:
        """A file of lines 'base64-token rank': tokens with a leading space start words, the others go on; each byte can do both."""
        with open(path, "rb") as lines:
            tokens = [base64.b64decode(x.split()[0]) for x in lines if x.strip()]
        single = [bytes([b]) for b in range(256)]
        return cls([*(t[1:] for t in tokens if t[:1] == b" " and len(t) > 1), *single], [*(t for t in tokens if t[:1] != b" "), *single])

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if it can't be cut."""
        goto, fail, pops = self.goto.get, self.fail, self.pops
        at = total = 0
        for c in word:
            while (to := goto(at << 8 | c)) is None:
                if fail[at] < 0:
                    return 0
                total += pops[at]
                at = fail[at]
            at = to
        while at > 1:
            if fail[at] < 0:
                return 0
            total += pops[at]
            at = fail[at]
        return total


def token_counts(docs: DataFrame, model: LongestMatch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_unknown, n_tokens), a row for each row of `docs`.

    Words are [^\\x20\\x09-\\x0D]+ in UTF-8. A word that can't be cut is unknown and counts as one
    token. Null and empty texts have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept(("wordpiece", model.name), lambda: Memo(lambda words: list(map(model.count, words))))
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_unknown": pa.int64(), "n_tokens": pa.int64()}
        for ids, texts in columns(batches, "doc_id", "text", remembers=True):
            rows = []
            for doc, text in zip(ids, texts, strict=True):
                words = words_of(text)
                counts = list(map(memo.known(words).__getitem__, words))
                rows.append((doc, len(words), unknown := counts.count(0), sum(counts) + unknown))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    picked = docs.select(*column_names(docs, doc_id=id_col, text=text_col)).withColumn("doc_id", F.col("doc_id").cast("long"))
    return picked.mapInArrow(run, "doc_id long, n_words long, n_unknown long, n_tokens long")
