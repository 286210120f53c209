"""Toxicity scores of texts restored by a noisy-channel decoder.

Writers hide words by leetspeak (1d10t), spacing (i d i o t) and repetition (idiooot). Each hidden word is a
lattice: a sign may stand for letters or be a sign, a separator may be nothing or end a word, a run of a
letter may stand for one or two. Viterbi finds the letters that a character trigram model, counted over
all documents, and the channel's costs make likeliest; a word with one reading only is its own
restoration. A word with a doubled letter and words joined by separators are taken as they stand and as
they decode. The restored words are then scored.

The score is learned from a bounded sample of labelled rows. Each whole word and each beginning and
end of 4 to 6 letters has the lower confidence bound of its log odds between the classes; a word
has the largest of its parts', a document its two largest words' and, if only one word is marked, that one's again; a logistic
regression, fitted on halves that the bounds weren't taken from, makes a probability of them.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import nlargest
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_names, columns, numbered
from .memo import Memo, kept

#: Which letters a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = set(" .-_*'’/~")
#: Costs of the channel, in nats.
SUBSTITUTE, AS_SIGN, SKIP, SHORTEN = 0.7, 6.0, 0.3, 1.5
LETTERS, OTHER, EDGE, KINDS = 26, 26, 27, 28
#: Bound of the labelled sample; fewest toxic documents that a word or part must be in; width of the confidence
#: bound; bounds from which on a word is marked by itself, and a part is strong.
SAMPLE, SUPPORT, Z, MARKED, STRONG = {1: 2000, 0: 4000}, 3, 3.0, 1.5, 2.5

_WORD = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1")
_SIGN = "(?:[^\\W_]|[" + re.escape("".join(c for c in LEET if not c.isalnum())) + "])"
_SPACED = re.compile(rf"(?<![^\W_])(?:{_SIGN}[{re.escape(''.join(sorted(SEPARATORS)))}]{{1,3}}){{2,}}{_SIGN}(?![^\W_])")
_TRIM = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in LEET) + "«»“”„…–—’"


def _kind(c: str) -> int:
    base = unicodedata.normalize("NFD", c.lower())[:1]
    return ord(base) - 97 if "a" <= base <= "z" else OTHER if c.isalpha() else EDGE


_TABLE = np.array([_kind(chr(c)) for c in range(0x250)] + [OTHER], np.int32)


def trigrams(text: str) -> np.ndarray:
    """Cells of the character trigrams of a text between two edges."""
    points = np.frombuffer(f"  {text} ".encode("utf-32-le"), np.uint32)
    kinds = _TABLE[np.minimum(points, 0x250)]
    return (kinds[:-2] * KINDS + kinds[1:-1]) * KINDS + kinds[2:]


def character_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(cell int, n long): trigram counts over all texts; KINDS ** 3 cells at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS**3, np.int64)
        for (texts,) in columns(batches, "text", at_once=64):
            for text in filter(None, texts):
                for k in range(0, len(text), 1 << 20):  # with the two characters before
                    total += np.bincount(trigrams(text[max(0, k - 2) : k + (1 << 20)]), minlength=KINDS**3)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    counts = docs.select(*column_names(docs, text=text_col)).mapInArrow(run, "cell int, n long")
    return counts.groupBy("cell").agg(F.sum("n").alias("n"))


def character_costs(counts: dict[int, int]) -> np.ndarray:
    """Costs -log p(c | a, b) of trigrams a, b, c, interpolated with shorter contexts."""
    n = np.zeros(KINDS**3)
    for cell, k in counts.items():
        n[cell] = k
    n = n.reshape(KINDS, KINDS, KINDS)
    one = (n.sum((0, 1)) + 1) / (n.sum() + KINDS)
    two = (n.sum(0) + 5 * one) / (n.sum((0, 2))[:, None] + 5)
    three = (n + 5 * two[None]) / (n.sum(2)[:, :, None] + 5)
    return -np.log(three)


def _without_ornament(token: str) -> str:
    """A token without a run of three or more equal signs at either end."""
    for strip in (str.lstrip, str.rstrip):
        sign = token[:1] if strip is str.lstrip else token[-1:]
        if sign and not sign.isalnum() and len(token) - len(rest := strip(token, sign)) >= 3:
            token = rest
    return token


class Restorer:
    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    def decode(self, hidden: str) -> list[str]:
        """The likeliest words behind `hidden`, which is in lower case."""
        best: dict[tuple, tuple] = {(EDGE, EDGE): (0.0, None)}
        for c, run in groupby(hidden):
            n = len(list(run))
            if c.isalpha():
                options = [(c, 0.0)] if n == 1 else [(c, SHORTEN if n == 2 else 0.0), (c * 2, 0.0)]
            elif c in LEET:
                options = [(x * k, SUBSTITUTE) for x in LEET[c] for k in range(1, min(n, 2) + 1)] + [(" ", AS_SIGN)]
            elif c in SEPARATORS:
                options = [("", SKIP), (" ", 0.0)]
            else:
                options = [(" ", 0.0)]
            following: dict[tuple, tuple] = {}
            for (a, b), (cost, path) in best.items():
                for letters, extra in options:
                    x, y, total, way = a, b, cost + extra, path
                    for letter in letters:
                        z = EDGE if letter == " " else _kind(letter)
                        if z == EDGE and y == EDGE:
                            continue
                        total += self.costs[x][y][z]
                        x, y, way = y, z, (way, letter)
                    if (x, y) not in following or total < following[x, y][0]:
                        following[x, y] = (total, way)
            best = following
        path = min(((cost + (0 if b == EDGE else self.costs[a][b][EDGE]), way) for (a, b), (cost, way) in best.items()), key=lambda x: x[0])[1]
        letters = []
        while path:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters)).split()

    def words(self, token: str) -> list[str]:
        """The words of a token without white space, in lower case: as they stand if they can."""
        core = _without_ornament(token).strip(_TRIM)
        plain = self._standing(core)
        return self.decode(core) if plain is None else plain

    def _standing(self, core: str) -> list[str] | None:
        if core.isalpha() and not _TRIPLE.search(core):
            return [core]
        plain = core.rstrip("!|+(").lstrip("|+(")  # at an end these mostly are what they look like
        if plain.isalpha() and not _TRIPLE.search(plain):
            return [plain]
        parts = _WORD.findall(core)
        if not parts or all(c.isalpha() or c in SEPARATORS for c in core) and min(map(len, parts)) > 1 and not _TRIPLE.search(core):
            return parts
        return None

    def readings(self, token: str) -> list[str]:
        """words(), and what they decode to if a doubled letter or a separator may hide a word."""
        core = _without_ornament(token).strip(_TRIM)
        plain = self._standing(core)
        if plain is None:
            return self.decode(core)
        if len(plain) > 1 or plain and _DOUBLE.search(plain[0]):
            plain += [w for w in self.decode(core if len(plain) > 1 else plain[0]) if w not in plain]
        return plain

    def spaced(self, text: str) -> list[str]:
        """Words restored from single letters with spaces between them; without one they are a token."""
        return [w for m in _SPACED.finditer(text) if " " in m[0] for w in self.decode(m[0])]


def parts(word: str) -> set[str]:
    """What a word is scored by besides itself: its beginnings and ends."""
    return {*(f"<{word[:k]}" for k in (4, 5, 6) if len(word) >= k), *(f">{word[-k:]}" for k in (4, 5, 6) if len(word) >= k)}


@dataclass
class Model:
    costs: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    logistic: tuple[float, ...] = (-50.0, 0.0, 0.0, 0.0)
    name: str = ""

    def __post_init__(self) -> None:
        self.name = xxhash.xxh3_128_hexdigest(repr((sorted(self.weights.items()), self.costs.tolist())))

    def word_score(self, word: str) -> float:
        get = self.weights.get
        return max(get(p, 0.0) for p in (f"={word}", *parts(word)))

    def scorer(self) -> _Scorer:
        restorer = Restorer(self.costs)
        score = lambda token: max(map(self.word_score, restorer.readings(token)), default=0.0)
        return _Scorer(self, restorer, kept(("toxicity", self.name), lambda: Memo(lambda tokens: list(map(score, tokens)))))


@dataclass
class _Scorer:
    model: Model
    restorer: Restorer
    memo: Memo

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        tokens = set(low.split())
        scores = list(map(self.memo.known(tokens).__getitem__, tokens))
        scores += map(self.model.word_score, self.restorer.spaced(low))
        return document_features(scores)

    def score(self, text: str | None) -> float:
        first, *rest = self.model.logistic
        total = first + sum(w * x for w, x in zip(rest, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, total))))


def document_features(scores: list[float]) -> list[float]:
    """The scores of the two highest-scored different tokens, and the first again if it is the only one."""
    first, second = nlargest(2, [*scores, 0.0, 0.0])
    return [first, second, 0.0 if second else first]


class Evidence:
    """Which words and which of their parts are in which documents of a labelled sample, as arrays."""

    def __init__(self, docs: list[tuple[str, ...]], labels: np.ndarray):
        number: dict[str, int] = {}
        self.labels = labels.astype(bool)
        self.word = np.fromiter((number.setdefault(w, len(number)) for d in docs for w in d), np.int64)
        self.doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        self.words = list(number)
        toxic = np.bincount(self.word[self.labels[self.doc]], minlength=len(self.words))
        seen: Counter = Counter()
        for w in np.flatnonzero(toxic):
            for p in parts(self.words[w]):
                seen[p] += int(toxic[w])
        self.parts = [p for p, n in seen.items() if n >= SUPPORT]  # no other part can have the support
        known = {p: i for i, p in enumerate(self.parts)}
        del seen
        own = [[known[p] for p in parts(w) if p in known] for w in self.words]
        self.part_from = np.cumsum([0, *map(len, own)])
        self.part = np.fromiter((p for o in own for p in o), np.int64)

    def parts_of(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the words, part) for each part of each word."""
        n = self.part_from[word + 1] - self.part_from[word]
        which = np.repeat(np.arange(len(word)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.part_from[word], n)
        return which, self.part[at]

    def bounds(self, doc: np.ndarray, item: np.ndarray, size: int, use: np.ndarray) -> np.ndarray:
        """Lower confidence bounds of the log odds of items over the documents in use; 0 where they are none or without support."""
        n1, n0 = int((use & self.labels).sum()), int((use & ~self.labels).sum())
        pairs = np.sort(doc * size + item)
        pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))[: len(pairs)]]
        doc, item = np.divmod(pairs, size)
        k1 = np.bincount(item[self.labels[doc]], minlength=size)
        k0 = np.bincount(item[~self.labels[doc]], minlength=size)
        cells = [k1 + 0.5, n1 - k1 + 0.5, k0 + 0.5, n0 - k0 + 0.5]
        bound = np.log(cells[0] / cells[1]) - np.log(cells[2] / cells[3]) - Z * np.sqrt(sum(1 / c for c in cells))
        return np.where(k1 >= SUPPORT, np.maximum(bound, 0), 0)

    def log_odds(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds, 0 for none, of words and of parts, over the documents in use.

        What is explained is no further evidence: words that are MARKED by themselves count for none of their parts,
        and words with a part that is STRONG count for none of the others.
        """
        here = use[self.doc]
        doc, word = self.doc[here], self.word[here]
        own = self.bounds(doc, word, len(self.words), use)
        open_ = own[word] < MARKED
        doc, word = doc[open_], word[open_]
        which, part = self.parts_of(word)
        strong = self.bounds(doc[which], part, max(1, len(self.parts)), use)
        strong[strong < STRONG] = 0
        explained = np.zeros(len(word), bool)
        explained[which[strong[part] > 0]] = True
        rest = ~explained[which]
        weak = self.bounds(doc[which][rest], part[rest], max(1, len(self.parts)), use)
        return own, np.maximum(strong, weak)

    def named(self, own: np.ndarray, part: np.ndarray) -> dict[str, float]:
        """The bounds that there are, by '=word' and by part."""
        out = {f"={self.words[w]}": float(own[w]) for w in np.flatnonzero(own)}
        return out | {self.parts[p]: float(part[p]) for p in np.flatnonzero(part)}

    def word_scores(self, own: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The largest bound of each word and its parts."""
        out = own.copy()
        which, p = self.parts_of(np.arange(len(self.words)))
        np.maximum.at(out, which, part[p])
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 50) -> np.ndarray:
    """Intercept and weights by Newton's method; the intercept isn't penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], labels: list[int], costs: np.ndarray) -> Model:
    """The model of the given rows, of which equal texts count once; with one class only, its share is every document's score."""
    pairs = sorted(dict(zip(texts, labels, strict=True)).items())  # copies of a text are one witness
    texts, y = [t for t, _ in pairs], np.array([label for _, label in pairs], float)
    if not len(y) or y.min() == y.max():
        return Model(costs, {}, (50.0 if len(y) and y.max() else -50.0, 0.0, 0.0, 0.0))
    restorer = Restorer(costs)
    memo = Memo(lambda tokens: list(map(restorer.readings, tokens)), most=100_000)
    docs = []
    for text in texts:
        low = text.lower()
        tokens = set(low.split())
        known = memo.known(tokens)
        docs.append(tuple({w for t in tokens for w in known[t]} | set(restorer.spaced(low))))
    evidence = Evidence(docs, y)
    fold = np.array([xxhash.xxh64_intdigest(t.encode()) % 2 for t in texts])
    x = np.zeros((len(docs), 3))
    ends = np.cumsum([0, *map(len, docs)])
    for half in (0, 1):
        scores = evidence.word_scores(*evidence.log_odds(fold != half))[evidence.word]
        for i in np.flatnonzero(fold == half):
            x[i] = document_features(scores[ends[i] : ends[i + 1]].tolist())
    weights = evidence.named(*evidence.log_odds(np.ones(len(docs), bool)))
    return Model(costs, weights, tuple(fit_logistic(x, y).tolist()))


def unsampled(intercept: float, sampled: dict[int, int], every: dict[int, int]) -> float:
    """The intercept for classes of `every` size, from a fit on `sampled` rows of each; as it is without rows of both."""
    if not all(sampled.get(y) and every.get(y) for y in (0, 1)):
        return intercept
    return intercept - math.log(sampled[1] / every[1]) + math.log(sampled[0] / every[0])


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", sample: dict[int, int] | None = None) -> Model:
    """Count the character model over all of `docs`, and fit the score on labelled rows that aren't held out.

    Of each class the rows with the smallest hashes of their ids are taken, SAMPLE[class] at most; the
    sample is broadcast, one task fits it, and the intercept is set back to the classes' shares of all these rows. A document with several labels is toxic if one of them
    says so; null ids and labels count for nothing.
    """
    bounds = sample or SAMPLE
    counts = {r.cell: r.n for r in character_counts(docs, text_col).toLocalIterator()}
    costs = character_costs(counts)
    known = labels.select(*column_names(labels, doc_id=label_id_col, toxic=label_col)).where("doc_id is not null and toxic is not null")
    known = known.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    every = {r.toxic: r["count"] for r in known.where(F.col("toxic").isin(*bounds)).groupBy("toxic").count().collect()}
    picks = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in sorted(bounds.items())]
    texts = docs.select(*column_names(docs, doc_id=id_col, text=text_col)).where("text is not null")
    rows = texts.join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id").select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: list[tuple] = []
        for some in columns(batches, "text", "toxic"):
            both += zip(*some, strict=True)
        both.sort()  # the order of rows doesn't matter; of copies that disagree, toxic ones count
        model = fit([t for t, _ in both], [y for _, y in both], costs)
        items = [*model.weights.items(), *((f"#{i}", w) for i, w in enumerate(model.logistic))]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in items]), pa.array([float(w) for _, w in items])], ["part", "weight"])

    found = dict(rows.repartition(1).mapInArrow(run, "part string, weight double").collect())
    first, *rest = (found.pop(f"#{i}", d) for i, d in enumerate((-50.0, 0.0, 0.0, 0.0)))
    first = unsampled(first, {y: min(n, bounds[y]) for y, n in every.items()}, every)
    return Model(costs, found, (first, *rest))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of `docs`.

    Null and empty texts have the score of a text without any marked word. A null doc_id isn't held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for ids, texts in columns(batches, "doc_id", "text", remembers=True):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(scorer.score, texts)), pa.float64())], ["doc_id", "score"])

    picked = docs.select(*column_names(docs, doc_id=id_col, text=text_col)).withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = picked.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose score is under 0.5, with all of their columns."""

    plain, at = numbered(docs), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            keep: list[bool] = []
            for (texts,) in columns(iter([batch]), f"c{at}", remembers=True):
                keep += [scorer.score(t) < 0.5 for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
