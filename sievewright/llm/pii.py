"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns find e-mail and IP addresses, card and phone numbers as usually written. The random field
reads words by their shapes (letters, digits, signs) and their neighbours', is trained on a small
labelled table, and is decoded by Viterbi in numpy over many sequences at a time. It adds spans that the
patterns miss, such as 'ann [at] mail [dot] org', '(555) 123-4567' or '4111.1111.1111.1111'; an added span
must still be plausible (digits, parts, check sum) and overlap none that the patterns found.

Only words near a sign of personal data (a digit, an @, a bracketed or spelled 'at' or 'dot') form sequences; a
text without any has no spans, whatever its length.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_names, columns, numbered

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Rows of the labelled table that are used at most, size of the feature table, words on each side of a sign.
ROWS, FEATURES, REACH = 1500, 1 << 13, 6

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SIGN = re.compile(r"[0-9@]|[\[({<](?:at|dot)[\])}>]|(?<![^\W_])dot(?![^\W_])", re.IGNORECASE)
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and non-overlapping for each kind, by start and kind.

    Each pattern is read in time linear in the text: an e-mail address is sought from its @, and an IP
    address from the start of a run of digits, as from within the run nothing else would match.
    """
    found: list[tuple[int, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(map(_byte, m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


# --- the random field -------------------------------------------------------------------------------

def shape(word: str) -> str:
    """Letters as one A or a for each run, digits as 0 with runs up to five long, signs as they are."""
    out = []
    for c in word:
        s = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if s in "Aa" and out and out[-1] == s or s == "0" and out[-5:] == ["0"] * 5:
            continue
        out.append(s)
    return "".join(out)


@lru_cache(maxsize=1 << 15)
def _own(word: str) -> tuple[str, str, str, str]:
    full = shape(word)
    digits = sum(c.isdigit() for c in word)
    low = word.lower().strip(".,;:!?")
    return full, re.sub(r"(.)\1+", r"\1", full), low if len(low) <= 12 and not digits else "#", f"{min(digits, 20)}{word[0] if not word[0].isalnum() else ''}"


def features(words: list[str]) -> np.ndarray:
    """(words, features): numbers of each word's features, hashed into FEATURES."""
    own = [_own(w) for w in words]
    none = ("", "", "", "")
    rows = []
    for i, (full, short, low, digits) in enumerate(own):
        p, q = own[i - 1] if i else none, own[i - 2] if i > 1 else none
        n, o = own[i + 1] if i + 1 < len(own) else none, own[i + 2] if i + 2 < len(own) else none
        names = (f"f{full}", f"s{short}", f"w{low}", f"d{digits}", f"p{p[1]}", f"P{p[2]}", f"n{n[1]}", f"N{n[2]}", f"q{q[1]}", f"o{o[1]}", f"ps{p[1]} {short}", f"sn{short} {n[1]}", f"pn{p[2]} {n[2]}", f"Q{q[2]}", f"O{o[2]}")
        rows.append([zlib.crc32(x.encode()) % FEATURES for x in names])
    return np.array(rows, np.int64).reshape(len(words), -1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class RandomField:
    """Linear chain over TAGS: emission weights by feature, weights of a first tag and of neighbouring tags."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, first: np.ndarray):
        self.emit, self.move, self.first = emit, move, first

    @classmethod
    def zeros(cls) -> RandomField:
        k = len(TAGS)
        return cls(np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k))

    def scores(self, batch: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(sequences, longest, tags) emissions, padded with zeros, and the lengths."""
        lengths = np.array([len(f) for f in batch])
        out = np.zeros((len(batch), lengths.max(), len(TAGS)))
        flat = self.emit[np.concatenate(batch)].sum(1)
        out[np.arange(out.shape[1]) < lengths[:, None]] = flat
        return out, lengths

    def gradient(self, batch: list[np.ndarray], tags: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood of the tags and its gradient, by the forward-backward algorithm."""
        e, lengths = self.scores(batch)
        b, n, k = e.shape
        inside = np.arange(n) < lengths[:, None]
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0] + self.first
        for t in range(1, n):
            forward[:, t] = np.where(inside[:, t, None], _log_sum(forward[:, t - 1, :, None] + self.move, 1) + e[:, t], forward[:, t - 1])
        for t in range(n - 2, -1, -1):
            backward[:, t] = np.where(inside[:, t + 1, None], _log_sum(self.move + (e[:, t + 1] + backward[:, t + 1])[:, None], 2), 0)
        total = _log_sum(forward[:, -1], 1)
        each = np.exp(forward + backward - total[:, None, None]) * inside[..., None]
        truth = np.zeros((b, n), np.int64)
        truth[inside] = np.concatenate(tags)
        right = np.eye(k)[truth] * inside[..., None]
        emit = np.zeros_like(self.emit)
        ids = np.concatenate(batch)
        gap = (right - each)[inside]
        np.add.at(emit, ids.ravel(), np.repeat(gap, ids.shape[1], 0))
        pair = np.exp(forward[:, :-1, :, None] + self.move + (e[:, 1:] + backward[:, 1:])[:, :, None] - total[:, None, None, None]) * inside[:, 1:, None, None]
        move = np.einsum("btj,btk->jk", right[:, :-1] * inside[:, 1:, None], right[:, 1:]) - pair.sum((0, 1))
        first = (right[:, 0] - each[:, 0]).sum(0)
        likelihood = (e * right).sum() + self.first[truth[:, 0]].sum() + (self.move[truth[:, :-1], truth[:, 1:]] * inside[:, 1:]).sum() - total.sum()
        return float(likelihood), emit, move, first

    @classmethod
    def train(cls, rows: list[tuple[list[str], list[str]]], rounds: int = 20, size: int = 64, rate: float = 0.1, ridge: float = 1e-4, seed: int = 7) -> RandomField:
        """Maximum likelihood by Adagrad over batches of (words, tags) rows, ROWS of them at most."""
        model = cls.zeros()
        data = [(features(w), np.array([TAGS.index(t) for t in tags])) for w, tags in rows[:ROWS] if w]
        weights = [model.emit, model.move, model.first]
        squares = [np.full_like(w, 1e-8) for w in weights]
        rng = random.Random(seed)
        for _ in range(rounds):
            rng.shuffle(data)
            for k in range(0, len(data), size):
                part = data[k : k + size]
                _, *slopes = model.gradient([f for f, _ in part], [t for _, t in part])
                for w, s, g in zip(weights, squares, slopes, strict=True):
                    g = g - ridge * len(part) * w
                    s += g * g
                    w += rate * g / np.sqrt(s)
        return model

    def decode(self, sequences: list[np.ndarray], cells: int = 1 << 16) -> list[np.ndarray]:
        """The likeliest tags of each sequence; those of similar length are padded to one batch."""
        out: list = [None] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        k = 0
        while k < len(order):
            stop = k + 1
            while stop < len(order) and (stop + 1 - k) * len(sequences[order[stop]]) <= cells:
                stop += 1
            part, k = order[k:stop], stop
            e, lengths = self.scores([sequences[i] for i in part])
            b, n, _ = e.shape
            rows, best = np.arange(b), e[:, 0] + self.first
            back = np.zeros(e.shape, np.int8)
            for t in range(1, n):
                ways = best[:, :, None] + self.move
                back[:, t] = ways.argmax(1)
                best = np.where((t < lengths)[:, None], ways.max(1) + e[:, t], best)
            tags = np.zeros((b, n), np.int64)
            last = best.argmax(1)
            for t in range(n - 1, -1, -1):
                tags[:, t] = last
                last = np.where(t < lengths, back[rows, t, last], last) if t else last
            for i, row, m in zip(part, tags, lengths, strict=True):
                out[i] = row[:m]
        return out


# --- the labelled table -----------------------------------------------------------------------------


def labelled_rows(n: int = ROWS, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """A small labelled table (words, tags), made by a seeded rule: personal data in common spellings among made-up words and
    numbers that are none."""
    rng = random.Random(seed)
    digit = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    syllables = "an be the ing er ou tion la de que ver sch ment le ra os un co ti re".split()
    name = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))

    def card() -> str:
        body = digit(rng.choice((13, 14, 15)))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def email() -> str:
        user, host, end = name() + rng.choice(("", ".", "_", digit(2))) + name(), name(), rng.choice(("com", "org", "net", "example.com"))
        at = rng.choice(("@", "@", "[at]", "(at)", " [at] ", " (at) ", " at ", " @ "))
        dot = "." if "@" in at and at == "@" else rng.choice((" dot ", " [dot] ", "[dot]", "(dot)") if at != " @ " else (" . ", "."))
        if at == " at ":
            dot = rng.choice((" dot ", " [dot] "))
        return user + at + host + "".join(dot + x for x in end.split("."))

    def ip() -> str:
        return rng.choice((".", ".", "[.]", "(.)", " . ", "[dot]")).join(str(rng.randrange(256)) for _ in range(4))

    def phone() -> str:
        a, b, c = digit(3), digit(3), digit(4)
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+49 {a} {b}{c}", f"00{digit(2)} {a} {b} {c}", f"1-{a}-{b}-{c}"))

    def spaced_card() -> str:
        c = card()
        return rng.choice((c, c, " ".join(c[i : i + 4] for i in range(0, len(c), 4)), "-".join(c[i : i + 4] for i in range(0, len(c), 4)), ".".join(c[i : i + 4] for i in range(0, len(c), 4))))

    def nothing() -> str:
        return rng.choice((digit(rng.randrange(1, 8)), f"{digit(1)}.{digit(1)}", f"{digit(1)}.{digit(2)}.{digit(1)}", f"20{digit(2)}-{digit(2)}-{digit(2)}", f"${digit(3)}.{digit(2)}", f"password={name()}{digit(6)}", f"AKIA{digit(4)}{name().upper()}{digit(5)}", f"{digit(2)}:{digit(2)}", f"{digit(3)},{digit(3)}", f"[{digit(1)}]", f"({digit(4)})", f"{digit(2)}%", f'"{name()}{digit(5)}{name()}{digit(4)}"', f"{name()}{digit(2)}", "at", "dot", "@", f"@{name()}", "|", f"{digit(4)}-{digit(4)}", digit(16), f"{digit(1)} {digit(1)} {digit(1)}", f"{digit(5)}-{digit(2)}", f"v{digit(1)}.{digit(1)}"))

    makers = {"email": email, "ip": ip, "card": spaced_card, "phone": phone}
    rows = []
    for _ in range(n):
        words: list[str] = []
        tags: list[str] = []
        for _ in range(rng.randrange(1, 4)):
            for _ in range(rng.randrange(1, 7)):
                words.append(name().capitalize() if rng.random() < 0.1 else name() + rng.choice(("", "", "", ",", ".")))
                tags.append("O")
            kind = rng.choice((*KINDS, None, None, None))
            got = (makers[kind] if kind else nothing)().split()
            if rng.random() < 0.25:
                got[-1] += rng.choice(".,;")
            words += got
            tags += [f"{'I' if k else 'B'}-{kind}" if kind else "O" for k in range(len(got))]
        rows.append((words, tags))
    return rows


def tagged(text: str, spans: list[tuple[int, str, int]]) -> tuple[list[str], list[str]]:
    """(words, tags) of a text with labelled spans (start, kind, end); a word belongs to the span that it touches first."""
    words = list(_WORD.finditer(text))
    tags = ["O"] * len(words)
    for start, kind, end in spans:
        inside = [i for i, m in enumerate(words) if m.start() < end and m.end() > start and tags[i] == "O"]
        for k, i in enumerate(inside):
            tags[i] = f"{'I' if k else 'B'}-{kind}"
    return [m[0] for m in words], tags


def train(table: DataFrame, text_col: str = "text", spans_col: str = "spans", rows: int = ROWS) -> RandomField:
    """A random field from a labelled table (text, spans array<struct<start, kind, stop>>): of its rows the `rows` with the smallest
    hashes of their texts, which come to the driver; rows without a text teach nothing."""
    picked = table.select(*column_names(table, text=text_col, spans=spans_col)).where("text is not null")
    some = picked.orderBy(F.xxhash64("text"), "text").limit(rows).collect()
    return RandomField.train([tagged(r.text, [(x.start, x.kind, x.stop) for x in r.spans or []]) for r in some])


@lru_cache(maxsize=1)
def default_model() -> RandomField:
    """Trained on the table that labelled_rows() makes; train() is for a table of one's own."""
    return RandomField.train(labelled_rows())


# --- spans ------------------------------------------------------------------------------------------


def plausible(kind: str, text: str) -> bool:
    """Whether an added span can be what the field takes it for."""
    digits = "".join(c for c in text if c in "0123456789")
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1 and not re.search(r"[^0-9 .\-]", text)
    if kind == "phone":
        return 10 <= len(digits) <= 15 and not re.search(r"[^0-9 .()+\-]", text) and bool(re.search(r"[ .()\-]", text))
    if kind == "ip":
        parts = re.split(r"\s*(?:[\[({]\s*(?:\.|dot)\s*[\])}]|\.|\bdot\b)\s*", text, flags=re.IGNORECASE)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and _byte(p) for p in parts)
    sides = re.split(r"\s*(?:[\[({<]\s*at\s*[\])}>]|@|(?<=\s)at(?=\s))\s*", text, flags=re.IGNORECASE)
    if len(sides) != 2 or not re.fullmatch(r"[^\W_][\w.%+-]*", sides[0]):
        return False
    parts = re.split(r"\s*(?:[\[({<]\s*dot\s*[\])}>]|\.|(?<=\s)dot(?=\s))\s*", sides[1], flags=re.IGNORECASE)
    return len(parts) > 1 and all(re.fullmatch(r"[^\W_][\w-]*", p) for p in parts) and parts[-1].isalpha() and len(parts[-1]) > 1


_TRIM = " .,;:!?\"'"


def all_spans(texts: list[str], model: RandomField, reach: int = REACH) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text, as (start, kind, end) by start and kind."""
    base = [base_spans(t) for t in texts]
    sequences: list[np.ndarray] = []
    where: list[tuple[int, list[re.Match]]] = []
    for doc, text in enumerate(texts):
        if not _SIGN.search(text):
            continue
        words = list(_WORD.finditer(text))
        near = [i for i, m in enumerate(words) if _SIGN.search(m[0])]
        k = 0
        while k < len(near):
            lo = max(0, near[k] - reach)
            while k + 1 < len(near) and near[k + 1] - near[k] <= 2 * reach:
                k += 1
            part = words[lo : near[k] + reach + 1]
            k += 1
            sequences.append(features([m[0] for m in part]))
            where.append((doc, part))
    added: list[list] = [[] for _ in texts]
    for (doc, part), tags in zip(where, model.decode(sequences), strict=True):
        i = 0
        while i < len(part):
            name = TAGS[tags[i]]
            j = i + 1
            if name != "O":
                while j < len(part) and TAGS[tags[j]] == f"I-{name[2:]}":
                    j += 1
                start, end, text = part[i].start(), part[j - 1].end(), texts[doc]
                while start < end and text[start] in _TRIM:
                    start += 1
                while start < end and text[end - 1] in _TRIM:
                    end -= 1
                if plausible(name[2:], text[start:end]) and all(e <= start or end <= s for s, _, e in base[doc]):
                    added[doc].append((start, name[2:], end))
            i = j
    return list(zip(base, added, strict=True))


def _listed(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]))))


def _masked(text: str, spans: list) -> str:
    """The text with each span, or run of spans that overlap, replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    for s, k, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]))):
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def find(docs: DataFrame, model: RandomField | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_added), a row for each row of `docs`.

    The counts and `base` (kind:start:end by start and kind, comma-joined, in code points) are of the
    patterns' spans, `spans` has those that the random field adds too. Null and empty texts have none.
    """
    field = model or default_model()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches, "doc_id", "text"):
            rows = []
            for doc, (base, added) in zip(ids, all_spans([t or "" for t in texts], field), strict=True):
                kinds = [k for _, k, _ in base]
                rows.append((doc, *map(kinds.count, KINDS), _listed(base), _listed(base + added), len(added)))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    picked = docs.select(*column_names(docs, doc_id=id_col, text=text_col)).withColumn("doc_id", F.col("doc_id").cast("long"))
    return picked.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long")


def mask(docs: DataFrame, model: RandomField | None = None, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """`docs` with every span of personal data replaced by <KIND>; `chars_col`, if given, becomes the new length in code points."""
    field = model or default_model()
    at, plain = docs.columns.index(text_col), numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = []
            for (texts,) in columns(iter([batch]), f"c{at}"):
                spans = all_spans([t or "" for t in texts], field)
                out += [None if t is None else _masked(t, base + added) for t, (base, added) in zip(texts, spans, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    masked = plain.mapInArrow(run, plain.schema)
    if chars_col:
        n = f"c{docs.columns.index(chars_col)}"
        masked = masked.withColumn(n, F.length(f"c{at}").cast(plain.schema[n].dataType))
    return masked.toDF(*docs.columns)


def digests(found: DataFrame) -> DataFrame:
    """What find() gives, with base_sha256 in place of the list of base spans."""
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")

