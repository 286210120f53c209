"""Names and tags: file stems, caption tokens, lists, versions, escaping."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tags whose underscores are drawn, not spaces.
KAOMOJI = ("0_0", "(o)_(o)", "+_+", "+_-", "._.", "<o>_<o>", "<|>_<|>", "=_=", ">_<", "3_3", "6_9", ">_o", "@_@", "^_^", "o_o", "u_u", "x_x", "|_|", "||_||")
#: What file systems don't allow in names.
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1f]'


@F.pandas_udf(T.StringType())
def composed(s: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no function for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def sanitize_stem(name: Column, most: int = 80, composed_already: bool = False) -> Column:
    """A safe file stem: composed, without forbidden characters, white space as underscores, no dots or underscores at the ends.

    What is empty becomes `video`; an empty or too long name gets eight digits of its own md5.
    """
    plain = name if composed_already else composed(name)
    clean = F.regexp_replace(F.regexp_replace(plain, FORBIDDEN, ""), r"(?U)\s+", "_")
    clean = F.regexp_replace(clean, r"^[_.]+|[_.]+$", "")
    tail = F.concat(F.lit("_"), F.substring(F.md5(name), 1, 8))
    odd = (clean == "") | (F.length(clean) > most)
    base = F.when(clean == "", "video").otherwise(clean)
    return F.when(odd, F.concat(F.substring(base, 1, most - 9), tail)).otherwise(clean)


def format_tag(tag: Column) -> Column:
    """Underscores as spaces, but for drawn faces."""
    return F.when(tag.isin(*KAOMOJI), tag).otherwise(F.replace(tag, F.lit("_"), F.lit(" ")))


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def first_of_each(tokens: Column) -> Column:
    """An array without later elements that equal an earlier one when case is ignored, and without empty ones."""

    def step(acc: Column, x: Column) -> Column:
        return F.when((x == "") | F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(tokens, F.array().cast("array<string>"), step)


def parse_tag_list(raw: Column) -> Column:
    """Comma-separated tags as caption tokens, first of each kept."""
    return first_of_each(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: format_tag(collapse(x))))


def parse_tags(raw: str) -> list[str]:
    """parse_tag_list() of a setting."""
    out: dict[str, str] = {}
    for part in raw.split(","):
        token = " ".join(part.split())
        token = token if token in KAOMOJI else token.replace("_", " ")
        if token:
            out.setdefault(token.lower(), token)
    return list(out.values())


def version_parts(version: Column) -> Column:
    """Numbers of a version, without a leading v and what follows the numbers; arrays of them compare as versions do."""
    return F.transform(F.split(F.regexp_extract(F.lower(F.trim(version)), r"^v?(\d+(?:\.\d+)*)", 1), r"\."), lambda x: F.coalesce(x.try_cast("long"), F.lit(0).cast("long")))


def is_newer(version: Column, than: Column) -> Column:
    return version_parts(version) > version_parts(than)


def escape_html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    """A path's last part without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]*$", "")
