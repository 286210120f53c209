"""Model scores to tags, captions and tag statistics.

The long form has a row for each image and picked tag: (image, kind, idx, name, conf), kind 'character' or
'general'. Vocabularies have (idx, name, category); settings such as lists of tags are small literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

GENERAL, COPYRIGHT, CHARACTER, RATING = 0, 3, 4, 9


def clean_score(p: Column) -> Column:
    """Scores that aren't finite count as 0, others are clipped to 0 to 1."""
    p = p.cast("double")
    bad = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def scored(images: DataFrame, vocabulary: DataFrame, image: str = "image", probs: str = "probs") -> DataFrame:
    """(image, idx, name, category, conf): scores meet the vocabulary by position; entries beyond either end are dropped."""
    long = images.select(F.col(image).alias("image"), F.posexplode(probs).alias("idx", "_p"))
    return long.join(vocabulary, "idx").select("image", "idx", "name", "category", clean_score(F.col("_p")).alias("conf"))


def picked(scores: DataFrame, general: float = 0.35, character: float = 0.85) -> DataFrame:
    """The long form of the tags whose score reaches its category's threshold."""
    kind = F.when((F.col("category") == CHARACTER) & (F.col("conf") >= character), "character").when((F.col("category") == GENERAL) & (F.col("conf") >= general), "general")
    return scores.select("image", kind.alias("kind"), "idx", "name", "conf").where("kind is not null")


def ratings(scores: DataFrame) -> DataFrame:
    """(image, rating, conf): the highest-scored rating, the first one on ties."""
    best = F.max_by(F.struct("name", "conf"), F.struct("conf", -F.col("idx")))
    return scores.where(F.col("category") == RATING).groupBy("image").agg(best.alias("_b")).select("image", F.col("_b.name").alias("rating"), F.col("_b.conf").alias("conf"))


def ranked(tags: DataFrame) -> DataFrame:
    """With `place`, a tag's place in its image: characters first, each kind by falling score, then by position."""
    order = Window.partitionBy("image").orderBy((F.col("kind") != "character").cast("int"), F.col("conf").desc(), "idx")
    return tags.withColumn("place", F.row_number().over(order))


def tokens(tags: DataFrame) -> DataFrame:
    """(image, token): an image's distinct lower-case caption tokens."""
    return tags.select("image", F.lower(text.format_tag(F.col("name"))).alias("token")).distinct()


def constant_tokens(images: DataFrame, tags: DataFrame, threshold: float) -> DataFrame:
    """(token, n_images, share): tokens of at least the threshold's share of all images, those without tags too.

    A threshold of 0 finds none: it turns pruning off.
    """
    n = images.select(F.countDistinct("image").alias("_n"))
    counts = tokens(tags).groupBy("token").agg(F.count("*").alias("n_images"))
    total = n.first()._n
    if threshold <= 0 or not total:
        return counts.where("false").withColumn("share", F.lit(0.0))
    return counts.withColumn("share", F.col("n_images") / total).where(F.col("share") >= threshold)


def _lower(names: Sequence[str]) -> list[str]:
    return [t.lower() for t in names]


def accepted(images: DataFrame, tags: DataFrame, require: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Images that have every required and no excluded token among the model's own."""
    need, bad = _lower(require), _lower(exclude)
    wanted = tokens(tags).where(F.col("token").isin(*need, *bad)) if need or bad else None
    if wanted is None:
        return images
    have = wanted.groupBy(F.col("image").alias("_image")).agg(F.count_if(F.col("token").isin(*need) if need else F.lit(False)).alias("_need"), F.count_if(F.col("token").isin(*bad) if bad else F.lit(False)).alias("_bad"))
    joined = images.join(have, F.col("image") == F.col("_image"), "left")
    good = (F.coalesce("_need", F.lit(0)) == len(set(need))) & (F.coalesce("_bad", F.lit(0)) == 0)
    return joined.where(good).drop("_image", "_need", "_bad")


def caption_tokens(images: DataFrame, tags: DataFrame, trigger: str = "", always: Sequence[str] = (), drop: Sequence[str] = (), pruned: DataFrame | None = None) -> DataFrame:
    """(image, pos, token): trigger, always-tags, characters, general tags; the first of each when case is ignored.

    drop and pruned (column token, lower case) take model tags away, never the trigger or always-tags.
    Tokens with a smaller `pos` come first; positions have gaps.
    """
    fixed = [t for t in (" ".join(trigger.split()), *always) if t]
    lead = images.select("image", F.posexplode(F.array(*map(F.lit, fixed)) if fixed else F.array().cast("array<string>")).alias("pos", "token"))
    own = ranked(tags).select("image", (F.col("place") + len(fixed)).alias("pos"), text.format_tag(F.col("name")).alias("token"))
    if drop:
        own = own.where(~F.lower("token").isin(*_lower(drop)))
    if pruned is not None:
        own = own.join(pruned.select(F.col("token").alias("_gone")), F.lower("token") == F.col("_gone"), "left_anti")
    every = lead.select("image", F.col("pos").cast("int").alias("pos"), "token").unionByName(own.select("image", F.col("pos").cast("int").alias("pos"), "token"))
    first = every.groupBy("image", F.lower("token").alias("_key")).agg(F.min(F.struct("pos", "token")).alias("_t"))
    return first.select("image", F.col("_t.pos").alias("pos"), F.col("_t.token").alias("token"))


def captions(token_rows: DataFrame) -> DataFrame:
    """(image, caption): tokens joined by comma and space. Images without any have no row."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return token_rows.groupBy("image").agg(F.array_join(F.transform(listed, lambda t: t["token"]), ", ").alias("caption"))


def frequencies(token_rows: DataFrame, trigger: str = "") -> DataFrame:
    """(token, n): in how many captions a token is; the trigger isn't counted."""
    lower = " ".join(trigger.split()).lower()
    return token_rows.where(F.lower("token") != lower).groupBy("token").agg(F.count("*").alias("n"))


def top(counts: DataFrame, most: int = 30) -> DataFrame:
    """The most frequent tokens, in alphabetical order where they tie."""
    return counts.orderBy(F.col("n").desc(), "token").limit(most)
