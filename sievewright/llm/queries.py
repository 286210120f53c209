"""The queries of this subpackage's operators over the driver's tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cross_entropy, decontaminate, pii, preferences, simhash, sketch, substring, toxicity, wordpiece
from .common import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path of a public vocabulary file and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.swapped_replies(preferences.assembled(table(spark, sf_dir, "conversations")))
    out = preferences.format_pairs(pairs, id_col="conv_id")
    return out.withColumns({c: preferences.as_text(out[c]) for c in ("chosen_loss", "rejected_loss")})


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.against_next(documents(spark, sf_dir))


def op4_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    good = table(spark, sf_dir, "labels").where("quality = 1")
    out = cross_entropy.score(docs, good)
    return out.withColumns({c: F.round(c, 6) for c in ("loss_target", "loss_background", "difference")})


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(documents(spark, sf_dir), bpe.ByteBPE.from_file(*vocabulary())))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(documents(spark, sf_dir), wordpiece.LongestMatch.from_file(vocabulary()[0]))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(documents(spark, sf_dir)))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


_ALL = (op1_preferences, op2_substring, op3_fingerprints, op4_cross_entropy, op5_toxicity, op6_bpe, op7_token_counts, op8_pii, op9_simhash, op10_decontamination)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op1_preferences": preferences.SQL, "op2_substring": substring.SQL, "op4_cross_entropy": cross_entropy.SQL}
