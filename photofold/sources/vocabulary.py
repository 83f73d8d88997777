"""Label vocabularies and translation tables from text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photofold.functions.vocabulary import TRANSLATION_OVERRIDES
from photofold.plans.hot_keys import salted_join


def number_lines(texts: DataFrame, text: str, keys: Sequence[str] = ()) -> DataFrame:
    """Lines of whole texts with their index: ``idx, label``. Blank lines keep their index."""
    lines = F.split(F.regexp_replace(F.col(text), r"\r?\n$", ""), r"\r?\n")
    return texts.select(*keys, F.posexplode(lines).alias("idx", "label"))


def load_label_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``idx, label`` of a vocabulary file, one label per line, the first with index 0."""
    return number_lines(spark.read.text(path, wholetext=True), "value")


def translation_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """``label, zh`` of lines such as ``"label": "name",``; other lines are left out."""
    pattern = r"""^\s*(["'])(.+?)\1\s*:\s*(["'])(.*)\3\s*,?\s*$"""
    return lines.select(
        F.regexp_extract(text, pattern, 2).alias("label"),
        F.regexp_extract(text, pattern, 4).alias("zh"),
    ).filter(F.col("label") != "")


def merge_translations(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """One name per label; an override wins."""
    rows = base.select("label", "zh", F.lit(0).alias("_priority")).unionByName(
        overrides.select("label", "zh", F.lit(1).alias("_priority"))
    )
    return rows.groupBy("label").agg(F.max_by("zh", F.struct("_priority", "zh")).alias("zh"))


def builtin_overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRANSLATION_OVERRIDES.items()), "label string, zh string")


def load_translations(spark: SparkSession, path: str) -> DataFrame:
    """Translation file merged with the built-in overrides."""
    return merge_translations(translation_lines(spark.read.text(path)), builtin_overrides(spark))


def vocab_duplicates(vocabulary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Labels that occur more than once."""
    return (
        vocabulary.groupBy(*keys, "label")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter(F.col("occurrences") > 1)
    )


def dedupe_keep_first(lines: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """All rows with ``is_duplicate``: false for the first row of each key, true for repeats."""
    first = lines.groupBy(*keys).agg(F.min(order).alias("_first"))
    return (
        salted_join(lines, first, keys)
        .withColumn("is_duplicate", F.col(order) > F.col("_first"))
        .drop("_first")
    )
