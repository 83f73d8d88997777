"""From documents to token files: quality rules, near-duplicates, decontamination, source mix, token ids.

Each stage works on all rows that the one before it kept; between two stages the rows are written as Parquet
and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photofold.llm import decontamination, mixing, ngram_join, quality_rules, token_files
from photofold.llm.common import table
from photofold.llm.queries import word_tokenizer
from photofold.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.quality(docs).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similar word 5-grams link."""
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_copies(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and for each document in them where it begins, its number of ids and their checksum."""
    rows = token_files.round_trip(docs, word_tokenizer(), end_id=1)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_files", tokenize),
]

#: Tokens and near-duplicates by recall can't be written in SQL; tests compare with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
