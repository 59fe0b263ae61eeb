"""From raw documents to packed sequences: quality rules, near-dedup, suffix dedup, surrogates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talonscan.llm import near_copies, packing, pii, quality_rules, suffix_dedup
from talonscan.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes failing lines, and the documents that the quality rules reject."""
    return quality_rules.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: 0.8 or more of five-word shingles in common, by SimHash and BK-trees."""
    return near_copies.keep_one(docs)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that occur earlier; a document of which nothing is left goes."""
    return suffix_dedup.remove_repeats(docs).where(F.length("text") > 0)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data."""
    return pii.replace_pii(docs, pii.key_of(spark), counted=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row for each piece, with its ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffixes),
    ("pii_surrogates", surrogates),
    ("packing", pack),
]

#: Fingerprints, suffix ranks and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
