"""A corpus pipeline: quality rules, n-gram Jaccard join, substring dedup, benchmark decontamination, byte-level BPE.

Each stage is a function of (spark, docs, sf_dir); its result is written and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import bpe, decontaminate, ngram_join, quality, substrings
from auditlake.llm.common import materialize, read

#: Words of a shingle, and the similarity in percent from which documents are near duplicates.
NEAR_GRAM, NEAR_PERCENT = 5, 80


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars as its text now has it, in the given columns."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go.

    Null and empty texts break a base rule; repeated rows are judged alike; very long texts are read whole. Without
    labels the base rules alone decide. An empty table stays empty. All columns stay, whatever their names.
    """
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id.

    Documents link from a similarity of 0.8 of their sets of five-word shingles; op10_ngram_join has values of its own.
    Texts without words link with nothing and stay, as do rows with a null id and repeated rows of an id that stays.
    An empty table stays empty. All columns stay, whatever their names.
    """
    return ngram_join.keep_one(docs, gram=NEAR_GRAM, percent=NEAR_PERCENT)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too leave the text; the document stays, with n_chars as its text now has it.

    Null and empty texts, and rows with a null id, stay as they are, and n_chars of a null text is null. An empty table
    stays empty. All columns stay, whatever their names.
    """
    return _counted(substrings.strip_repeated(docs), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their id; rows with a null id and texts without words stay.

    An empty table stays empty, and an empty benchmark drops nothing. All columns stay, whatever their names.
    """
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text that is left; null and empty texts have no ids."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]
#: SQL can express neither the certified cutoffs nor the merges; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
