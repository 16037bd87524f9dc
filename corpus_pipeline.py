"""Corpus pipeline: quality rules, exact dedup, near dedup, mixing to target weights, tokenising.

Each stage works on all rows that the stage before kept and returns their columns unchanged; the last
one returns the encoding per document. Nulls, empty texts, ties, repeated rows and empty tables are
defined by the stages' operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from daylark.llm import exact_dedup, mixing, quality, simhash, sptok
from daylark.llm.common import made, new_path, release, stored_at, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a rule of the cascade rejects go."""
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and kinds of text meet their target weights."""
    return mixing.sample_mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document that is left, with their count and digests."""
    return sptok.encode_texts(docs, ["doc_id"], public_tokenizers.path("piece_bpe_32k.model"), with_ids=True, from_files=True)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("mixing", mixture),
    ("sentencepiece", tokens),
]

#: Fingerprints, raking and tokenising are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage read or made on the way is deleted once its own rows are written.

    The result reads the rows of the last stage but one, whose table ``common.release`` deletes afterwards.
    """
    docs, start = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not tokens:
            path = new_path(spark, name.replace(" ", "-"))
            docs = stored_at(docs, path)
            release(spark, start, [path])
    return docs
