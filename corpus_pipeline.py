"""A training corpus from raw documents: five stages, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import bbit_minhash, byte_pair, deobfuscate, mixing, sanitise
from docketry.llm.common import read
from docketry.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns outside the held-out fold."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    learned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    return deobfuscate.without_toxic(docs.select(COLUMNS), labels, learned)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return bbit_minhash.one_of_each(docs.select(COLUMNS), width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data and the terms that reveal it replaced."""
    clean = sanitise.sanitised(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources dealt to their target weights; a document may come twice or not at all."""
    return mixing.mixture(docs.select(COLUMNS)).select(COLUMNS)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every dealt document, and whether decoding them gives the text again."""
    return byte_pair.encoded_rows(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
    ("mixture", mixture), ("byte_pairs", byte_pairs),
]
# Restoring words, signatures and merging have no form in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
