"""A training-data pipeline of five stages; each is written as Parquet and read again as the next one's input.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import bpe, mixing, ngram_join, pii, quality_rules
from lexiloom.session import discard, ready, shared_path, table

#: No SQL engine can express the binomial bounds, the MinHash bands or the random field; the stages are tested against brute force.
ORACLE_SQL = None


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with columns that documents have besides their own under other names, so that none can clash."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        other = {c: f"besides{k}" for k, c in enumerate(docs.columns) if c not in OWN}
        found = stage(ready(spark), docs.withColumnsRenamed(other), sf_dir)
        return found.withColumnsRenamed({v: k for k, v in other.items()}).select(*docs.columns)

    return run


@_apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the risk-controlled ones."""
    judged = quality_rules.judged(docs, table(spark, sf_dir, "labels"))
    return judged.where("kept").select(*docs.columns)


@_apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of documents linked by n-gram Jaccard similarity."""
    return ngram_join.one_of_each(docs)


@_apart
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars as the new text has."""
    return pii.masked(docs)


@_apart
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text decoded from them."""
    ready(spark)
    rows = bpe.encode(docs, decoded="text", keep=["doc_id", "lang", "source"])
    return rows.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between two of them is in the shared folder until the next one is written."""
    ready(spark)
    docs, read = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            if read:
                discard(spark, read)
            docs, read = spark.read.parquet(path), path
    return docs
