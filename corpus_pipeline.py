"""The corpus pipeline: quality, exact copies, near copies, mixture, encoding.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns a DataFrame; run() writes
each result to the shared folder and reads it back as the next stage's docs. All but the last return the columns
of documents. Empty tables, nulls and repeated rows pass through as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wareloom.llm import exact_copies, mixing, near_copies, pieces, quality
from wareloom.llm.common import read, written
from wareloom.llm.queries import vocabulary

#: Wanted shares of tokens by domain, of BUDGET times the tokens that came in; a share that stays out of reach is logged.
MIXTURE = {"good": 0.97, "poor": 0.01, "toxic": 0.02}
BUDGET = 1.05


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_copies.keep_last(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_copies.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out, kept or repeated as their fitted rates say.

    Domains are learned from all labelled documents: the stages before have removed most poor ones.
    """
    return mixing.mixed(docs, read(spark, sf_dir, "labels"), MIXTURE, BUDGET, taught=read(spark, sf_dir, "documents"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids."""
    return pieces.encode_counted(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality", good_quality),
    ("exact_copies", without_copies),
    ("near_copies", without_near_copies),
    ("mixture", mixed),
    ("encoding", encoded),
]

#: Trained models and encoders are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
