"""One query a numbered operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    exact_copies, lines, mixing, near_copies, passages, pieces, quality, repair, sharding, spelling, token_counts, toxicity, vector_search,
)
from .common import read


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), shards=16)


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


#: Wanted shares of tokens by domain.
MIXTURE = {"good": 0.90, "poor": 0.07, "toxic": 0.03}


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), MIXTURE)


def op4_block_join_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_wfst_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup(read(spark, sf_dir, "documents"))


def op7_stream_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.dedup(read(spark, sf_dir, "documents"))


def op8_chained_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.dedup(read(spark, sf_dir, "documents"))


def op10_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_range_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(read(spark, sf_dir, "documents"))


def op12_four_russians_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(read(spark, sf_dir, "conversations"))


def op13_composed_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}
