"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessgrid.llm import (
    bpe, bwt_dedup, exact_dedup, hilbert, jaccard, mixing, phrases, prefix_trie, quality, quotes, token_counts,
    token_files, topk,
)
from tessgrid.llm.common import shared_folder

TOKEN_LIMIT = 4096

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    token_files.write_tokens(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path
    )
    return token_files.read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query
def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = quotes.conversations(_table(spark, sf_dir, "conversations"))
    return threads.withColumn("path", F.array_join("path", "."))


@query
def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on messages that quote: each opens with the first line of the turn before it and,
    one level deeper, of the turn before that."""
    told = _table(spark, sf_dir, "conversations")
    first = told.select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.split("text", "\n")[0].alias("line")
    )
    one, two = first.alias("one"), first.alias("two")
    quoting = (
        told.join(one, (F.col("conv_id") == F.col("one.c")) & (F.col("turn") - 1 == F.col("one.t")), "left")
        .join(two, (F.col("conv_id") == F.col("two.c")) & (F.col("turn") - 2 == F.col("two.t")), "left")
        .select(
            "conv_id", "turn", "role",
            F.concat_ws(
                "\n",
                F.concat(F.lit("> > "), F.col("two.line")),
                F.concat(F.lit("> "), F.col("one.line")),
                "text",
            ).alias("text"),
        )
    )
    return quotes.conversations(quoting).withColumn("path", F.array_join("path", "."))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op7_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.integer_vectors(_table(spark, sf_dir, "embeddings"))
    return topk.search(rows, rows.where("vec_id % 100 = 0"))


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(_table(spark, sf_dir, "documents"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


@query
def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shards(_table(spark, sf_dir, "documents"))


@query
def op11_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = bwt_dedup.without_repeats(_table(spark, sf_dir, "documents"))
    lengths = F.transform("spans", lambda x: x["end"] - x["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda total, x: total + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))
