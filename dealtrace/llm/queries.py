"""Registered queries: each operator over its whole given table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    decontaminate,
    fill_middle,
    license_scan,
    mixing,
    nearest,
    packing,
    part_codes,
    quality,
    secret_scan,
    simhash,
    substring_dedup,
    toxicity,
)
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_digest(license_scan.license_spans(read(spark, folder, "documents")))


def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], rows.schema)
    return chat_format.chat_digest(chat_format.format_chats(chat_format.chain(rows.unionByName(probe))))


def op4_cross_polytope(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_super_kmers(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, folder, "documents"))


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"), shortest=1)


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_digest(secret_scan.secret_spans(read(spark, folder, "documents")))


def op8_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_digest(simhash.simhash_groups(read(spark, folder, "documents")))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op11_part_codes(spark: SparkSession, folder: str) -> DataFrame:
    return part_codes.code_digest(part_codes.fit(read(spark, folder, "embeddings")))


def op12_sum_of_squares(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.token_pieces(read(spark, folder, "documents"), tokenizer, with_ids=False))


def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    framed = fill_middle.frame_texts(read(spark, folder, "documents"))
    return fill_middle.fill_middle_digest(fill_middle.fill_middle(framed))


LLM_QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_source_mix,
        op3_chat_format,
        op4_cross_polytope,
        op5_super_kmers,
        op6_decontaminate,
        op7_secret_scan,
        op8_simhash_dedup,
        op9_quality,
        op10_toxicity,
        op11_part_codes,
        op12_sum_of_squares,
        op13_fill_middle,
    )
}
